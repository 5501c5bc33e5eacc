"""Cluster resource quantities as column expressions (O1, O2).

Parsed with plain string functions and ``try_cast`` (no regex), so the
expressions stay small enough for whole-stage code generation even when many
quantity columns are parsed in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CPU suffix -> cores, memory suffix -> bytes.
CPU_SUFFIX = {"n": 1e-9, "u": 1e-6, "m": 1e-3}
MEMORY_SUFFIX = {"Ki": 1024, "Mi": 1024**2, "Gi": 1024**3, "Ti": 1024**4}


def _parse(q: Column, suffixes: dict, width: int) -> Column:
    """``<number><suffix>`` -> number * factor of the suffix; no suffix -> the
    number; anything else -> NULL. The suffix factor is one map lookup."""
    s = F.trim(q.cast("string"))
    factors = F.create_map(*[x for k, v in suffixes.items() for x in (F.lit(k), F.lit(float(v)))])
    f = F.element_at(factors, F.substring(s, -width, width))
    num = s.substr(F.lit(1), F.length(s) - F.when(f.isNull(), F.lit(0)).otherwise(F.lit(width)))
    value = num.try_cast("double") * F.coalesce(f, F.lit(1.0))
    return F.when(F.substring(s, 1, 1).between("0", "9"), value)


def cpu_cores(q: Column) -> Column:
    """O1: ``250m`` -> 0.25, ``1500000n`` -> 0.0015, ``2`` -> 2.0; other text -> NULL."""
    return _parse(q, CPU_SUFFIX, 1)


def memory_bytes(q: Column) -> Column:
    """O2: ``512Mi`` -> 536870912, ``100`` -> 100; decimal suffixes (``M``,
    ``G``) and other text -> NULL (SURVEY 2.11 #21)."""
    return F.floor(_parse(q, MEMORY_SUFFIX, 2))
