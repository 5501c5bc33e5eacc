"""Query registry: every named query is a ``(spark, sf_dir) -> DataFrame``
callable plus, where SQL can state it, the DuckDB text of the same result.

Results are compared across engines. Summation order differs between
engines in the last bits, and a value that is exactly a decimal tie (an
average like 51.5943125) then rounds up in one engine and down in the other.
So doubles are first snapped to a binary grid of 2**-24 (a decimal value is
never a midpoint of that grid), then rounded to ``DIGITS`` places, and
``-0.0`` is folded to ``0.0``; both sides do exactly the same steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.tables import Tables

DIGITS = 6
GRID = float(2**24)

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            snapped = F.round(F.col(f.name).cast("double") * GRID, 0) / GRID
            cols.append((F.round(snapped, digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rnd_sql(sql: str, cols: list[str], digits: int = DIGITS) -> str:
    """Wrap a DuckDB query so the named double columns are rounded like ``rounded``."""
    if not cols:
        return sql
    rep = ", ".join(f'(round(round("{c}" * {GRID}) / {GRID}, {digits}) + 0.0) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def query(name: str, sql: str | None = None, round_cols: list[str] | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` as query ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        if sql is not None:
            ORACLES[name] = rnd_sql(sql.strip(), round_cols or [])
        return fn

    return deco
