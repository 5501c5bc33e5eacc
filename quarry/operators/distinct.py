"""Exact distinct counts of many columns in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: longer values are counted by their SHA-256, so that no row of the shuffle is long
LONGEST = 64


def _key(field: T.StructField) -> Column:
    """A column's values as text: equal values give equal text, others other text."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)  # one zero
    if isinstance(field.dataType, T.BinaryType):
        c = F.hex(c)
    elif isinstance(field.dataType, (T.ArrayType, T.StructType)):
        c = F.to_json(F.struct(c))
    c = c.cast("string")
    return F.when(F.length(c) > LONGEST, F.sha2(c, 256)).otherwise(c)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_no, distinct_count`` of the named columns' non-NULL values, by their place in
    ``columns``; columns without values have no row.

    Every value becomes a row ``(column, hash, value)``. Repeats go inside each task and then in
    one shuffle on all three, so a column, or a value, that holds most rows is spread over all
    tasks and no row is copied once per column."""
    fields = {f.name: f for f in df.schema.fields}
    cells = [F.struct(F.lit(i).alias("column_no"), _key(fields[c]).alias("v")) for i, c in enumerate(columns)]
    long = df.select(F.inline(F.array(*cells))).where("v is not null")
    once = long.groupBy("column_no", F.xxhash64("v").alias("h"), "v").agg(F.lit(1).alias("one"))
    return once.groupBy("column_no").agg(F.count(F.lit(1)).alias("distinct_count"))
