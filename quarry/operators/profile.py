"""Table profiling and loading (Q6-Q10, S8 use, F7 stamps).

``suggest_types`` measures every column in one aggregation pass; the type
names are the target warehouse's names, as in the source.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.distinct import distinct_counts
from quarry.sources import sinks

LOAD_LOG_SCHEMA = ("load_id string, load_timestamp timestamp_ntz, table_name string, row_count bigint, "
                   "status string, error_message string")


def _family(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


# Inferred type per value family (Q7).
INFERRED = {"int": "Int64", "float": "Float64", "bool": "UInt8", "datetime": "DateTime", "string": "String",
            "other": "String"}


def infer_types(df: DataFrame) -> list[tuple[str, str]]:
    """Q7: (column, type) from the frame's schema."""
    return [(f.name, INFERRED[_family(f.dataType)]) for f in df.schema.fields]


def _int_type(lo: Column, hi: Column) -> Column:
    """Narrowest integer type holding both bounds."""
    def fits(a, b):
        return (lo >= a) & (hi <= b)
    unsigned = (F.when(hi < 256, "UInt8").when(hi < 65536, "UInt16").when(hi < 2**32, "UInt32").otherwise("UInt64"))
    signed = (F.when(fits(-128, 127), "Int8").when(fits(-32768, 32767), "Int16")
              .when(fits(-2**31, 2**31 - 1), "Int32").otherwise("Int64"))
    return F.when(lo >= 0, unsigned).otherwise(signed)


def suggest_types(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """Q6: per column, on its non-NULL values: none -> String; text whose
    distinct/count ratio is below 0.5 -> LowCardinality(String); integers ->
    narrowest width for min and max; floats with sample stddev below 1e-3 ->
    Float32, else Float64; booleans -> UInt8; dates/times -> DateTime; others -> String.
    Also returns the plain inferred type (Q7) next to it.

    Counts, bounds and deviations are one aggregate; exact distinct counts of all text columns
    are one shuffle of their distinct values (``distinct_counts``). ``exact=False`` uses
    HyperLogLog sketches in the aggregate instead (1 % relative error)."""
    fams = {f.name: _family(f.dataType) for f in df.schema.fields}
    texts = [c for c, fam in fams.items() if fam == "string"]
    aggs = []
    for i, (c, fam) in enumerate(fams.items()):
        col = F.col(f"`{c}`")
        aggs.append(F.count(col).alias(f"n{i}"))
        if fam == "int":
            aggs += [F.min(col).cast("bigint").alias(f"lo{i}"), F.max(col).cast("bigint").alias(f"hi{i}")]
        elif fam == "float":
            aggs.append(F.stddev_samp(col.cast("double")).alias(f"sd{i}"))
        elif fam == "string" and not exact:
            aggs.append(F.approx_count_distinct(col, 0.01).alias(f"d{i}"))
    stats = df.agg(*aggs)

    def of(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in stats.columns else F.lit(None).cast(kind)

    entries = [
        F.struct(F.lit(c).alias("column_name"), F.lit(fam).alias("family"), F.lit(INFERRED[fam]).alias("inferred_type"), F.col(f"n{i}").alias("non_null"),
                 of(f"lo{i}", "bigint").alias("lo"), of(f"hi{i}", "bigint").alias("hi"), of(f"sd{i}", "double").alias("sd"), of(f"d{i}", "bigint").alias("d"))
        for i, (c, fam) in enumerate(fams.items())
    ]
    rows = stats.select(F.inline(F.array(*entries)))
    if exact and texts:
        names = F.element_at(F.array(*[F.lit(c) for c in texts]), F.col("column_no") + 1)
        counts = distinct_counts(df, texts).select(names.alias("column_name"), F.col("distinct_count"))
        rows = rows.join(counts, "column_name", "left").withColumn("d", F.coalesce("d", "distinct_count"))
    suggested = (
        F.when(F.col("non_null") == 0, "String")
        .when(F.col("family") == "string", F.when(F.try_divide("d", "non_null") < 0.5, "LowCardinality(String)").otherwise("String"))
        .when(F.col("family") == "int", _int_type(F.col("lo"), F.col("hi")))
        .when(F.col("family") == "float", F.when(F.col("sd") < 1e-3, "Float32").otherwise("Float64"))
        .when(F.col("family") == "bool", "UInt8").when(F.col("family") == "datetime", "DateTime").otherwise("String")
    )
    return rows.select(F.lit(table).alias("table_name"), "column_name", "inferred_type", suggested.alias("suggested_type"), "non_null")


def apply_schema(df: DataFrame, schema: dict[str, str] | None = None, safe: bool = False) -> DataFrame:
    """Q8: cast to the explicit types; columns not named keep their type.
    ``safe`` uses try_cast (bad values become NULL instead of failing)."""
    schema = schema or {}
    cols = []
    for f in df.schema.fields:
        if f.name in schema:
            c = F.col(f.name)
            cols.append((c.try_cast(schema[f.name]) if safe else c.cast(schema[f.name])).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_log_row(spark: SparkSession, load_id: str, ts: _dt.datetime, table: str, rows: int, status: str,
                 error: str = "") -> DataFrame:
    """Q9: the one-row load log."""
    return spark.createDataFrame([(load_id, ts, table, rows, status, error)], LOAD_LOG_SCHEMA)


def run_load(spark: SparkSession, supplier: Callable[[SparkSession], DataFrame], table: str, base_path: str,
             schema: dict[str, str] | None = None, log_path: str | None = None,
             now: _dt.datetime | None = None) -> DataFrame:
    """Q10: supplier -> schema (explicit types win) -> stamp ``load_id`` and
    ``load_timestamp`` -> append (table created when missing) -> log. An empty
    frame loads nothing and logs success with 0 rows; a failure logs 0 rows
    with the error, then re-raises. The row count comes from an observed
    metric of the write itself, not from a second pass."""
    from pyspark.sql import Observation

    load_id = str(uuid.uuid4())
    ts = now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    try:
        df = supplier(spark)
        if not isinstance(df, DataFrame):
            raise TypeError("Data supplier must return a Spark DataFrame.")
        df = apply_schema(df, schema)
        obs = Observation("load")
        stamped = df.withColumns({"load_id": F.lit(load_id), "load_timestamp": F.lit(ts).cast("timestamp_ntz")})
        sinks.append_autocreate(stamped.observe(obs, F.count(F.lit(1)).alias("rows")), table, base_path)
        rows = int(obs.get.get("rows", 0))
        log = load_log_row(spark, load_id, ts, table, rows, "success")
    except Exception as e:
        log = load_log_row(spark, load_id, ts, table, 0, "failed", str(e))
        if log_path:
            log.write.mode("append").parquet(log_path)
        raise
    if log_path:
        log.write.mode("append").parquet(log_path)
    return log
