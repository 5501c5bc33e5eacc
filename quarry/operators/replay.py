"""Log replay positions (K1-K6, S7) over log records
``topic, partition, offset, timestamp, key, value``.

Everything is a per-partition aggregate (partial per task); the replay itself
joins the records to one start offset per partition. That start table has one
row per topic partition, a number fixed by the topic's configuration, so it is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["topic", "partition"]


def replay_offsets(log: DataFrame, at: Column, fallback_earliest: bool = True) -> DataFrame:
    """K1: per partition, the first offset whose record time is >= ``at``; when
    none exists, the earliest offset if ``fallback_earliest`` else NULL (the
    position stays unchanged)."""
    found = F.min(F.when(F.col("timestamp") >= at, F.col("offset")))
    agg = log.groupBy(*KEY).agg(found.alias("found_offset"), F.min("offset").alias("earliest_offset"))
    start = F.coalesce("found_offset", "earliest_offset") if fallback_earliest else F.col("found_offset")
    return agg.withColumn("start_offset", start)


def replay_offsets_strict(log: DataFrame, at: Column) -> DataFrame:
    """K2: partitions without an offset at ``at`` are dropped; if none remain,
    raise (one small action on the per-partition result)."""
    out = replay_offsets(log, at, fallback_earliest=False).where(F.col("found_offset").isNotNull())
    if out.isEmpty():
        raise ValueError("no partition has a record at or after the requested time")
    return out


def replay_earliest(log: DataFrame) -> DataFrame:
    """K3: the start of every partition."""
    return log.groupBy(*KEY).agg(F.min("offset").alias("start_offset"))


def replay_missing_report(log: DataFrame, at: Column) -> DataFrame:
    """K4: partitions with no record at or after ``at`` (left where they are)."""
    return replay_offsets(log, at, fallback_earliest=False).where(F.col("found_offset").isNull()) \
        .select(*KEY, "earliest_offset")


def replay_from(log: DataFrame, starts: DataFrame) -> DataFrame:
    """K5: records at or after the chosen start offset of their partition."""
    s = starts.select(*KEY, "start_offset").where(F.col("start_offset").isNotNull())
    j = log.join(s, KEY, "inner").where(F.col("offset") >= F.col("start_offset"))
    return j.select(*KEY, "offset", "timestamp", "key", "value")


def partition_positions(log: DataFrame) -> DataFrame:
    """K6: the next offset of every partition (max + 1)."""
    return log.groupBy(*KEY).agg((F.max("offset") + 1).alias("position"))


def decode_or_skip(log: DataFrame, schema: str) -> DataFrame:
    """Decode the JSON payload; a record that does not decode is kept with
    ``decoded = false`` and NULL fields instead of failing the job, so it can be
    reported and skipped (``where("decoded")``)."""
    wanted = T.StructType.fromDDL(schema)
    with_bad = T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json(F.col("value"), with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    fields = wanted.names
    p = log.select(*KEY, "offset", "value", parsed.alias("_p"))
    ok = F.col("_p").isNotNull() & F.col("_p._corrupt_record").isNull()
    return p.select(*KEY, "offset", *[F.col("_p").getField(f).alias(f) for f in fields], ok.alias("decoded"))
