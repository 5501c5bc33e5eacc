"""Tick-price marts (T1-T16): a minute -> 5 minute -> hour -> day rollup chain
and the daily analytics built on it.

Input ticks: ``instrument, price, timestamp, insertion_timestamp, t_dt``
(timestamps are TIMESTAMP_NTZ). Every function is DataFrame -> DataFrame and
stays in built-in expressions, so the whole chain is one Catalyst plan: the
first aggregation is partial (map-side) on the raw ticks, and every later stage
shuffles only the already-reduced bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.sinks import partitioned_write

NTZ = "timestamp_ntz"


def _trunc(unit: str, c: str | Column) -> Column:
    # date_trunc returns a session-zone TIMESTAMP; keep wall-clock NTZ values.
    return F.date_trunc(unit, c if isinstance(c, Column) else F.col(c)).cast(NTZ)


def tick_source(ticks: DataFrame) -> DataFrame:
    """The derived date column the tick table is partitioned by."""
    return ticks.withColumn("t_dt", F.to_date("timestamp"))


def write_ticks(ticks: DataFrame, path: str, mode: str = "overwrite", files_per_day: int = 8) -> None:
    """T1 layout: one folder per ``t_dt``, rows sorted by (instrument, timestamp)
    inside each file so parquet min/max stats skip row groups on both keys. A
    day is written by ``files_per_day`` tasks, so one heavy day is not one task."""
    partitioned_write(tick_source(ticks), path, ["t_dt"], ["instrument", "timestamp"],
                      files_per_partition=files_per_day, mode=mode)


def tick_minute(ticks: DataFrame) -> DataFrame:
    """Per instrument and minute: trades, avg/sum/max/min price."""
    return (
        ticks.groupBy("instrument", _trunc("minute", "timestamp").alias("ts_min"), "t_dt")
        .agg(
            F.count(F.lit(1)).alias("trades"),
            F.avg("price").alias("avg_price"),
            F.sum("price").alias("sum_price"),
            F.max("price").alias("max_price"),
            F.min("price").alias("min_price"),
        )
    )


def _bar_rollup(bars: DataFrame, ts_out: Column, name: str) -> DataFrame:
    # Average of averages is kept as written in the source marts;
    # the trade-weighted price is sum_price / trades.
    return bars.groupBy("instrument", ts_out.alias(name)).agg(
        F.sum("trades").alias("trades"),
        F.avg("avg_price").alias("avg_price"),
        F.sum("sum_price").alias("sum_price"),
        F.max("max_price").alias("max_price"),
        F.min("min_price").alias("min_price"),
    )


def tick_5min(minute: DataFrame) -> DataFrame:
    """5-minute bars from minute bars."""
    start = F.expr("timestampadd(MINUTE, -(minute(ts_min) % 5), ts_min)")
    return _bar_rollup(minute, start, "ts_5min")


def tick_hourly(five: DataFrame) -> DataFrame:
    """T4: hourly bars from 5-minute bars."""
    return _bar_rollup(five, _trunc("hour", "ts_5min"), "ts_hour")


def tick_daily(hourly: DataFrame) -> DataFrame:
    """T5: daily rows (no max/min) plus the trade-weighted ``wavg_price``."""
    return (
        hourly.groupBy("instrument", F.to_date("ts_hour").alias("ts_day"))
        .agg(
            F.sum("trades").alias("trades"),
            F.avg("avg_price").alias("avg_price"),
            F.sum("sum_price").alias("sum_price"),
        )
        .withColumn("wavg_price", F.col("sum_price") / F.col("trades"))
    )


def tick_chain(ticks: DataFrame) -> DataFrame:
    """T2 -> T5 in one plan: ticks to daily rows."""
    return tick_daily(tick_hourly(tick_5min(tick_minute(ticks))))


def tick_daily_stats(hourly: DataFrame) -> DataFrame:
    """Median and population stddev of the hourly avg price per day
    (run on hourly rows: on daily rows each group has one value, SURVEY 2.11 #3)."""
    return hourly.groupBy("instrument", F.to_date("ts_hour").alias("ts_day")).agg(
        F.median("avg_price").alias("median_price"),
        F.stddev_pop("avg_price").alias("stddev_price"),
    )


def tick_latest_price(hourly: DataFrame) -> DataFrame:
    """The avg price of the last hour of each day (deterministic anyLast)."""
    return hourly.groupBy("instrument", F.to_date("ts_hour").alias("ts_day")).agg(
        F.max_by("avg_price", "ts_hour").alias("last_avg_price")
    )


def _by_day(daily: DataFrame):
    return Window.partitionBy("instrument").orderBy("ts_day")


def tick_rolling_7d(daily: DataFrame) -> DataFrame:
    """Mean of the last 7 daily rows (ROWS frame, as in the source)."""
    w = _by_day(daily).rowsBetween(-6, Window.currentRow)
    return daily.select("instrument", "ts_day", F.avg("avg_price").over(w).alias("avg_price_7d"))


def tick_volatility_30d(daily: DataFrame) -> DataFrame:
    """Population stddev over the last 30 daily rows."""
    w = _by_day(daily).rowsBetween(-29, Window.currentRow)
    return daily.select("instrument", "ts_day", F.stddev_pop("avg_price").over(w).alias("vol_30d"))


def tick_extremes(daily: DataFrame) -> DataFrame:
    """highest/lowest daily avg price per instrument and the day of each."""
    return daily.groupBy("instrument").agg(
        F.max("avg_price").alias("max_avg_price"),
        F.min("avg_price").alias("min_avg_price"),
        F.max_by("ts_day", "avg_price").alias("max_day"),
        F.min_by("ts_day", "avg_price").alias("min_day"),
    )


def tick_deltas(daily: DataFrame) -> DataFrame:
    """Previous day's avg price and the change (NULL on the first day)."""
    prev = F.lag("avg_price", 1).over(_by_day(daily))
    return daily.select(
        "instrument",
        "ts_day",
        "avg_price",
        prev.alias("prev_day_price"),
        (F.col("avg_price") - prev).alias("delta_price"),
    )


def tick_price_drops(deltas: DataFrame, threshold_pct: float = -5.0) -> DataFrame:
    """Days whose avg price fell more than 5 % from the day before."""
    pct = F.col("delta_price") / F.col("prev_day_price") * 100
    return deltas.withColumn("drop_pct", pct).where(pct < threshold_pct)


def tick_daily_ranking(daily: DataFrame) -> DataFrame:
    """RANK of instruments by trades within each day."""
    w = Window.partitionBy("ts_day").orderBy(F.col("trades").desc())
    return daily.select("ts_day", "instrument", "trades", F.rank().over(w).alias("rank"))


def tick_daily_range(ticks: DataFrame) -> DataFrame:
    """Max - min raw price per instrument and day (grouped by t_dt, SURVEY 2.11 #1)."""
    return ticks.groupBy("instrument", F.col("t_dt").alias("ts_day")).agg(
        (F.max("price") - F.min("price")).alias("price_range")
    )


def tick_summary(daily: DataFrame) -> DataFrame:
    """Days with data, total trades and mean daily avg price."""
    return daily.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("days_count"),
        F.sum("trades").alias("total_trades"),
        F.avg("avg_price").alias("long_term_avg_price"),
    )


def tick_latency(ticks: DataFrame) -> DataFrame:
    """Milliseconds between the event and its insertion, per tick
    (narrow projection, no shuffle)."""
    a = _trunc("millisecond", "timestamp")
    b = _trunc("millisecond", "insertion_timestamp")
    return ticks.select(
        "instrument",
        "timestamp",
        "insertion_timestamp",
        F.timestamp_diff("MILLISECOND", a, b).alias("latency_ms"),
        "t_dt",
    )
