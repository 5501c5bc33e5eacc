"""Streaming tick marts.

T17 keeps minute bars up to date as ticks arrive: each micro-batch adds its partial bars to a
run store (a retried batch adds nothing), reading merges them, and full tiers of runs are
merged, so the files read stay few however many batches came. Ticks may be late by any time.

T18 refreshes the 5-minute, hourly and daily marts level by level. The raw ticks of a batch
are read once, for its minute bars. Averages of averages cannot be merged from partial rows, so
at each level the bars touched by the batch are computed anew from the stored bars of the level
below: touched minutes give touched 5-minute bars, these give touched hours, these give days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import ticks as tk
from quarry.streaming.store import DAY, RunStore, added_up, newest

NTZ = "timestamp_ntz"
MINUTE = "instrument string, ts_min timestamp_ntz, t_dt date, trades bigint, sum_price double, max_price double, min_price double"
BARS = "instrument string, {0} timestamp_ntz, trades bigint, avg_price double, sum_price double, max_price double, min_price double"
BAR_VALUES = ["trades", "avg_price", "sum_price", "max_price", "min_price"]
DAILY = "instrument string, ts_day date, trades bigint, avg_price double, sum_price double, wavg_price double"


def partial_minute_bars(ticks: DataFrame) -> DataFrame:
    """One batch's share of the minute bars: counts, sums and extremes, which add up exactly."""
    return ticks.groupBy("instrument", F.date_trunc("minute", "timestamp").cast(NTZ).alias("ts_min"), "t_dt").agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("price").alias("sum_price"),
        F.max("price").alias("max_price"),
        F.min("price").alias("min_price"),
    )


def minute_store(spark: SparkSession, out: str) -> RunStore:
    """Partial minute bars, which add up."""
    return RunStore(spark, out, MINUTE, "ts_min", added_up(["instrument", "ts_min", "t_dt"], ["trades", "sum_price"], ["max_price"], ["min_price"]))


def mart_stores(spark: SparkSession, marts_path: str) -> dict[str, RunStore]:
    """The marts of T18, by name; each bar's latest version counts."""
    def bars(name: str, ts: str) -> RunStore:
        return RunStore(spark, f"{marts_path}/{name}", BARS.format(ts), ts, newest(["instrument", ts], BAR_VALUES))

    daily = RunStore(spark, f"{marts_path}/daily", DAILY, "ts_day", newest(["instrument", "ts_day"], ["trades", "avg_price", "sum_price", "wavg_price"]))
    return {"minute": minute_store(spark, f"{marts_path}/minute"), "five": bars("five", "ts_5min"), "hourly": bars("hourly", "ts_hour"), "daily": daily}


def run_minute_stream(ticks: DataFrame, out: str, checkpoint: str) -> None:
    """Run T17 over everything available now. No state is kept between batches, so a tick
    counts however late it arrives."""
    store = minute_store(ticks.sparkSession, out)

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.append(partial_minute_bars(batch), batch_id)
        store.compact()

    q = (ticks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def with_average(bars: DataFrame) -> DataFrame:
    """Minute bars as T2 gives them, from added-up ones."""
    return bars.select("instrument", "ts_min", "t_dt", "trades", (F.col("sum_price") / F.col("trades")).alias("avg_price"),
                       "sum_price", "max_price", "min_price")


def current_minute_bars(spark: SparkSession, out: str) -> DataFrame:
    """Every minute bar, merged from the runs that count."""
    return with_average(minute_store(spark, out).read())


def _period(period: str, ts: str) -> Column:
    return F.expr(f"timestampadd(MINUTE, -(minute({ts}) % 5), date_trunc('minute', {ts}))") if period == "5min" else F.date_trunc(period, ts)


def _touched(store: RunStore, run: DataFrame, period: str, ts: str) -> DataFrame:
    """The stored bars of ``store`` in the periods that the rows of ``run`` lie in: an equi
    semi-join on day, instrument and period, so that only the touched days' folders are read."""
    keys = run.select(DAY, "instrument", _period(period, ts).alias("_period")).distinct()
    held = store.stored_rows().withColumn("_period", _period(period, ts))
    return store.merge(held.join(keys, [DAY, "instrument", "_period"], "left_semi"))


def refresh_marts(spark: SparkSession, batch: DataFrame, batch_id: int, marts_path: str) -> None:
    """T18 for one micro-batch. A retry goes on where the first attempt stopped: a level that
    holds the batch is left as it is, and what the batch touched there is read from its run."""
    stores = mart_stores(spark, marts_path)
    run = stores["minute"].append(partial_minute_bars(batch), batch_id)
    minutes = _touched(stores["minute"], run, "5min", "ts_min")
    run = stores["five"].append(tk.tick_5min(with_average(minutes)), batch_id)
    fives = _touched(stores["five"], run, "hour", "ts_5min")
    run = stores["hourly"].append(tk.tick_hourly(fives), batch_id)
    hours = _touched(stores["hourly"], run, "day", "ts_hour")
    stores["daily"].append(tk.tick_daily(hours), batch_id)
    for store in stores.values():  # only now: a retry may need the batch's own runs until here
        store.compact()


def current_mart(spark: SparkSession, marts_path: str, name: str) -> DataFrame:
    """A mart of T18: ``five``, ``hourly`` or ``daily`` (``minute``: added-up minute bars)."""
    return mart_stores(spark, marts_path)[name].read()


def run_cascade_stream(ticks: DataFrame, marts_path: str, checkpoint: str) -> None:
    """Run T18 over everything available now."""
    spark = ticks.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        refresh_marts(spark, batch, batch_id, marts_path)

    q = (ticks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
