import datetime as dt

import pytest
from conftest import SF_SMALL
from oracle_util import assert_matches_oracle
from pyspark.sql import functions as F

from quarry.operators import ticks as tk

TICK_QUERIES = [
    "tick_source", "tick_minute", "tick_5min", "tick_hourly", "tick_daily", "tick_daily_stats",
    "tick_latest_price", "tick_rolling_7d", "tick_volatility_30d", "tick_extremes", "tick_deltas",
    "tick_price_drops", "tick_daily_ranking", "tick_daily_range", "tick_summary", "tick_latency",
    # stream = batch: the streams are checked with the batch statements
    "tick_minute_stream", "tick_cascade_stream",
]


@pytest.mark.parametrize("name", TICK_QUERIES)
def test_tick_oracle(spark, duck, name):
    assert_matches_oracle(spark, duck(SF_SMALL), name, SF_SMALL)


def _ticks(spark, rows):
    df = spark.createDataFrame(rows, "instrument string, price double, timestamp timestamp_ntz")
    return df.withColumn("insertion_timestamp", F.col("timestamp")).withColumn("t_dt", F.to_date("timestamp"))


def test_minute_to_day_chain(spark):
    t = dt.datetime
    rows = [
        ("A", 10.0, t(2024, 1, 1, 9, 0, 1)),
        ("A", 20.0, t(2024, 1, 1, 9, 0, 50)),
        ("A", 30.0, t(2024, 1, 1, 9, 7, 0)),
        ("A", 40.0, t(2024, 1, 2, 9, 0, 0)),
    ]
    ticks = _ticks(spark, rows)
    minute = {(r.ts_min.minute, r.t_dt.day): r for r in tk.tick_minute(ticks).collect()}
    assert minute[(0, 1)].trades == 2 and minute[(0, 1)].avg_price == 15.0
    five = {r.ts_5min: r for r in tk.tick_5min(tk.tick_minute(ticks)).collect()}
    assert t(2024, 1, 1, 9, 5) in five and five[t(2024, 1, 1, 9, 5)].avg_price == 30.0
    daily = {r.ts_day.day: r for r in tk.tick_chain(ticks).collect()}
    # average of the two 5-minute averages (15, 30), not of the 3 ticks
    assert daily[1].avg_price == 22.5 and daily[1].trades == 3
    assert daily[1].wavg_price == 20.0
    assert daily[2].sum_price == 40.0


def test_deltas_first_day_is_null_and_drops(spark):
    daily = spark.createDataFrame(
        [("A", dt.date(2024, 1, d), p) for d, p in [(1, 100.0), (2, 94.0), (3, 95.0)]],
        "instrument string, ts_day date, avg_price double",
    )
    deltas = {r.ts_day.day: r for r in tk.tick_deltas(daily).collect()}
    assert deltas[1].prev_day_price is None and deltas[1].delta_price is None
    drops = tk.tick_price_drops(tk.tick_deltas(daily)).collect()
    assert [r.ts_day.day for r in drops] == [2] and round(drops[0].drop_pct, 6) == -6.0


def test_rank_ties(spark):
    daily = spark.createDataFrame(
        [("A", dt.date(2024, 1, 1), 5), ("B", dt.date(2024, 1, 1), 5), ("C", dt.date(2024, 1, 1), 3)],
        "instrument string, ts_day date, trades long",
    )
    r = {x.instrument: x.rank for x in tk.tick_daily_ranking(daily).collect()}
    assert r == {"A": 1, "B": 1, "C": 3}


def test_latency_ms(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    df = spark.createDataFrame([("A", 1.0, t, t + dt.timedelta(milliseconds=250))],
                               "instrument string, price double, timestamp timestamp_ntz, insertion_timestamp timestamp_ntz")
    df = df.withColumn("t_dt", F.to_date("timestamp"))
    assert tk.tick_latency(df).first().latency_ms == 250


def test_write_ticks_partitioned(spark, tmp_path):
    t = dt.datetime
    ticks = _ticks(spark, [("A", 1.0, t(2024, 1, 1)), ("B", 2.0, t(2024, 1, 2))]).drop("t_dt")
    out = str(tmp_path / "ticks")
    tk.write_ticks(ticks, out)
    back = spark.read.parquet(out).where(F.col("t_dt") == dt.date(2024, 1, 2))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and back.count() == 1
