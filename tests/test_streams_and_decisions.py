"""Streams (rerun adds nothing), and SURVEY 2.11 decisions not covered elsewhere."""

import datetime as dt
import glob
import os

from conftest import SF_SMALL
from pyspark.sql import functions as F

from quarry.operators import quality as qa
from quarry.operators import replay as rp
from quarry.plans import fixtures as fx
from quarry.session import scratch_path
from quarry.sources.tables import Tables
from quarry.streaming import ingest as ist
from quarry.streaming import ticks as tst


def test_incremental_ingest_second_run_adds_nothing(spark):
    t = Tables(spark, SF_SMALL)
    base = scratch_path(spark, "f12-test")
    inbox, out, ckpt = f"{base}/inbox", f"{base}/out", f"{base}/_ckpt"
    rules = spark.createDataFrame([(1, "part-.*", "public.docs")], "rule_order int, regex string, target_table string")
    t.documents.select("source", "text").write.partitionBy("source").text(inbox)
    ist.run_incremental(spark, inbox, rules, out, ckpt, fx.RUN_TS)
    first = spark.read.parquet(f"{out}/rows").count()
    ledger1 = spark.read.parquet(f"{out}/ledger").count()
    ist.run_incremental(spark, inbox, rules, out, ckpt, fx.RUN_TS)
    assert spark.read.parquet(f"{out}/rows").count() == first
    assert spark.read.parquet(f"{out}/ledger").count() == ledger1
    # the same content landing again under new names is skipped as already loaded
    t.documents.select("source", "text").write.mode("append").partitionBy("source").text(inbox)
    ist.run_incremental(spark, inbox, rules, out, ckpt, fx.RUN_TS)
    assert spark.read.parquet(f"{out}/rows").count() == first


def test_cascade_partitions_by_output_day(spark):
    """2.11 #4: marts are partitioned by their own output timestamp's date."""
    t = Tables(spark, SF_SMALL)
    base = scratch_path(spark, "t18-test")
    ticks = fx.v_ticks(t)
    land = f"{base}/landing"
    ticks.write.parquet(land)
    stream = spark.readStream.schema(ticks.schema).parquet(land)
    tst.run_cascade_stream(stream, f"{base}/marts", f"{base}/_ckpt")
    for name in ("five", "hourly", "daily"):
        parts = {os.path.basename(p) for p in glob.glob(f"{base.removeprefix('file://')}/marts/{name}/runs/*/_day=*")}
        assert len(parts) == ticks.select("t_dt").distinct().count()


def test_zero_actual_is_a_measured_value(spark):
    """2.11 #17: an actual value of 0 is reported as 0, not as missing."""
    df = spark.createDataFrame([(1,), (2,)], "v long")
    cons = spark.createDataFrame([("t", "v", "max_nulls", "0"), ("t", "v", "no_duplicates", "true")],
                                 "table_name string, field string, check string, expected string")
    res = {r.check: r for r in qa.verify_constraints(df, cons, "t").collect()}
    assert res["max_nulls"].actual == 0.0 and res["max_nulls"].passes
    det = {r.check_type: r for r in qa.quality_details(qa.verify_constraints(df, cons, "t")).collect()}
    assert det["max_nulls"].actual_value == "0.0000" and det["max_nulls"].passes == "Y"


def test_replay_time_is_utc(spark):
    """2.11 #22: the replay time is read as UTC whatever the machine zone."""
    log = spark.createDataFrame(
        [("t", 0, 0, dt.datetime(2024, 1, 1, 10, 0)), ("t", 0, 1, dt.datetime(2024, 1, 1, 12, 0))],
        "topic string, partition int, offset long, timestamp timestamp_ntz")
    at = F.lit("2024-01-01 11:00:00").cast("timestamp_ntz")
    r = rp.replay_offsets(log, at).first()
    assert r.found_offset == 1 and r.start_offset == 1
    none = rp.replay_offsets(log, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).first()
    assert none.found_offset is None and none.start_offset == 0
    strict = rp.replay_missing_report(log, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).count()
    assert strict == 1
