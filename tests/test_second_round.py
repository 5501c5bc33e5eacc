"""Scale and correctness cases beyond the small tables: many files, rules and checks, late
ticks, unlisted names, typed bounds, swaps with a new schema, runs that fail."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import ingest as ig
from quarry.operators import kv
from quarry.operators import marts as mt
from quarry.operators import monitoring as mo
from quarry.operators import quality as qa
from quarry.operators import replay as rp
from quarry.session import scratch_path, shared_dir
from quarry.sources import files as fs
from quarry.sources import sinks
from quarry.streaming import ingest as ist
from quarry.streaming import ticks as tst

CHECKS = "table_name string, field string, check string, expected string"


def test_ranks_of_many_files_with_a_hot_target(spark):
    n = 100_000
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 97).cast("string")))
    df = spark.range(n).select(g.alias("g"), (F.col("id") * 7919 % n).alias("o"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"))
    ranked = ig.rank_within(df, "g", "o").withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert ranked.count() == n and ranked.where("_rank <> want").count() == 0


def test_three_hundred_rules_and_ties(spark):
    files = spark.createDataFrame([(f"/in/f{i}_x.csv", i) for i in range(0, 400, 7)], "file_path string, file_order long")
    rows = [(i, f"f{i}_", f"t{i}") for i in range(300)] + [(7, "f7_x", "zz"), (None, "f399", "none"), (5, None, "bad")]
    rules = spark.createDataFrame(rows, "rule_order int, regex string, target_table string").repartition(5)
    got = {r.file_order: r.target_table for r in ig.route_files(files, rules).collect()}
    assert got == {i: (f"t{i}" if i < 300 else "none" if i == 399 else None) for i in range(0, 400, 7)}


def test_more_checks_than_one_pass(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "v long")
    n = 2 * qa.CHECKS_PER_PASS + 50
    cons = spark.createDataFrame([("t", "v", "max", str(i)) for i in range(n)], CHECKS)
    got = {r.expected: r.passes for r in qa.verify_constraints(df, cons, "t").collect()}
    assert len(got) == n and sum(got.values()) == n - 9
    assert qa.verify_constraints(df, cons.where("false"), "t").count() == 0


def test_typed_bounds_and_unmeasured_checks(spark):
    df = spark.createDataFrame([(dt.date(1980, 1, 1), "aaa", None), (dt.date(1990, 5, 5), "bcd", None)], "d date, s string, n int")
    want = {("d", "min", "1985-01-01"): False, ("d", "min", "1979-12-31"): True, ("d", "max", "1990-05-05"): True, ("d", "max", "soon"): False,
            ("s", "min", "bbb"): False, ("s", "max", "bcd"): True, ("s", "rex", "^[a-z]+$"): True, ("s", "rex", '^"a'): False,
            ("s", "sign", "positive"): False, ("n", "min", "0"): False, ("n", "max_nulls", "2"): True}
    cons = spark.createDataFrame([("t", *k) for k in want], CHECKS)
    res = qa.verify_constraints(df, cons, "t")
    assert {(r.field, r.check, r.expected): r.passes for r in res.collect()} == want
    details = [json.loads(r.details_json) for r in qa.quality_details(res).collect()]
    assert {d["expected"] for d in details} == {k[2] for k in want} and all(isinstance(d["passes"], bool) for d in details)


def test_a_late_tick_is_counted(spark):
    base = scratch_path(spark, "late")
    schema = "instrument string, timestamp timestamp_ntz, price double, t_dt date"
    day = dt.datetime(2024, 1, 1)
    for hour, minute in ((10, 0), (12, 0), (13, 0), (10, 5), (10, 0)):
        at = day + dt.timedelta(hours=hour, minutes=minute, seconds=30)
        spark.createDataFrame([("A", at, float(minute + hour), day.date())], schema).write.mode("append").parquet(f"{base}/in")
        tst.run_minute_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/bars", f"{base}/_ckpt")
    bars = {r.ts_min.strftime("%H:%M"): (r.trades, r.avg_price) for r in tst.current_minute_bars(spark, f"{base}/bars").collect()}
    assert bars == {"10:00": (2, 10.0), "12:00": (1, 12.0), "13:00": (1, 13.0), "10:05": (1, 15.0)}


def test_pivots_keep_every_name(spark):
    rows = spark.createDataFrame([("m", "p_a", 1), ("m", "p_zz", 2), ("n", "p_a", 3), ("n", "q_b", 4)], "entity string, key string, value int")
    assert kv.prefix_to_wide(rows, "p_").columns == ["entity", "a", "zz"]
    feeds = spark.createDataFrame([("new", dt.datetime(2024, 1, 1), 1.0), ("old", dt.datetime(2024, 1, 1), 2.0)], "name string, last_refresh timestamp_ntz, latency double")
    assert mo.latency_heatmap(feeds).columns == ["time", "new", "old"]


def test_swap_takes_a_new_schema_and_removes_old_folders(spark):
    base = scratch_path(spark, "swap")
    name = "swap_" + base.rsplit("-", 1)[1]
    sinks.full_refresh_swap(spark.range(3), name, base)
    sinks.full_refresh_swap(spark.range(2).selectExpr("id as k", "'x' as s"), name, base)
    assert spark.table(name).columns == ["k", "s"] and spark.table(name).count() == 2
    with pytest.raises(Exception):
        sinks.full_refresh_swap(spark.range(2).select(F.raise_error(F.lit("broken")).alias("k")), name, base)
    assert spark.table(name).count() == 2 and len(os.listdir(f"{base}/{name}")) == 1
    spark.sql(f"DROP TABLE {name}")


def test_chunk_counts_follow_the_bounds(spark):
    df = spark.createDataFrame([(0,), (5,), (100,), (None,)], "k long")
    assert mt.chunk_count(df, "k", 10) == 11 and mt.chunk_count(df.where("k is null"), "k", 10) == 0
    big = spark.createDataFrame([(2**60,), (2**60 + 9,), (2**60 + 10,)], "k long")
    assert {r._chunk for r in mt.with_chunk_id(big, "k", 10).collect()} == {0, 1}


def test_decode_with_nested_and_decimal_fields(spark):
    log = spark.createDataFrame([("t", 0, 0, '{"a": 1.25, "m": {"x": 2}, "b": [1, 2]}'), ("t", 0, 1, "no json")],
                                "topic string, partition int, offset long, value string")
    got = {r.offset: r for r in rp.decode_or_skip(log, "a decimal(10,2), m struct<x:int,y:string>, b array<int>").collect()}
    assert float(got[0].a) == 1.25 and got[0].m.x == 2 and got[0].b == [1, 2] and got[0].decoded and not got[1].decoded


def test_relocated_keys_start_with_the_prefix(spark):
    m = spark.createDataFrame([("/a/b/x.csv",), ("/z/a/b/x.csv",), ("/a/b'c/y.csv",)], "path string")
    got = {r.path: r.dest_path for r in fs.relocate_keys(m, "/a/b", "/new").collect()}
    assert got == {"/a/b/x.csv": "/new/x.csv", "/a/b'c/y.csv": "/new'c/y.csv"}


def test_a_run_whose_files_all_fail_raises_and_quarantines(spark):
    base = scratch_path(spark, "allfail")
    os.makedirs(f"{base}/inbox")
    for name in ("one.bin", "two.bin"):
        with open(f"{base}/inbox/{name}", "w") as f:
            f.write("x\n")
    rules = spark.createDataFrame([(1, ".*", "public.t")], "rule_order int, regex string, target_table string")
    with pytest.raises(RuntimeError, match="all 2 files"):
        ist.run_incremental(spark, f"{base}/inbox", rules, f"{base}/out", f"{base}/_ckpt", "2024-01-01 00:00:00")
    assert spark.read.parquet(f"{base}/out/ledger").where("status = 'FAILED'").count() == 2
    assert spark.read.text(f"{base}/out/quarantine").where("value <> ''").count() == 2


def test_shared_folder_leaves_static_settings_alone(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
