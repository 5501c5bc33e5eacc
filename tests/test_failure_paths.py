"""Failure semantics: errors are captured, logged or raised as the source does."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import marts as mt
from quarry.operators import profile as pf
from quarry.operators import replay as rp
from quarry.session import scratch_path
from quarry.sources import files as fs
from quarry.sources import sinks


def _name(base, stem):
    return stem + "_" + base.rsplit("-", 1)[1]


def test_swap_failure_leaves_target_untouched(spark):
    base = scratch_path(spark, "swapfail")
    name = _name(base, "t")
    sinks.full_refresh_swap(spark.range(3), name, base)
    bad = spark.range(5).withColumn("id", F.when(F.col("id") == 4, F.raise_error("boom")).otherwise(F.col("id")))
    with pytest.raises(Exception):
        sinks.full_refresh_swap(bad, name, base)
    assert spark.table(name).count() == 3


def test_run_mart_logs_failure_and_reraises(spark):
    base = scratch_path(spark, "martfail")
    mart = {"datamart_name": "m", "target_table": _name(base, "m"), "query": "SELECT * FROM no_such_view_xyz"}
    with pytest.raises(Exception):
        mt.run_mart(spark, mart, base, log_path=f"{base}/_log")
    log = spark.read.parquet(f"{base}/_log").first()
    assert log.status == "failed" and "no_such_view_xyz" in log.message


def test_run_load_type_error_is_logged(spark):
    base = scratch_path(spark, "loadfail")
    with pytest.raises(TypeError):
        pf.run_load(spark, lambda s: [1, 2], _name(base, "t"), base, log_path=f"{base}/_log")
    log = spark.read.parquet(f"{base}/_log").first()
    assert (log.status, log.row_count) == ("failed", 0)


def test_run_load_logs_the_whole_error(spark):
    base = scratch_path(spark, "loadlong")

    def supplier(s):
        raise ValueError("x" * 5000 + "end")

    with pytest.raises(ValueError):
        pf.run_load(spark, supplier, _name(base, "t"), base, log_path=f"{base}/_log")
    message = spark.read.parquet(f"{base}/_log").first().error_message
    assert message == "x" * 5000 + "end"


def test_run_load_empty_frame_logs_zero(spark):
    base = scratch_path(spark, "loadempty")
    log = pf.run_load(spark, lambda s: s.range(0), _name(base, "t"), base).first()
    assert (log.status, log.row_count) == ("success", 0)


def test_unsupported_extension_raises(spark):
    with pytest.raises(ValueError, match="Unsupported file type: .xlsx"):
        fs.read_by_extension(spark, "/share/sales_2026_02.xlsx")


def test_manifest_captures_missing_root(spark):
    base = scratch_path(spark, "manifestfail")
    spark.range(3).write.parquet(base)
    m = fs.file_manifest(spark, [base, base + "_nope"], regex=r"\.parquet$")
    rows = m.collect()
    assert any(r.error for r in rows) and any(r.path and r.path.endswith(".parquet") for r in rows)


def test_typed_rows_missing_path_is_empty(spark):
    df = fs.typed_rows_source(spark, "/definitely/missing/path", "a int, b string")
    assert df.count() == 0 and df.columns == ["a", "b"]


def test_strict_replay_raises_when_nothing_left(spark):
    import datetime as dt
    log = spark.createDataFrame([("t", 0, 0, dt.datetime(2024, 1, 1))],
                                "topic string, partition int, offset long, timestamp timestamp_ntz")
    with pytest.raises(ValueError):
        rp.replay_offsets_strict(log, F.lit("2025-01-01").cast("timestamp_ntz"))


def test_append_autocreate_then_append(spark):
    base = scratch_path(spark, "appendtest")
    name = _name(base, "t")
    sinks.append_autocreate(spark.range(2), name, base)
    sinks.append_refresh(spark.range(3), name, base)
    assert spark.table(name).count() == 5
