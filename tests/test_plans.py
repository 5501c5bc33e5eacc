"""Physical-plan properties that matter at scale, checked on the static plan."""

import pytest
from conftest import SF_SMALL

import __spark_entry__ as ent
from quarry.plans.registry import REGISTRY

# queries that write files while being built (their plans are read-backs)
SIDE_EFFECTS = {
    "layout_range_counts", "run_mart", "chunked_build", "mart_run_log", "load_delimited", "run_load", "load_log",
    "read_by_extension", "file_manifest", "import_folder", "relocate_prefix", "typed_rows_source",
    "append_autocreate", "append_refresh", "full_refresh_swap", "partitioned_write", "postprocess_inputs",
    "tick_minute_stream", "tick_cascade_stream", "incremental_ingest", "related_closure", "reference_closure",
}
FORBIDDEN = ["SortAggregate", "BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas"]


def _plan(spark, name):
    df = ent.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SIDE_EFFECTS))
def test_no_slow_operators(static, name):
    plan = _plan(static, name)
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, (name, bad)


def test_scan_prunes_columns(static):
    plan = _plan(static, "tick_minute")
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert schema == "struct<ts:timestamp_ntz,event_type:string,value:double>", schema


def test_tail_uses_group_limit(static):
    assert "WindowGroupLimit" in _plan(static, "tail_lines")


def test_config_side_is_broadcast(static):
    plan = _plan(static, "feed_status")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_reference_time_is_a_subquery(static):
    plan = _plan(static, "recent_errors")
    assert "Subquery" in plan and "Join" not in plan


def test_routing_is_a_projection(static):
    plan = _plan(static, "route_files")
    assert "rlike" in plan.lower() and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["suggest_types", "verify_constraints"])
def test_distinct_counts_copy_no_rows(static, name):
    assert "Expand" not in _plan(static, name)


def test_layouts_prune_months_and_push_days(static, tmp_path):
    from quarry.operators import layout as ly
    from quarry.plans import fixtures as fx
    from quarry.plans.building import RANGE
    from quarry.sources.tables import Tables

    paths = ly.write_layouts(fx.v_layout(Tables(static, SF_SMALL)), str(tmp_path))
    for name, day, _ in ly.LAYOUTS:
        plan = ly.range_count(static, name, paths[name], *RANGE)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(month" in plan and f"GreaterThanOrEqual({day}" in plan, plan


def test_a_hop_of_a_closure_is_joins_on_keys(static):
    from pyspark.sql import functions as F

    from quarry.operators import kv

    rows = static.createDataFrame([("a.x", "b"), ("b.y", "a"), ("b.z", '["c", "a"]'), ("c.w", "none")], "key string, value string")
    starts = rows.select(F.col("key").alias("start_key"))
    for closure in (kv.related_closure, kv.reference_closure):
        plan = closure(rows, starts)._jdf.queryExecution().executedPlan().toString()
        assert not [f for f in FORBIDDEN if f in plan], plan
    got = {(r.start_key, r.key) for r in kv.related_closure(rows, starts).collect()}
    assert got == {(s, k) for s in ("a.x", "b.y", "b.z") for k in ("a.x", "b.y", "b.z", "c.w")} | {("c.w", "c.w")}
