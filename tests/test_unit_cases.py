"""Golden unit cases worked out from the source's printed examples
(FIXTURES.md part C) and the SURVEY 2.11 decisions."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quarry.functions.quantities import cpu_cores, memory_bytes
from quarry.functions.text import dict_lookup, glob_to_regex, list_literal
from quarry.operators import ingest as ig
from quarry.operators import kv
from quarry.operators import marts as mt
from quarry.operators import monitoring as mo
from quarry.operators import profile as pf
from quarry.operators import quality as qa


def test_1_dict_lookup(spark):
    rows = [(1, '{"key1": "A", "key2": "B"}', "key1"), (2, '{"key1": "C", "key2": "D"}', "key2"),
            (3, None, "key1"), (4, "hello", "key1"), (5, "123", "key2")]
    df = spark.createDataFrame(rows, "id int, dict_column string, filter_key string")
    got = [r.v for r in df.orderBy("id").select(dict_lookup(F.col("dict_column"), F.col("filter_key")).alias("v")).collect()]
    assert got == ["A", "D", None, None, None]


def test_1b_single_quoted_dict(spark):
    df = spark.createDataFrame([("{'a': 'x'}", "a")], "d string, k string")
    assert df.select(dict_lookup(F.col("d"), F.col("k")).alias("v")).first().v == "x"


def _kv(spark, d):
    def txt(v):
        if isinstance(v, list):
            return "[" + ", ".join(f'"{x}"' for x in v) + "]"
        return str(v)
    return spark.createDataFrame([(k, txt(v)) for k, v in d.items()], "key string, value string")


def _starts(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "start_key string")


def test_2_closure_missing_start_is_empty(spark):
    d = {"user.name": "Alice", "user.age": 30, "user.city": "Paris", "product.name": "Laptop",
         "ignore.this": "x", "user.preferences.color": "blue", "ignore.other": "y"}
    out = kv.related_closure(_kv(spark, d), _starts(spark, "user"), ["ignore.*", "product.*"])
    assert out.count() == 0


def test_3_closure_through_reference_and_list(spark):
    d = {"a.x": "b", "b.y": ["c", "z"], "c.w": 1, "d.v": 2}
    out = kv.related_closure(_kv(spark, d), _starts(spark, "a.x"))
    assert sorted(r.key for r in out.collect()) == ["a.x", "b.y", "c.w"]


def test_closure_cycle_and_idempotent(spark):
    d = {"a.x": "b", "b.y": "a", "c.z": "a"}
    out = kv.related_closure(_kv(spark, d), _starts(spark, "a.x"))
    keys = sorted(r.key for r in out.collect())
    assert keys == ["a.x", "b.y"]
    # closing the result again adds nothing
    again = kv.related_closure(out.select("key", "value"), _starts(spark, "a.x"))
    assert sorted(r.key for r in again.collect()) == keys


def test_closure_excluded_key_not_expanded(spark):
    d = {"a.x": "b", "b.y": "c", "b.skip": "d", "c.v": 1, "d.v": 2}
    out = kv.related_closure(_kv(spark, d), _starts(spark, "a.x"), ["b.skip"])
    assert sorted(r.key for r in out.collect()) == ["a.x", "b.y", "c.v"]


def test_reference_closure_whole_keys(spark):
    d = {"start": "k1", "k1": ["k2", "nope"], "k2": "start", "k3": 1}
    out = kv.reference_closure(_kv(spark, d), _starts(spark, "start"))
    assert sorted(r.key for r in out.collect()) == ["k1", "k2", "start"]


def test_4_strip_prefix(spark):
    d = {"user.name": "Alice", "user.age": "30", "user.city": "Paris", "product.name": "Laptop",
         "ignore.this": "should be excluded"}
    tree = spark.createDataFrame([("e", [k], v) for k, v in d.items()], "entity string, path array<string>, value string")
    out = kv.strip_prefix(tree, "user.", ["ignore.*"])
    assert sorted(r.path[0] for r in out.collect()) == ["age", "city", "name", "product.name"]
    m = spark.createDataFrame([(d,)], "m map<string,string>")
    got = m.select(kv.strip_prefix_map(F.col("m"), "user.", ["ignore.*"]).alias("m")).first().m
    assert sorted(got) == ["age", "city", "name", "product.name"]


def test_prune_drops_nested_and_empty(spark):
    rows = [("e", ["a", "ignore.x"], "1"), ("e", ["a", "keep"], "2"), ("e", ["b", "ignore.y"], "3")]
    tree = spark.createDataFrame(rows, "entity string, path array<string>, value string")
    out = kv.prune_by_glob(tree, ["ignore.*"]).collect()
    assert [(r.path, r.value) for r in out] == [(["a", "keep"], "2")]  # 'b' left empty: gone


def test_5_prefix_to_wide(spark):
    d = {"price_AAPL": 150, "price_GOOG": 2800, "price_MSFT": 299, "volume_AAPL": 1000, "volume_GOOG": 2000}
    df = spark.createDataFrame([("m", k, v) for k, v in d.items()], "entity string, key string, value long")
    r = kv.prefix_to_wide(df, "price_", ["AAPL", "GOOG", "MSFT"]).first()
    assert (r.AAPL, r.GOOG, r.MSFT) == (150, 2800, 299)


def test_6_nesting_and_references(spark):
    d = {"user.name": "John Doe", "user.age": "30", "user.hobbies": '["reading", "traveling", "coding"]',
         "address.city": "New York", "address.zip": "10001", "reading.property": "value for reading",
         "coding.difficulty": "high", "traveling.destination": "Japan"}
    df = spark.createDataFrame(list(d.items()), "key string, value string")
    nested = {r.group: r.json for r in kv.nested_json(df).collect()}
    assert set(nested) == {"user", "address", "reading", "coding", "traveling"}
    assert json.loads(nested["user"]) == {"name": "John Doe", "age": "30", "hobbies": ["reading", "traveling", "coding"]}
    deep = spark.createDataFrame([("user.name", "John"), ("user.addr.city", "X"), ("a", "1"), ("a.b", "2"), ("c", "3")], "key string, value string")
    assert {r.group: json.loads(r.json) for r in kv.nested_json(deep).collect()} == {
        "user": {"name": "John", "addr": {"city": "X"}}, "a": {"": "1", "b": "2"}, "c": "3"}
    res = kv.resolve_references(df)
    assert {r.group for r in res.collect()} == {"user", "address", "reading", "coding", "traveling"}


def test_resolve_dotted_reference(spark):
    df = spark.createDataFrame([("x.ref", "a.b"), ("a.b.c", "1")], "key string, value string")
    got = {(r.group, r.subpath) for r in kv.resolve_references(df).collect()}
    assert ("a.b", "c") in got and ("a", "b.c") in got and ("x", "ref") in got


def test_list_literal(spark):
    df = spark.createDataFrame([('["a","b"]',), ("plain",), ("[broken",), ("[not json]",)], "v string")
    got = [r.l for r in df.select(list_literal(F.col("v")).alias("l")).collect()]
    assert got == [["a", "b"], ["plain"], ["[broken"], ["[not json]"]]


def test_7_status_colours(spark):
    df = spark.createDataFrame([(5.0,), (5.1,), (10.0,), (10.1,)], "latency double")
    c = mo.status_colour(F.col("latency"), F.lit(5), F.lit(10))
    assert [r.s for r in df.select(c.alias("s")).collect()] == ["green", "orange", "orange", "red"]


def test_thresholds_upsert_and_default(spark):
    cur = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "name string, warning int, critical int")
    edit = spark.createDataFrame([("b", 30, 40)], "name string, warning int, critical int")
    up = {r.name: (r.warning, r.critical) for r in mo.upsert_thresholds(cur, edit).collect()}
    assert up == {"a": (1, 2), "b": (30, 40)}
    rows = spark.createDataFrame([("a",), ("z",)], "name string")
    th = {r.name: (r.warning, r.critical) for r in mo.feed_thresholds(rows, cur).collect()}
    assert th == {"a": (1, 2), "z": (5, 10)}


def test_8_delimited_short_and_long(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("1;x;y\n2;x\n3;x;y;z\n")
    out = qa.load_delimited(spark, str(p), ["a", "b", "c"], sep=";").orderBy("a").collect()
    assert [(r.a, r.b, r.c) for r in out] == [("1", "x", "y"), ("2", "x", None)]


def test_parse_control(spark):
    df = spark.createDataFrame([("LOAD fields terminated by '|' optionally enclosed by '~'",), ("LOAD",)], "c string")
    sep, q = qa.parse_control(F.col("c"))
    assert [(r.s, r.q) for r in df.select(sep.alias("s"), q.alias("q")).collect()] == [("|", "~"), (",", '"')]


def test_9_quantities(spark):
    df = spark.createDataFrame([("250m", "512Mi"), ("1500000n", "100"), ("2", "1Gi"), ("x", "5M")], "c string, m string")
    got = [(r.c, r.m) for r in df.select(cpu_cores(F.col("c")).alias("c"), memory_bytes(F.col("m")).alias("m")).collect()]
    assert [round(g[0], 9) if g[0] is not None else None for g in got] == [0.25, 0.0015, 2.0, None]
    assert [g[1] for g in got] == [536870912, 100, 1073741824, None]


def test_10_loader_sample_types(spark):
    rows = [(1, "US", 100.5, True, dt.datetime(2023, 1, 1)), (2, "EU", 200.0, False, dt.datetime(2023, 2, 15)),
            (3, "US", 150.75, True, dt.datetime(2023, 3, 10))]
    df = spark.createDataFrame(rows, "user_id long, region string, amount double, active boolean, signup_date timestamp_ntz")
    got = {r.column_name: r.suggested_type for r in pf.suggest_types(df, "users").collect()}
    assert got == {"user_id": "UInt8", "region": "String", "amount": "Float64", "active": "UInt8",
                   "signup_date": "DateTime"}
    assert dict(pf.infer_types(df))["user_id"] == "Int64"


def test_negative_ints_use_both_bounds(spark):
    df = spark.createDataFrame([(-1,), (300,)], "v long")
    assert pf.suggest_types(df, "t").first().suggested_type == "Int16"


def test_11_chunks(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "c long")
    got = [(r.chunk_start, r.chunk_end) for r in mt.chunk_bounds(df, "c", 4).orderBy("chunk_id").collect()]
    assert got == [(1, 5), (5, 9), (9, 13)]
    empty = spark.createDataFrame([], "c long")
    assert mt.chunk_bounds(empty, "c", 4).count() == 0


def test_chunk_ids_partition_rows_and_keep_nulls(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)] + [(None,)], "c long")
    counts = {r.chunk_id: r.rows for r in mt.chunked_build_counts(df, "c", 4).collect()}
    assert counts == {0: 4, 1: 4, 2: 2, None: 1}


def test_grid_cells(spark):
    df = spark.createDataFrame([(1, 1), (9, 1)], "a long, b long")
    cells = mt.grid_boxes(df, ["a", "b"], 4).collect()
    assert len(cells) == 3 and sum(r.rows for r in cells) == 2


def test_12_routing(spark):
    files = spark.createDataFrame([("/share/sales_2026_01.csv", 1), ("/share/other.csv", 2)], "file_path string, file_order long")
    rules = spark.createDataFrame([(1, "^sales_.*", "public.sales"), (2, "^customers_.*", "public.customers")],
                                  "rule_order int, regex string, target_table string")
    got = {r.file_path: r.target_table for r in ig.route_files(files, rules).collect()}
    assert got == {"/share/sales_2026_01.csv": "public.sales", "/share/other.csv": None}


def test_readiness(spark):
    cfg = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["x"])], "datamart_name string, depends_on array<string>")
    log = spark.createDataFrame([("a", "success", dt.datetime(2024, 1, 1)), ("x", "failed", dt.datetime(2024, 1, 1))],
                                "datamart_name string, status string, end_time timestamp_ntz")
    got = {r.datamart_name: r.ready for r in mt.mart_readiness(cfg, log).collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_glob_regex():
    import re
    for g, s, ok in [("ignore.*", "ignore.this", True), ("ignore.*", "ignoreXthis", False),
                     ("r?.peer", "r1.peer", True), ("a[!b]c", "abc", False), ("a[!b]c", "axc", True)]:
        assert bool(re.match(glob_to_regex(g), s)) == ok, (g, s)


def test_node_rollup_nested_form(spark):
    from quarry.operators import cluster as cl
    nodes = spark.createDataFrame([("n1", 4.0, 8, 3.6, 7), ("n2", 4.0, 8, 3.6, 7)],
                                  "node string, cpu_capacity double, mem_capacity long, "
                                  "cpu_allocatable double, mem_allocatable long")
    c = spark.createDataFrame(
        [("ns", "p2", "n1", "c1", "100m", "200m", "1Mi", "2Mi", "50m", "1Ki", True),
         ("ns", "p1", "n1", "c1", "100m", "200m", "1Mi", "2Mi", "50m", "1Ki", False),
         ("ns", "p3", None, "c1", "100m", "200m", "1Mi", "2Mi", "50m", "1Ki", True)],
        "namespace string, pod string, node string, container string, cpu_request string, cpu_limit string, "
        "mem_request string, mem_limit string, cpu_usage string, mem_usage string, ready boolean")
    got = {r.node: [p.pod for p in r.pods] for r in cl.node_rollup(nodes, c, c).collect()}
    assert got == {"n1": ["p1", "p2"], "n2": []}  # sorted pods; an empty node keeps []; unplaced pod skipped
    ready = {r.pod: r.ready for r in cl.pod_readiness(c).collect()}
    assert ready == {"p1": False, "p2": True, "p3": True}


def test_relocate_keys_keeps_relative_key(spark):
    from quarry.sources.files import relocate_keys
    m = spark.createDataFrame([("s3a://prod/data/parquet/a/x.parquet",), ("s3a://prod/other/y",)], "path string")
    got = [(r.path, r.dest_path) for r in relocate_keys(m, "data/parquet/", "s3a://stage/data/parquet/").collect()]
    assert got == [("s3a://prod/data/parquet/a/x.parquet", "s3a://stage/data/parquet/a/x.parquet")]


def test_generate_rows_is_repeatable(spark):
    from quarry.operators.layout import generate_rows
    a = generate_rows(spark, 1000).collect()
    b = generate_rows(spark, 1000).collect()
    assert a == b and len({r.sensor_id for r in a}) == 1000 and len({r.event_date for r in a}) == 365


def test_rebuild_json_after_pruning(spark):
    import json
    rows = [("e", ["user.name"], "Alice"), ("e", ["prefs", "color"], "blue"), ("e", ["prefs", "ignore.x"], "1"),
            ("e", ["ignore.all", "y"], "2"), ("f", ["q"], 'say "hi"')]
    tree = spark.createDataFrame(rows, "entity string, path array<string>, value string")
    got = {r.entity: json.loads(r.json) for r in kv.rebuild_json(kv.prune_by_glob(tree, ["ignore.*"])).collect()}
    assert got == {"e": {"user.name": "Alice", "prefs": {"color": "blue"}}, "f": {"q": 'say "hi"'}}
    stripped = {r.entity: json.loads(r.json) for r in kv.rebuild_json(kv.strip_prefix(tree, "user.", ["ignore.*"])).collect()}
    assert stripped["e"] == {"name": "Alice", "prefs": {"color": "blue"}}
