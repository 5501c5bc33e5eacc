"""Chunked inserts (M4, M9): all rows arrive, a failed run resumes at the chunks not committed."""

import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators import marts as mt
from quarry.session import scratch_path


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _files(insert, schema):
    return {(r[0], r[1]) for r in insert._held(schema).select("_chunk", F.col("_metadata.file_path")).distinct().collect()}


def test_a_killed_insert_goes_on_with_unfinished_chunks(spark, monkeypatch):
    df = spark.range(1000).select(F.when(F.col("id") % 50 == 7, None).otherwise(F.col("id")).alias("k"), (F.col("id") * 3).alias("v"))
    insert = mt.ChunkedInsert(spark, scratch_path(spark, "m4"), "k", 100)
    with monkeypatch.context() as m:
        m.setattr(insert, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            insert.run(df)
    mt.sinks._remove(spark, f"{insert.data}/_chunk=6")  # its task hadn't committed
    before = _files(insert, df.schema)
    ledger = {r.chunk_id: r for r in insert.run(df).collect()}
    assert _rows(insert.rows(df.schema)) == _rows(df)  # NULL keys too
    assert set(ledger) == {None, *range(10)} and ledger[None].rows == 20 and sum(r.rows for r in ledger.values()) == 1000
    assert {i: r.attempt for i, r in ledger.items()} == {i: 2 if i == 6 else 1 for i in ledger}
    assert (ledger[3].chunk_start, ledger[3].chunk_end) == (300, 400) and ledger[None].chunk_start is None
    after = _files(insert, df.schema)
    assert before <= after and {c for c, _ in after - before} == {6}  # what was committed isn't written again
    again = {r.chunk_id: r.attempt for r in insert.run(df).collect()}
    assert again == {i: r.attempt for i, r in ledger.items()} and _files(insert, df.schema) == after  # nothing is left to write


def test_partial_and_changed_chunks_are_written_anew(spark):
    df = spark.range(60).select(F.col("id").alias("k"), F.lit("a").alias("s"))
    insert = mt.ChunkedInsert(spark, scratch_path(spark, "m4"), "k", 10)
    insert.run(df)
    spark.read.parquet(insert.data).where("_chunk = 2 and k < 25").drop("_chunk").coalesce(1).write.parquet(f"{insert.data}-half")
    mt.sinks._remove(spark, f"{insert.data}/_chunk=2")  # a chunk of which only some tasks had finished
    spark.read.parquet(f"{insert.data}-half").write.parquet(f"{insert.data}/_chunk=2")
    changed = df.withColumn("s", F.when(F.col("k") == 41, "b").otherwise(F.col("s"))).union(spark.createDataFrame([(-15, "c")], df.schema))
    ledger = {r.chunk_id: (r.rows, r.attempt) for r in insert.run(changed).collect()}
    assert _rows(insert.rows(df.schema)) == _rows(changed)
    assert ledger == {-2: (1, 2), -1: (0, 2), 0: (10, 1), 1: (10, 1), 2: (10, 2), 3: (10, 1), 4: (10, 2), 5: (10, 1)}


def test_no_rows_no_chunks(spark):
    df = spark.range(0).withColumnRenamed("id", "k")
    insert = mt.ChunkedInsert(spark, scratch_path(spark, "m4"), "k", 10)
    assert insert.run(df).count() == 0 and insert.rows(df.schema).count() == 0 and mt.chunk_bounds(df, "k", 10).count() == 0


def test_a_mart_run_resumes_and_then_switches_the_target(spark):
    name = "mart_" + uuid.uuid4().hex[:8]
    base = scratch_path(spark, "m9")
    view = "src_" + name
    mart = {"datamart_name": name, "target_table": name, "query": f"SELECT k, v FROM {view}", "chunk_column": "k", "chunk_size": 10}
    good = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    bad = good.withColumn("v", F.when(F.col("k") == 55, F.raise_error(F.lit("killed"))).otherwise(F.lit(1)).cast("int"))
    good.limit(30).createOrReplaceTempView(view)
    assert mt.run_mart(spark, mart, base, f"{base}/_log").first().chunk_count == 3
    bad.createOrReplaceTempView(view)
    with pytest.raises(Exception, match="killed"):
        mt.run_mart(spark, mart, base, f"{base}/_log")
    assert spark.table(name).count() == 30  # the target is as it was
    folder = mt.open_build(spark, mart, base)
    good.createOrReplaceTempView(view)
    assert mt.run_mart(spark, mart, base, f"{base}/_log").first().chunk_count == 10
    assert spark.table(name).count() == 100 and spark.table(name).columns == ["k", "v"]
    assert mt.sinks.exists(spark, folder) and mt.open_build(spark, mart, base) != folder  # the build went on in its folder and is closed
    log = [(r.status, r.chunk_count) for r in spark.read.parquet(f"{base}/_log").orderBy("start_time").collect()]
    assert log == [("success", 3), ("failed", 0), ("success", 10)]
    append = mart | {"target_table": name + "_all"}
    for n in (100, 200):
        mt.run_mart(spark, append, base, mode="append")
        assert spark.table(append["target_table"]).count() == n


def test_grid_boxes_cover_the_grid(spark):
    points = [(0, 5), (7, 6), (23, 30), (23, 91), (95, 5), (95, 6), (None, 1), (3, None)]
    df = spark.createDataFrame(points, "a int, b bigint")
    assert mt.chunk_grid(df, ["a", "b"], 10).count() == 10 * 10 and mt.chunk_grid(df.where("false"), ["a", "b"], 10).count() == 0
    boxes = mt.grid_boxes(df, ["a", "b"], 10).collect()
    covered = {}
    for r in boxes:
        if r.a_start is not None:
            for x in range(r.a_start, r.a_end, 10):
                for y in range(r.b_start, r.b_end, 10):
                    assert (x, y) not in covered
                    covered[x, y] = r.rows
    want = {(x, y): 0 for x in range(0, 100, 10) for y in range(1, 101, 10)}
    for a, b in points:
        if a is not None and b is not None:
            want[a // 10 * 10, (b - 1) // 10 * 10 + 1] += 1
    assert covered == want and [r.rows for r in boxes if r.a_start is None] == [2]
    assert len(boxes) <= 4 * 3 + 3  # follows the four cells that hold rows, not the hundred
    assert mt.grid_boxes(df.where("false"), ["a", "b"], 10).count() == 0
    wide = spark.createDataFrame([(0, 0, 0), (10**12, 10**12, 10**12)], "a bigint, b bigint, c bigint")
    assert mt.grid_boxes(wide, ["a", "b", "c"], 1).count() < 20


def test_a_grid_is_inserted_cell_by_cell(spark):
    df = spark.range(300).select((F.col("id") % 30).alias("a"), F.when(F.col("id") != 7, F.col("id") % 7).cast("int").alias("b"), "id")
    insert = mt.ChunkedInsert(spark, scratch_path(spark, "m6"), "a, b", 10)
    ledger = {r.chunk_id: r for r in insert.run(df).collect()}
    assert {i: (r.rows, r.attempt) for i, r in ledger.items()} == {"0_0": (99, 1), "1_0": (100, 1), "2_0": (100, 1), None: (1, 1)}
    assert (ledger["2_0"].a_start, ledger["2_0"].a_end, ledger["2_0"].b_start, ledger["2_0"].b_end) == (20, 30, 0, 10)
    mt.sinks._remove(spark, f"{insert.data}/_chunk=1_0")
    assert {r.chunk_id: r.attempt for r in insert.run(df).collect()} == {"0_0": 1, "1_0": 2, "2_0": 1, None: 1}
    assert _rows(insert.rows(df.schema)) == _rows(df)
