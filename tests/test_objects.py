"""Objects copied, archived and quarantined byte for byte (S5, S12, F10) and files ingested by
splits (F12)."""

import glob
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import ingest as ig
from quarry.session import scratch_path
from quarry.sources import files as fs
from quarry.sources import objects
from quarry.streaming import ingest as ist


def _tree(folder):
    folder = folder.removeprefix("file://")
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")}


def _local(spark, name):
    path = scratch_path(spark, name).removeprefix("file://")
    os.makedirs(path)
    return path


def _put(folder, name, data):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


def test_objects_keep_names_and_bytes(spark):
    base = _local(spark, "objects")
    for name, data in (("a.bin", bytes(range(256)) * 50), ("deep/er/b c.txt", b"x\r\n"), ("day=2024-01-01/k%3A1.bin", b""), ("big", b"z" * (objects.PIECE * 2 + 5))):
        _put(f"{base}/src", name, data)
    _put(base, "srcs/other.txt", b"not below the prefix")
    done = fs.relocate_objects(spark, f"{base}/src", f"{base}/dst").collect()
    assert _tree(f"{base}/dst") == _tree(f"{base}/src") and {r.status for r in done} == {"SUCCESS"} and len(done) == 4
    assert {os.path.basename(r.path): r.written for r in done}["big"] == objects.PIECE * 2 + 5
    gone = spark.createDataFrame([(f"{base}/src/none", f"{base}/dst/none", 3), (f"{base}/src/a.bin", f"{base}/dst/short", 7)], "path string, dest_path string, length long")
    assert [(r.status, bool(r.error)) for r in objects.process_objects(gone).collect()] == [("FAILED", True)] * 2


def test_the_strategies_differ(spark):
    data, left = b"one\ntwo\n" * 100, {}
    for strategy in objects.STRATEGIES:
        base = _local(spark, "s12")
        _put(f"{base}/in", "f.txt", data)
        listed = fs.file_manifest(spark, [f"{base}/in"]).select("path", "length").cache()
        listed.count()
        for _ in range(2):  # a repeated run changes nothing
            out = objects.postprocess(listed, strategy, f"{base}/old").collect()
        left[strategy] = {n: gzip.decompress(b) if n.endswith(".gz") else b for n, b in _tree(base).items()}
        assert [r.status for r in out] == [{"delete": "SUCCESS"}.get(strategy, "SUCCESS")]
    assert {s: set(t) for s, t in left.items()} == {"none": {"in/f.txt"}, "compress": {"in/f.txt", "in/f.txt.gz"}, "move": {"old/f.txt"},
                                                   "move_and_compress": {"in/f.txt", "old/f.txt.gz"}, "delete": set()}
    assert all(b == data for t in left.values() for b in t.values())
    for wrong in (("shred", None), ("move", None)):
        with pytest.raises(ValueError):
            objects.postprocess(listed, *wrong)


def test_lines_of_a_split_file_are_numbered_as_in_one_piece(spark):
    folder = _local(spark, "split")
    lines = [f"line {i} " + "x" * (i * 37 % 400) for i in range(3000)] + ["", "", "no newline at the end ä"]
    _put(folder, "big.txt", "\n".join(lines).encode())
    _put(folder, "small.txt", b"\n\na\r\nb\n")
    paths = [f"{folder}/big.txt", f"{folder}/small.txt"]
    got = {}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = ist.read_lines(spark, paths)
            hashes = {os.path.basename(r.file_path): r.file_hash for r in ig.content_fingerprint(df).collect()}
            rows = sorted((os.path.basename(r.file_path), r.line_no, r.line) for r in df.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        got[size] = (hashes, rows)
    assert got["128m"] == got["16k"]
    assert [r[2] for r in got["16k"][1] if r[0] == "big.txt"] == lines and [r[1] for r in got["16k"][1]][: len(lines)] == list(range(len(lines)))
    assert [r[2] for r in got["16k"][1] if r[0] == "small.txt"] == ["", "", "a\r", "b"]


RULES = [(1, "docs.*", "public.docs")]


def _rules(spark):
    return spark.createDataFrame(RULES, "rule_order int, regex string, target_table string")


def test_ingestion_moves_loaded_files_and_quarantines_others(spark):
    base = _local(spark, "f12")
    inbox, out = f"{base}/inbox", f"{base}/out"
    _put(inbox, "docs_a.txt", b"a\nb\n")
    _put(inbox, "docs_b.csv", b"c")
    _put(inbox, "docs_c.xlsx", b"\x00\x01")
    _put(inbox, "docs_d.txt", b"")
    _put(inbox, "other.txt", b"nobody's")
    ist.run_incremental(spark, inbox, _rules(spark), out, f"{base}/ckpt", "2024-01-01 00:00:00", postprocess="move", archive=f"{base}/archive")
    assert set(_tree(inbox)) == {"docs_d.txt", "other.txt"}  # empty and unmatched files stay
    assert _tree(f"{base}/archive") == {"docs_a.txt": b"a\nb\n", "docs_b.csv": b"c"}
    assert [v for n, v in _tree(f"{out}/quarantine").items() if n.endswith("docs_c.xlsx")] == [b"\x00\x01"]
    ledger = {os.path.basename(r.file_path): (r.status, r.error_message) for r in spark.read.parquet(f"{out}/ledger").collect()}
    assert ledger == {"docs_a.txt": ("SUCCESS", None), "docs_b.csv": ("SUCCESS", None), "docs_c.xlsx": ("FAILED", ig.UNSUPPORTED_MESSAGE)}
    rows = ist.loaded_rows(spark, out).collect()
    assert sorted((r.line_no, r.line) for r in rows) == [(0, "a"), (0, "c"), (1, "b")] and len({r._version_id for r in rows if r._is_latest}) == 1
    ist.run_incremental(spark, inbox, _rules(spark), out, f"{base}/ckpt", "2024-01-01 00:00:00")
    assert ist.loaded_rows(spark, out).count() == 3


def test_unreadable_files_fail_alone_and_retries_repeat_only_actions(spark):
    base = _local(spark, "f12")
    out = f"{base}/out"
    _put(f"{base}/in", "docs_a.txt", b"a\nb\n")
    _put(f"{base}/in", "docs_cut.txt", b"half of it")
    files = spark.createDataFrame(
        [(f"file:{base}/in/{n}", f"{base}/in/{n}", size) for n, size in (("docs_a.txt", 4), ("docs_cut.txt", 900), ("docs_gone.txt", 5))], "file_path string, path string, length long",
    ).withColumn("modified", F.lit("2024-01-01").cast("timestamp"))
    ist.init_outputs(spark, out)
    for _ in range(2):
        ist.ingest_batch(spark, files, 0, _rules(spark), out, "2024-01-01 00:00:00", postprocess="move", archive=f"{base}/archive")
        ledger = {os.path.basename(r.path): (r.status, r.error_message) for r in spark.read.parquet(f"{out}/ledger").collect()}
        assert {n: s for n, (s, _) in ledger.items()} == {"docs_a.txt": "SUCCESS", "docs_cut.txt": "FAILED", "docs_gone.txt": "FAILED"}
        assert "of 900 bytes" in ledger["docs_cut.txt"][1]
        assert [r.line for r in ist.loaded_rows(spark, out).orderBy("line_no").collect()] == ["a", "b"]
        assert set(_tree(f"{base}/archive")) == {"docs_a.txt"} and not glob.glob(f"{base}/in/docs_cut*")


def test_a_run_of_failures_raises(spark):
    base = _local(spark, "f12")
    _put(f"{base}/in", "docs.xlsx", hashlib.md5(b"x").digest())
    with pytest.raises(RuntimeError, match="all 1 files"):
        ist.run_incremental(spark, f"{base}/in", _rules(spark), f"{base}/out", f"{base}/ckpt", "2024-01-01 00:00:00")
    with pytest.raises(ValueError):
        ist.run_incremental(spark, f"{base}/in", _rules(spark), f"{base}/out", f"{base}/ckpt", "2024-01-01 00:00:00", postprocess="shred")


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are planned when no side is known to be small."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def _largest_share(rows):
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


def test_lines_of_one_target_are_not_gathered_in_one_task(no_broadcast):
    spark = no_broadcast
    plan = spark.range(64).selectExpr("concat('/f', id) as file_path", "if(id < 0, 'u', 't') as target_table", "md5(cast(id as string)) as file_hash", "'SUCCESS' as status", "cast(id + 1 as int) as _version_id")
    lines = spark.range(64).selectExpr("concat('/f', id) as file_path", "explode(sequence(0, 9)) as line_no").withColumn("line", F.lit("x"))
    rows = ig.rows_for(plan, lines, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert _largest_share(rows) < 0.5
    assert {(r._version_id, r._is_latest) for r in rows.collect()} == {(v, v == 64) for v in range(1, 65)} and rows.count() == 640


def test_latest_flags_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", None), (None, 7), ("b", None), ("c", -3)], "target_table string, _version_id int")
    got = [tuple(r) for r in ig.latest_flags(rows).collect()]
    want = [("a", 1, False), ("a", 2, True), ("a", 2, True), ("a", None, None), ("b", None, None), ("c", -3, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_of_ingested_files_stay_in_their_splits(no_broadcast):
    spark = no_broadcast
    base = _local(spark, "f12")
    for n in "ab":
        _put(f"{base}/in", f"docs_{n}.txt", f"line of {n}\n".encode() * 60_000)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        ist.run_incremental(spark, f"{base}/in", _rules(spark), f"{base}/out", f"{base}/ckpt", "2024-01-01 00:00:00")
        assert len(spark.read.parquet(f"{base}/out/rows/batch_id=0").inputFiles()) > 4
        rows = ist.loaded_rows(spark, f"{base}/out")
        assert _largest_share(rows) < 0.4
        got = rows.groupBy("_version_id", "_is_latest", "line").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last")).collect()
        assert sorted((r._version_id, r._is_latest, r.n, r.last) for r in got) == [(1, False, 60_000, 59_999), (2, True, 60_000, 59_999)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
