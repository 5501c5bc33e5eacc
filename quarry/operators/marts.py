"""Mart building (M1-M9): config filtering, dependency readiness, chunk
arithmetic, composite grids, run logs and the mart runner.

A chunked insert (M4) is one distributed job with a folder per chunk, not one job per chunk,
and its ledger says which chunks are committed, so a failed run goes on where it stopped.
"""

from __future__ import annotations

import datetime as _dt
import math
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.ingest import rank_within
from quarry.session import scratch_path
from quarry.sources import sinks

LOG_SCHEMA = (
    "run_id string, datamart_name string, target_table string, status string, message string, "
    "start_time timestamp_ntz, end_time timestamp_ntz, duration_sec double, chunk_count int, query string"
)


def enabled_marts(config: DataFrame) -> DataFrame:
    """M1: config rows with ``enabled = 1``."""
    return config.where(F.col("enabled") == 1)


def last_success(config: DataFrame, log: DataFrame) -> DataFrame:
    """M8: per mart, the latest end time of a successful run (``last_run``);
    NULL when it never succeeded."""
    ok = log.where(F.col("status") == "success").groupBy("datamart_name").agg(F.max("end_time").alias("last_run"))
    return config.select("datamart_name").join(ok, "datamart_name", "left")


def mart_readiness(config: DataFrame, log: DataFrame) -> DataFrame:
    """M2: a mart is ready iff every name in ``depends_on`` has a successful run
    (existence only); an empty list is ready; a missing success is not ready
    (SURVEY 2.11 #11)."""
    ok = log.where(F.col("status") == "success").groupBy("datamart_name").agg(F.max("end_time").alias("dep_last"))
    deps = config.select("datamart_name", F.explode_outer("depends_on").alias("dep"))
    j = deps.join(ok.withColumnRenamed("datamart_name", "dep"), "dep", "left")
    return j.groupBy("datamart_name").agg(
        F.bool_and(F.col("dep").isNull() | F.col("dep_last").isNotNull()).alias("ready"),
        F.count("dep").alias("n_dependencies"),
        F.count_if(F.col("dep").isNotNull() & F.col("dep_last").isNull()).alias("n_missing"),
    )


def _bounds(df: DataFrame, cols: Sequence[str]) -> list[tuple]:
    """(least, largest) of each column, NULLs aside: one aggregate."""
    row = df.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(cols))]


def _starts(spark: SparkSession, df: DataFrame, col: str, size: int, lo, first: int, count: int) -> DataFrame:
    """``count`` chunks (chunk_id, chunk_start, chunk_end) from chunk ``first`` on, made by
    ``spark.range``, so that no task holds the list."""
    kind = df.schema[col].dataType
    start = (F.lit(lo) + F.col("id") * size).cast(kind)
    return spark.range(first, first + count).select(F.col("id").alias("chunk_id"), start.alias("chunk_start"), (start + size).cast(kind).alias("chunk_end"))


def chunk_bounds(df: DataFrame, col: str, size: int) -> DataFrame:
    """M3: half-open chunks ``[s, s + size)`` from ``min(col)`` until past
    ``max(col)``; no rows -> no chunks."""
    lo, hi = _bounds(df, [col])[0]
    count = 0 if lo is None else int((hi - lo) // size) + 1
    return _starts(df.sparkSession, df, col, size, 0 if lo is None else lo, 0, count).withColumn("chunk_id", F.col("chunk_id").cast("int"))


def chunk_count(df: DataFrame, col: str, size: int) -> int:
    """Chunks of M3 (empty ones too, NULL keys in none): one aggregate of the bounds."""
    lo, hi = _bounds(df, [col])[0]
    return 0 if lo is None else int((hi - lo) // size) + 1


def _chunks_in(df: DataFrame, col: str, size: int, lo: Column) -> Column:
    """Whole chunks between the least key and a row's key; integer keys divide exactly."""
    distance = F.col(col) - lo
    if isinstance(df.schema[col].dataType, T.IntegralType):
        whole, step = distance.cast("bigint"), F.lit(size).cast("bigint")
        return F.call_function("div", whole - F.pmod(whole, step), step)  # rounds down below zero, too
    return F.floor(distance / F.lit(size)).cast("bigint")


def with_chunk_id(df: DataFrame, col: str, size: int, name: str = "_chunk") -> DataFrame:
    """M4: tag rows with their chunk id ``floor((c - min) / size)``. The min is a
    scalar subquery; rows with a NULL key keep a NULL chunk and are kept
    (SURVEY 2.11 #9)."""
    lo = df.select(F.min(col)).scalar()
    return df.withColumn(name, _chunks_in(df, col, size, lo))


def chunked_build_counts(df: DataFrame, col: str, size: int) -> DataFrame:
    """M4 report: rows per chunk (the NULL chunk holds the NULL-key rows)."""
    lo = df.select(F.min(col)).scalar()
    tagged = with_chunk_id(df, col, size)
    return tagged.groupBy("_chunk").agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("_chunk").alias("chunk_id"),
        (lo + F.col("_chunk") * size).alias("chunk_start"),
        (lo + (F.col("_chunk") + 1) * size).alias("chunk_end"),
        "rows",
    )


class ChunkedInsert:
    """M4: a mart's rows inserted chunk by chunk into ``folder``, resumable.

    One job writes all chunks that are not committed yet, one folder per chunk; AQE splits a
    chunk that holds many rows over several tasks and gives small ones one task together
    (``rebalance``). Tasks commit their files by themselves (committer version 2), so a
    failed run leaves what its finished tasks wrote. The next run compares every chunk's
    rows in the source and in the folder (count and sum of row hashes): equal chunks are
    committed and not written again, others are cleared and written. Nothing is needed of
    the failed run, so a lost driver is no special case, and a chunk whose source rows have
    changed since is written anew.

    The ledger has a row per chunk of the range, empty ones too, and one with a NULL id for
    rows whose key is NULL: the rows, and the attempt that wrote them. Chunks are counted
    from the least key that the first attempt met.

    Several columns make a grid (M6): a chunk is a cell, its id the columns' chunk numbers
    joined by ``_``, and the ledger has the cells that hold rows."""

    KEY = "_chunk"

    def __init__(self, spark: SparkSession, folder: str, cols: str | Sequence[str], size: int):
        self.spark, self.folder, self.size = spark, folder.rstrip("/"), size
        self.cols = parse_columns(cols) if isinstance(cols, str) else list(cols)
        self.data = f"{self.folder}/data"
        self.kind = "bigint" if len(self.cols) == 1 else "string"
        self.LEDGER = f"chunk_id {self.kind}, rows bigint, attempt int"

    def _least(self, df: DataFrame, plans: list) -> list:
        """Each column's least key: that of the first attempt, where it met one."""
        now = None
        if not plans or None in plans[0].lo:
            now = [lo for lo, _ in _bounds(df, self.cols)]
        return [now[i] if not plans or plans[0].lo[i] is None else plans[0].lo[i] for i in range(len(self.cols))]

    def _tagged(self, df: DataFrame, lo: list) -> DataFrame:
        ids = [_chunks_in(df, c, self.size, F.lit(v).cast(df.schema[c].dataType)) for c, v in zip(self.cols, lo, strict=True)]
        cell = F.concat(*[i.cast("string") if n == 0 else F.concat(F.lit("_"), i.cast("string")) for n, i in enumerate(ids)])
        return df.withColumn(self.KEY, ids[0] if len(ids) == 1 else cell)

    def _plans(self) -> list:
        """The attempts so far: attempt, lo."""
        path = f"{self.folder}/attempts"
        return self.spark.read.parquet(path).orderBy("attempt").collect() if sinks.exists(self.spark, path) else []

    def _held(self, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField(self.KEY, T.LongType() if self.kind == "bigint" else T.StringType())])).parquet(self.data)

    def _content(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        row = F.xxhash64(*[F.col(f"`{n}`") for n in names]).cast("decimal(38,0)")
        return df.groupBy(self.KEY).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).alias("hash_sum"))

    def _old_ledger(self, attempt: int) -> DataFrame:
        path = f"{self.folder}/ledger/v={attempt}"
        return self.spark.read.schema(self.LEDGER).parquet(path) if sinks.exists(self.spark, path) else self.spark.createDataFrame([], self.LEDGER)

    def _write_ledger(self, rows: DataFrame, attempt: int) -> None:
        rows.select("chunk_id", "rows", "attempt").write.mode("overwrite").parquet(f"{self.folder}/ledger/v={attempt}")

    def settle(self, tagged: DataFrame, names: Sequence[str], schema: T.StructType, attempt: int) -> DataFrame:
        """The chunks that earlier attempts finished; what they left of others is cleared.
        The ledger says so before anything is written."""
        source, held = self._content(tagged, names), self._content(self._held(schema), names)
        same = (source[self.KEY].eqNullSafe(held[self.KEY])) & (source.rows == held.rows) & (source.hash_sum == held.hash_sum)
        finished = held.join(source, same, "left_semi").select(F.col(self.KEY).alias("chunk_id"), "rows")
        before = self._old_ledger(attempt - 1).select(F.col("chunk_id").alias("old"), F.col("attempt").alias("by"))
        self._write_ledger(finished.join(before, F.col("chunk_id").eqNullSafe(F.col("old")), "left")
                           .select("chunk_id", "rows", F.coalesce("by", F.lit(attempt - 1)).alias("attempt")), attempt)
        done = self._old_ledger(attempt)
        partial = held.select(self.KEY).join(done, held[self.KEY].eqNullSafe(done.chunk_id), "left_anti")
        for r in partial.toLocalIterator():
            sinks._remove(self.spark, f"{self.data}/{self.KEY}={'__HIVE_DEFAULT_PARTITION__' if r[0] is None else r[0]}")
        return done

    def run(self, df: DataFrame) -> DataFrame:
        """Insert all rows of ``df``; returns the ledger. A failure is raised after the tasks
        that finished have kept their files."""
        names, plans = df.columns, self._plans()
        attempt = len(plans) + 1
        if self.KEY in names:
            raise ValueError(f"a mart can't have a column {self.KEY}")
        lo = self._least(df, plans)
        kinds = ", ".join(f"_{i}: {df.schema[c].dataType.simpleString()}" for i, c in enumerate(self.cols))
        self.spark.createDataFrame([(attempt, tuple(lo))], f"attempt int, lo struct<{kinds}>").write.mode("append").parquet(f"{self.folder}/attempts")
        tagged = self._tagged(df, lo)
        todo, done = tagged, None
        if plans and sinks.exists(self.spark, self.data):
            done = self.settle(tagged, names, df.schema, attempt)
            todo = tagged.join(done.select("chunk_id"), F.col(self.KEY).eqNullSafe(F.col("chunk_id")), "left_anti")
        (todo.hint("rebalance", self.KEY).write.mode("append").partitionBy(self.KEY)
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.data))
        return self._commit(df, lo, done, attempt)

    def _commit(self, df: DataFrame, lo: list, done: DataFrame | None, attempt: int) -> DataFrame:
        """All chunks are written: the ledger of them, of one column with the empty ones."""
        rows = self._held(df.schema).groupBy(F.col(self.KEY).alias("chunk_id")).agg(F.count(F.lit(1)).alias("rows"))
        before = done if done is not None else self.spark.createDataFrame([], self.LEDGER)
        before = before.select(F.col("chunk_id").alias("old"), F.col("attempt").alias("by"))
        counted = rows.join(before, F.col("chunk_id").eqNullSafe(F.col("old")), "left").select("chunk_id", "rows", F.coalesce("by", F.lit(attempt)).alias("attempt"))
        if len(self.cols) == 1:
            path = f"{self.folder}/counted/v={attempt}"
            counted.write.mode("overwrite").parquet(path)
            counted = self.spark.read.schema(self.LEDGER).parquet(path)
            first, last = counted.agg(F.min("chunk_id"), F.max("chunk_id")).first()
            ids = self.spark.range(first or 0, (first or 0) if last is None else last + 1).withColumnRenamed("id", "chunk_id")
            counted = counted.unionByName(ids.join(counted, "chunk_id", "left_anti").select("chunk_id", F.lit(0).cast("bigint").alias("rows"), F.lit(attempt).alias("attempt")))
        self._write_ledger(counted, attempt)
        bounds = []
        for i, (c, low) in enumerate(zip(self.cols, lo, strict=True)):
            at, kind = F.col("chunk_id") if len(self.cols) == 1 else F.split("chunk_id", "_")[i].cast("bigint"), df.schema[c].dataType
            name = "chunk" if len(self.cols) == 1 else c
            bounds += [(F.lit(low) + at * self.size).cast(kind).alias(f"{name}_start"), (F.lit(low) + (at + 1) * self.size).cast(kind).alias(f"{name}_end")]
        return self._old_ledger(attempt).select("chunk_id", *bounds, "rows", "attempt")

    def rows(self, schema: T.StructType) -> DataFrame:
        """The inserted rows, as they were before the chunk id was added."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.data)


def parse_columns(spec: str) -> list[str]:
    """M5: ``"a, b,c"`` -> ``["a", "b", "c"]``."""
    return [c.strip() for c in spec.split(",") if c.strip()]


def chunk_grid(df: DataFrame, cols: Sequence[str], size: int) -> DataFrame:
    """M5: bounds of every column in one aggregation, then the product of the per-column
    chunk starts: cell numbers from ``spark.range``, written in mixed radix. A cell is
    ``[start_i, start_i + size)`` on every column (SURVEY 2.11 #8)."""
    bounds = _bounds(df, cols)
    counts = [0 if lo is None else int((hi - lo) // size) + 1 for lo, hi in bounds]
    cells = math.prod(counts)
    out, below = df.sparkSession.range(cells), cells
    for c, (lo, _), n in zip(cols, bounds, counts, strict=True):
        below //= max(n, 1)
        at = F.expr(f"id div {max(below, 1)} % {max(n, 1)}")
        kind = df.schema[c].dataType
        start = (F.lit(0 if lo is None else lo) + at * size).cast(kind)
        out = out.withColumns({f"{c}_start": start, f"{c}_end": (start + size).cast(kind)})
    return out.drop("id")


def grid_boxes(df: DataFrame, cols: Sequence[str], size: int) -> DataFrame:
    """M6: the grid as boxes with their rows: every cell that holds rows, and runs of empty
    cells with 0. A run lies between two such cells of one line (the other columns' starts
    equal) along the last column; lines without any rows are runs along the column before,
    over the whole of the last one; and so on. So the boxes cover the grid exactly and their
    number grows with the cells that hold rows, not with the product of the columns.

    Rows with a NULL key are one row of NULL bounds. Bounds of all columns are one aggregate."""
    bounds = _bounds(df, cols)
    if None in [lo for lo, _ in bounds]:
        bounds, df_cells = [], df.where("false")
    else:
        df_cells = df.where(" and ".join(f"`{c}` is not null" for c in cols))
    spark, n = df.sparkSession, [int((hi - lo) // size) + 1 for lo, hi in bounds]
    lows = [F.lit(lo).cast(df.schema[c].dataType) for c, (lo, _) in zip(cols, bounds)]
    ids = [f"i{d}" for d in range(len(cols))]

    def box(first: list[Column], last: list[Column], rows: Column) -> list[Column]:
        out = []
        for c, low, a, b in zip(cols, lows, first, last):
            kind = df.schema[c].dataType
            out += [(low + a * size).cast(kind).alias(f"{c}_start"), (low + (b + 1) * size).cast(kind).alias(f"{c}_end")]
        return [*out, rows.cast("bigint").alias("rows")]

    nulls = df.where(" or ".join(f"`{c}` is null" for c in cols)).groupBy().agg(F.count(F.lit(1)).alias("rows")).where("rows > 0")
    bare = [F.lit(None).cast(df.schema[c].dataType).alias(f"{c}_{e}") for c in cols for e in ("start", "end")]
    out = nulls.select(*bare, "rows")
    if not bounds:
        return out
    path = scratch_path(spark, "cells")
    df_cells.select(*[_chunks_in(df, c, size, low).alias(i) for c, low, i in zip(cols, lows, ids)]).groupBy(*ids).agg(F.count(F.lit(1)).alias("rows")).write.parquet(path)
    cells = spark.read.parquet(path)
    at = [F.col(i) for i in ids]
    out = cells.select(*box(at, at, F.col("rows"))).unionByName(out)
    for d, count in enumerate(n):
        line = F.concat_ws("_", *ids[:d]) if d else F.lit("")
        held = cells.select(*ids[: d + 1]).distinct().select(*ids[:d], line.alias("line"), F.col(ids[d]).cast("bigint").alias("at"))
        ends = held.drop("at").distinct().select("*", F.explode(F.array(F.lit(-1).cast("bigint"), F.lit(count).cast("bigint"))).alias("at"))
        ranked = rank_within(held.unionByName(ends), "line", "at")
        after = ranked.select("line", (F.col("_rank") - 1).alias("_rank"), F.col("at").alias("next"))
        gaps = ranked.join(after, ["line", "_rank"]).where("next - at > 1")
        rest = n[d + 1 :]
        first = [*at[:d], F.col("at") + 1, *[F.lit(0)] * len(rest)]
        last = [*at[:d], F.col("next") - 1, *[F.lit(r - 1) for r in rest]]
        out = out.unionByName(gaps.select(*box(first, last, F.lit(0))))
    return out


def run_log_row(spark: SparkSession, *, run_id: str, name: str, target: str, status: str, message: str,
                start: _dt.datetime, end: _dt.datetime, chunk_count: int, query: str) -> DataFrame:
    """M7: the one-row run log (duration rounded to 2 places)."""
    dur = round((end - start).total_seconds(), 2)
    return spark.createDataFrame(
        [(run_id, name, target, status, message, start, end, dur, chunk_count, query)], LOG_SCHEMA
    )


def open_build(spark: SparkSession, mart: dict, base_path: str) -> str:
    """The folder of the mart's unfinished build, if one with the same query and chunks is
    there; else a new one."""
    base = f"{base_path.rstrip('/')}/{mart['target_table'].replace('.', '__')}__builds"  # beside what an append target holds
    path, schema = f"{base}/_open", "folder string, query string, chunk_column string, chunk_size bigint"
    wanted = (mart["query"], mart["chunk_column"], int(mart["chunk_size"]))
    if sinks.exists(spark, path):
        was = spark.read.schema(schema).parquet(path).first()
        if was and tuple(was)[1:] == wanted:
            return was.folder
    folder = f"{base}/v={uuid.uuid4().hex}"
    spark.createDataFrame([(folder, *wanted)], schema).coalesce(1).write.mode("overwrite").parquet(path)
    return folder


def chunked_refresh(spark: SparkSession, df: DataFrame, mart: dict, base_path: str, mode: str) -> int:
    """M4 inside M9: insert the mart's rows chunk by chunk (going on with an unfinished
    build), then switch the target to them (S9) or append them to it (S10). Returns the
    ledger's chunks. The target changes only when all chunks are committed."""
    folder = open_build(spark, mart, base_path)
    insert = ChunkedInsert(spark, folder, mart["chunk_column"], int(mart["chunk_size"]))
    chunks = insert.run(df).where("chunk_id is not null").count()
    if mode == "append":
        sinks.append_refresh(insert.rows(df.schema), mart["target_table"], base_path)
        sinks._remove(spark, folder)
    else:
        sinks.switch_table(spark, mart["target_table"], insert.data, df.schema)
    sinks._remove(spark, f"{folder.rsplit('/', 1)[0]}/_open")
    return chunks


def run_mart(spark: SparkSession, mart: dict, base_path: str, log_path: str | None = None,
             mode: str = "full_refresh") -> DataFrame:
    """M9: run the mart's SQL (held in config) over the session's views, refresh
    the target (S9 swap or S10 append; by chunks, M4, if the config names a chunk column),
    and append one M7 log row in all cases. Returns the log row; errors are logged, then
    re-raised, and the next run of a chunked mart goes on with the chunks not yet committed."""
    start = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    t0 = time.perf_counter()
    status, message, chunks = "success", "success", 1
    target = mart["target_table"]
    try:
        df = spark.sql(mart["query"])
        if mart.get("chunk_column"):
            chunks = chunked_refresh(spark, df, mart, base_path, mode)
        elif mode == "append":
            sinks.append_refresh(df, target, base_path)
        else:
            sinks.full_refresh_swap(df, target, base_path)
    except Exception as e:  # noqa: BLE001 - logged then re-raised
        status, message, chunks = "failed", str(e), 0
        raise
    finally:
        end = start + _dt.timedelta(seconds=time.perf_counter() - t0)
        row = run_log_row(spark, run_id=uuid.uuid4().hex, name=mart["datamart_name"], target=target,
                          status=status, message=message, start=start, end=end, chunk_count=chunks,
                          query=mart["query"])
        if log_path:
            row.write.mode("append").parquet(log_path)
    return row
