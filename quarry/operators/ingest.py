"""File ingestion with routing, fingerprints, duplicate skipping, versions,
lineage and a ledger (F1-F11), set-based: one DataFrame of files goes
through every step, instead of one file at a time.

Inputs: a manifest ``(file_path, file_order, ...)`` and the files' lines
``(file_path, line_no, line)``. Per-file results are aggregations (partial per
task), so one file with a third of all lines is still spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import scratch_path

# Extensions the reader handles (others become FAILED ledger rows).
SUPPORTED_EXTENSIONS = ["csv"]
UNSUPPORTED_MESSAGE = "Unsupported file type"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


RULES_PER_EXPRESSION = 200


def route_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """the first rule (by ``rule_order``; ties by regex, then target) whose regex
    matches at the start of the file's base name gives ``target_table``; no match -> NULL
    (skipped).

    Rules are configuration: they become ``CASE WHEN name RLIKE r1 THEN t1 …`` columns of
    ``RULES_PER_EXPRESSION`` rules each, of which the first that is not NULL counts. So
    routing is a projection (no join, no shuffle) for any number of rules."""
    name = base_name(F.col("file_path"))
    rows = rules.where("regex is not null and target_table is not null").select("rule_order", "regex", "target_table")
    targets, cases, held = [], None, 0
    for r in rows.orderBy("rule_order", "regex", "target_table").toLocalIterator():
        hit = name.rlike(f"^(?:{r.regex})")
        cases = F.when(hit, F.lit(r.target_table)) if cases is None else cases.when(hit, F.lit(r.target_table))
        held += 1
        if held == RULES_PER_EXPRESSION:
            targets.append(cases)
            cases, held = None, 0
    targets += [cases] if cases is not None else []
    return files.withColumn("target_table", F.coalesce(*targets, F.lit(None).cast("string")))


def line_hash(line_no: Column, line: Column) -> Column:
    """60-bit number from the md5 of ``line_no:line``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", line_no.cast("string"), line)), 1, 15), 16, 10).cast("bigint")


def content_fingerprint(lines: DataFrame) -> DataFrame:
    """per file, md5 of ``<line count>:<sum of line hashes>`` where each
    line hash covers its line number, so reordering lines changes it. The sum
    is associative, so each task adds up its share of a big file."""
    agg = lines.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(line_hash(F.col("line_no"), F.col("line")).cast("decimal(38,0)")).alias("_s"),
    )
    return agg.select("file_path", F.md5(F.concat_ws(":", F.col("_n").cast("string"), F.col("_s").cast("string")))
                      .alias("file_hash"), F.col("_n").alias("rows"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """F2 order-free form for tables: row count and the sum (not XOR, where
    equal rows cancel) of a 64-bit row hash."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("hash_sum"))


def path_fingerprint(files: DataFrame) -> DataFrame:
    """md5 of the path (misses changed content; F2 is the default)."""
    return files.withColumn("path_hash", F.md5("file_path"))


def skip_already_loaded(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """drop files whose hash is already in the ledger (whatever its target)
    and, within the batch, all but the first file (by ``file_order``) of each
    hash. The first per hash is a grouped min (partial per task), so many
    copies of one file are never gathered in one place."""
    first = files.groupBy("file_hash").agg(F.min("file_order").alias("file_order"))
    kept = files.join(first, ["file_hash", "file_order"], "left_semi")
    return kept.join(ledger.select("file_hash").distinct(), "file_hash", "left_anti")


def rank_within(df: DataFrame, group: str, order: str, name: str = "_rank") -> DataFrame:
    """Dense 1-based rank of ``order`` inside each ``group`` without putting a
    group in one task: range-partition by (group, order) so every task holds a
    contiguous slice, number the rows inside each slice, and add the counts of
    the earlier slices of the same group. The slices are written once to the
    shared folder: range boundaries are sampled, so counts and rows must come
    from the same partitioning."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "slices")
    df.repartitionByRange(n, group, order).withColumn("_slice", F.spark_partition_id()).write.parquet(path)
    sliced = spark.read.parquet(path)
    counts = sliced.groupBy("_slice", group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy("_slice", group).orderBy(order)
    ranked = sliced.withColumn("_local", F.row_number().over(local))
    return ranked.join(offsets, ["_slice", group]) \
        .withColumn(name, F.col("_off") + F.col("_local")).drop("_slice", "_off", "_local")


def assign_version(files: DataFrame, existing: DataFrame) -> DataFrame:
    """version = previous max version of the target (0 when the target does
    not exist) + the file's rank among the batch's files for that target. The
    rank is computed slice by slice (``rank_within``), so a target that gets
    most of a batch's files is still spread over all tasks."""
    prev = existing.groupBy("target_table").agg(F.max("_version_id").alias("_prev"))
    ranked = rank_within(files, "target_table", "file_order")
    return ranked.join(prev, "target_table", "left").withColumn(
        "_version_id", (F.coalesce("_prev", F.lit(0)) + F.col("_rank")).cast("int")).drop("_prev", "_rank")


def newest_versions(rows: DataFrame) -> DataFrame:
    """``target_table, _version_id`` of each target's newest version (one row per target)."""
    return rows.groupBy("target_table").agg(F.max("_version_id").alias("_version_id"))


def latest_flags(rows: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """``_is_latest`` = the row's version is its target's newest. Derived,
    no UPDATE: a grouped max (one row per target) joined back by target and version, so
    that a target's rows are dealt by version and never gathered in one task. ``newest``:
    the rows' :func:`newest_versions`, if the caller has them at hand (to broadcast them)."""
    if newest is None:
        newest = newest_versions(rows)
    flagged = rows.where("target_table is not null").join(newest.withColumn("_newest", F.lit(True)), ["target_table", "_version_id"], "left")
    is_latest = F.when(F.col("_version_id").isNotNull(), F.coalesce("_newest", F.lit(False)))
    return flagged.select(*[F.col(c) for c in rows.columns], is_latest.alias("_is_latest"))


def stamp_lineage(rows: DataFrame, load_ts: Column) -> DataFrame:
    """lineage columns on every loaded row."""
    return rows.withColumns({
        "_file_name": base_name(F.col("file_path")),
        "_file_hash": F.col("file_hash"),
        "_load_timestamp": load_ts,
    })


def skip_empty(files: DataFrame) -> DataFrame:
    """F8: files with no rows are skipped (no ledger row)."""
    return files.where(F.col("rows") > 0)


def extension_status(files: DataFrame, extensions: Sequence[str] = SUPPORTED_EXTENSIONS) -> DataFrame:
    """Unsupported extensions fail with a message; the others read."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    ok = ext.isin(list(extensions))
    return files.withColumn("status", F.when(ok, "SUCCESS").otherwise("FAILED")) \
        .withColumn("error_message", F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(UNSUPPORTED_MESSAGE)))


def ingestion_ledger(outcomes: DataFrame, loaded_at: Column) -> DataFrame:
    """one row per processed file. FAILED rows carry no hash and no target."""
    failed = F.col("status") == "FAILED"
    return outcomes.select(
        "file_path",
        F.when(failed, F.lit(None).cast("string")).otherwise(F.col("file_hash")).alias("file_hash"),
        loaded_at.alias("loaded_at"),
        F.when(failed, F.lit(None).cast("string")).otherwise(F.col("target_table")).alias("target_table"),
        "status", "error_message",
    )


def quarantine(ledger: DataFrame, folder: str) -> DataFrame:
    """where each failed file goes (one failed move does not stop the rest:
    every file is its own row)."""
    return ledger.where(F.col("status") == "FAILED").select(
        "file_path", F.concat(F.lit(folder.rstrip("/") + "/"), base_name(F.col("file_path"))).alias("quarantine_path"))


def batch_outcome(ledger: DataFrame) -> DataFrame:
    """success and failure counts; the run fails iff nothing succeeded and
    something failed."""
    return ledger.agg(
        F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
    ).withColumn("run_failed", (F.col("succeeded") == 0) & (F.col("failed") > 0))


def plan_batch(files: DataFrame, lines: DataFrame, rules: DataFrame, ledger: DataFrame,
               existing: DataFrame, extensions: Sequence[str] = SUPPORTED_EXTENSIONS,
               broken: DataFrame | None = None) -> DataFrame:
    """F1 -> S1 -> F8 -> F2 -> F4 -> F5 on a manifest: the files that will load,
    with target, hash and version; plus FAILED rows for files of other extensions and for
    those in ``broken`` (``file_path, error_message``).
    Columns: file_path, file_order, target_table, file_hash, rows, status,
    error_message, _version_id."""
    routed = route_files(files, rules).where(F.col("target_table").isNotNull())
    st = extension_status(routed, extensions)
    if broken is not None:
        st = st.join(broken.withColumnRenamed("error_message", "_broken"), "file_path", "left").withColumns({
            "status": F.when(F.col("_broken").isNull(), F.col("status")).otherwise("FAILED"),
            "error_message": F.coalesce("error_message", "_broken")}).drop("_broken")
    bad = st.where(F.col("status") == "FAILED")
    fp = content_fingerprint(lines)
    good = st.where(F.col("status") == "SUCCESS").join(fp, "file_path", "left") \
        .withColumn("rows", F.coalesce(F.col("rows"), F.lit(0)))
    good = skip_empty(good)
    good = skip_already_loaded(good, ledger)
    good = assign_version(good, existing)
    bad = bad.select(*[c for c in bad.columns], F.lit(None).cast("string").alias("file_hash"),
                     F.lit(0).cast("bigint").alias("rows"), F.lit(None).cast("int").alias("_version_id"))
    cols = ["file_path", "file_order", "target_table", "file_hash", "rows", "status", "error_message", "_version_id"]
    return good.select(*cols).unionByName(bad.select(*cols))


def rows_for(plan: DataFrame, lines: DataFrame, load_ts: Column, extra: Sequence[str] = (), few_files: bool = False) -> DataFrame:
    """The rows to append: lines of the accepted files with lineage (F6, F7). Which version is
    the newest is found among the files, before their lines are joined. ``few_files``: the
    plan is short enough to broadcast, so lines stay where they are."""
    ok = latest_flags(plan.where(F.col("status") == "SUCCESS").select("file_path", "target_table", "file_hash", "_version_id"))
    rows = lines.join(F.broadcast(ok) if few_files else ok, "file_path")
    return stamp_lineage(rows, load_ts).select(
        "target_table", "line_no", "line", *extra, "_version_id", "_is_latest", "_file_name", "_file_hash",
        "_load_timestamp")
