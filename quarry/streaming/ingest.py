"""Incremental file ingestion.

A file-source stream picks up only files it has not seen (its checkpoint
records them); every micro-batch runs the set-based ingestion steps (F1-F9)
on the new files and appends the loaded rows and the ledger rows. Run it with
``availableNow`` on a schedule (every 15 minutes in the source) or
continuously.

The stream itself carries names, times and lengths only. A batch's files are read line by
line, large ones in splits by several tasks; line numbers are each split's own numbers plus
the counts of the splits before it, so no file is ever one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from quarry.operators import ingest as ig
from quarry.operators.monitoring import MOST_SETTINGS, settings_side
from quarry.session import scratch_path
from quarry.sources import objects, sinks

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LINE_SCHEMA = "file_path string, block_start bigint, seq bigint, line string"
UNREADABLE = "could not be read whole"


def incoming_files(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None, ignore: str | None = None) -> DataFrame:
    """One row per new file (``file_path``, ``path``, ``modified``, ``length``); contents aren't
    read. Files whose name matches ``ignore`` are left out."""
    r = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    files = r.load(folder).select(F.col("_metadata.file_path").alias("file_path"), "path", F.col("modificationTime").alias("modified"), "length")
    return files.where(~F.col("path").rlike(ignore)) if ignore else files


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file_path, line_no, line`` of text files, numbered from 0 in file order.

    The lines are written once with their split's start and a number that rises within a
    split; a split's first line number is the count of lines in the file's earlier splits.
    The list of splits is counted, and broadcast while it is short, so lines aren't moved.
    Files that vanish or break while being read give the lines that could be read."""
    def scan(some: list[str]) -> DataFrame:
        opened = spark.read.options(lineSep="\n", ignoreCorruptFiles="true", ignoreMissingFiles="true").text(some)
        return opened.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
                             F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))

    try:
        lines = scan(paths) if paths else spark.createDataFrame([], LINE_SCHEMA)
    except AnalysisException:  # some are gone already
        there = [p for p in paths if sinks.exists(spark, p)]
        lines = scan(there) if there else spark.createDataFrame([], LINE_SCHEMA)
    path = scratch_path(spark, "lines")
    lines.write.parquet(path)
    written = spark.read.schema(LINE_SCHEMA).parquet(path)
    splits = written.groupBy("file_path", "block_start").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    earlier = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file_path", "block_start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return written.join(settings_side(offsets), ["file_path", "block_start"]).select("file_path", (F.col("seq") + F.col("shift")).alias("line_no"), "line")


def unreadable(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``file_path, error_message`` of files whose lines don't make up their length (the last
    newline may be missing)."""
    read = lines.groupBy("file_path").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    got = F.coalesce("bytes", F.lit(0))
    short = files.join(read, "file_path", "left").where(~(F.col("length") - got).isin(0, -1))
    message = F.concat(F.lit(f"{UNREADABLE}: "), got, F.lit(" of "), F.col("length"), F.lit(" bytes"))
    return short.select("file_path", message.alias("error_message"))


LEDGER_SCHEMA = ("file_path string, file_hash string, loaded_at timestamp_ntz, target_table string, "
                 "status string, error_message string, path string, length bigint")
ROWS_SCHEMA = ("target_table string, line_no bigint, line string, _version_id int, "
               "_file_name string, _file_hash string, _load_timestamp timestamp_ntz")


def init_outputs(spark: SparkSession, out: str) -> None:
    """Create the ledger and rows datasets empty when they do not exist yet
    (``mode("ignore")`` writes nothing when they do), so every batch can read
    what earlier batches wrote."""
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("ignore").parquet(f"{out}/ledger/batch_id=-1")
    spark.createDataFrame([], ROWS_SCHEMA).write.mode("ignore").parquet(f"{out}/rows/batch_id=-1")


def _written(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What earlier batches wrote under ``path`` (a retried batch ignores its own
    previous attempt)."""
    return spark.read.parquet(path).where(F.col("batch_id") != batch_id)


def ingest_batch(spark: SparkSession, files: DataFrame, batch_id: int, rules: DataFrame, out: str,
                 run_ts, extensions=("txt", "csv"), postprocess: str = "none", archive: str | None = None) -> None:
    """F1-F9 on one batch of new files, against the ledger and versions already
    written under ``out``; then S12 on the files that were loaded and F10 on those that failed.
    Outputs go under ``batch_id=<id>`` folders. The ledger is written last and so commits the
    batch: a retry before it replaces the batch's rows, one after it only repeats what
    happens to the files. A file that can't be read whole fails alone (F9) and loads nothing."""
    if not sinks.exists(spark, f"{out}/ledger/batch_id={batch_id}/_SUCCESS"):
        _load_batch(spark, files, batch_id, rules, out, run_ts, extensions)
    entries = spark.read.parquet(f"{out}/ledger/batch_id={batch_id}").select("file_path", "path", "length", "status")
    loaded = objects.postprocess(entries.where("status = 'SUCCESS'"), postprocess, archive)
    failed = objects.process_objects(
        entries.where("status = 'FAILED'").select("path", F.concat(F.lit(f"{out}/quarantine/batch_id={batch_id}/"), ig.base_name(F.col("path"))).alias("dest_path"), "length"), remove=True)
    loaded.withColumn("action", F.lit(postprocess)).unionByName(failed.withColumn("action", F.lit("quarantine"))) \
        .write.mode("overwrite").parquet(f"{out}/actions/batch_id={batch_id}")


def _load_batch(spark: SparkSession, files: DataFrame, batch_id: int, rules: DataFrame, out: str, run_ts, extensions) -> None:
    ledger_path, rows_path = f"{out}/ledger", f"{out}/rows"
    ledger = _written(spark, ledger_path, batch_id).where(F.col("status") == "SUCCESS").select("file_hash")
    existing = _written(spark, rows_path, batch_id).select("target_table", "_version_id")
    files = files.persist()
    # older files first; the path breaks ties
    order = F.concat(F.date_format("modified", "yyyyMMddHHmmss.SSSSSS"), F.lit("|"), F.col("file_path"))
    manifest = files.select("file_path", order.alias("file_order"))
    wanted = ig.extension_status(ig.route_files(manifest, rules).where("target_table is not null"), extensions).where("status = 'SUCCESS'")
    # the names of one batch's files, which the stream's driver lists in any case
    paths = [r.path for r in files.join(wanted.select("file_path"), "file_path", "left_semi").select("path").toLocalIterator()]
    lines = read_lines(spark, paths)
    broken = unreadable(files.join(wanted.select("file_path"), "file_path", "left_semi"), lines)
    plan = ig.plan_batch(manifest, lines, rules, ledger, existing, extensions, broken).persist()
    ts = F.lit(run_ts).cast("timestamp_ntz")
    # a few files with many lines each: a join by file would put a file's lines in one task
    few = plan.limit(MOST_SETTINGS + 1).count() <= MOST_SETTINGS
    # which version is the newest changes with later batches, so it is found when reading
    ig.rows_for(plan, lines, ts, few_files=few).drop("_is_latest").withColumn("batch_id", F.lit(batch_id)) \
        .write.mode("overwrite").parquet(f"{rows_path}/batch_id={batch_id}")
    entries = ig.ingestion_ledger(plan, ts).join(files.select("file_path", "path", "length"), "file_path")
    entries.withColumn("batch_id", F.lit(batch_id)) \
        .write.mode("overwrite").parquet(f"{ledger_path}/batch_id={batch_id}")
    plan.unpersist()
    files.unpersist()


def loaded_rows(spark: SparkSession, out: str) -> DataFrame:
    """Every loaded row with ``_is_latest``: whether its version is its target's newest over
    all batches (F6). The newest versions, one row per target, are broadcast while they
    are few, so that a target's or a version's lines are never gathered."""
    rows = spark.read.parquet(f"{out}/rows")
    return ig.latest_flags(rows, settings_side(ig.newest_versions(rows)))


def run_incremental(spark: SparkSession, folder: str, rules: DataFrame, out: str, checkpoint: str, run_ts,
                    max_files_per_trigger: int | None = None, postprocess: str = "none", archive: str | None = None) -> None:
    """process every file not seen before, then stop (``availableNow``). Loaded files are
    post-processed (S12), failed ones quarantined (F10); a run in which files failed and none
    succeeded raises (F11) after its ledger rows are written."""
    if postprocess not in objects.STRATEGIES:
        raise ValueError(f"Unknown post-processing strategy: {postprocess}")
    init_outputs(spark, out)
    batches = []
    # copies that `compress` puts beside the files aren't new files
    stream = incoming_files(spark, folder, max_files_per_trigger, r"\.gz$" if postprocess == "compress" else None)

    def sink(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(spark, batch, batch_id, rules, out, run_ts, postprocess=postprocess, archive=archive)
        batches.append(batch_id)

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if batches:
        outcome = ig.batch_outcome(spark.read.parquet(f"{out}/ledger").where(F.col("batch_id").isin(batches))).first()
        if outcome.run_failed:
            raise RuntimeError(f"all {outcome.failed} files of the run failed")
