"""Files as objects: copied, moved, compressed or deleted byte for byte by Spark tasks (S5,
S12, F10).

A job takes rows ``(path, dest_path, length)``, deals them out by size, and each task streams
its objects in pieces, so memory holds one piece whatever an object's size. Every outcome is a
row, written to the shared folder: one object that fails does not stop the others. Jobs may
be repeated: a copy lands under a name of its own and is then renamed (on stores that rename),
and a move whose object is already at its destination counts as done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.ingest import base_name
from quarry.session import scratch_path

PIECE = 8 << 20
OUTCOME = "path string, dest_path string, length bigint, written bigint, status string, error string"
STRATEGIES = ("none", "compress", "move", "move_and_compress", "delete")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it, taken as it stands."""
    scheme, sep, rest = uri.partition("://")
    if not sep or scheme == "file":
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    bucket, _, key = rest.partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{bucket}")
    return store, f"{root.rstrip('/')}/{key}"


def _one(path: str, dest: str | None, compress: bool, remove: bool) -> int | None:
    """Work on one object; returns the bytes read (None without a destination)."""
    store, name = _store(path)
    read = None
    there = store.get_file_info(name).type != fs.FileType.NotFound
    if dest is not None:
        out_store, out = _store(dest)
        if not there and remove and out_store.get_file_info(out).type == fs.FileType.File:
            return None  # an earlier run has moved it
        out_store.create_dir(out.rsplit("/", 1)[0], recursive=True)
        renames = isinstance(out_store, (fs.LocalFileSystem, fs.HadoopFileSystem))
        part = f"{out.rsplit('/', 1)[0]}/._{uuid.uuid4().hex}" if renames else out
        read = 0
        with store.open_input_stream(name, compression=None) as src, out_store.open_output_stream(part, compression="gzip" if compress else None) as sink:
            while piece := src.read(PIECE):
                sink.write(piece)
                read += len(piece)
        if renames:
            out_store.move(part, out)
    if remove and there:
        store.delete_file(name)
    return read


def dealt_by_size(objects: DataFrame, tasks: int) -> DataFrame:
    """Objects in ``tasks`` partitions of about equal bytes: in order of falling size, slice by
    slice, every partition gets one in turn."""
    sliced = objects.orderBy(F.desc("length")).withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    turn = F.row_number().over(Window.partitionBy("_slice").orderBy("_at")) + F.col("_slice")
    return sliced.withColumn("_task", F.pmod(turn, F.lit(tasks))).repartition(tasks, "_task").drop("_slice", "_at", "_task")


def process_objects(objects: DataFrame, compress: bool = False, remove: bool = False) -> DataFrame:
    """Copy every ``path`` to its ``dest_path`` (gzip-compressed if asked; NULL: nowhere), then
    delete it if ``remove``. Returns one row per object: bytes read, status SUCCESS or FAILED,
    error. An object that can't be read or written fails alone."""
    spark = objects.sparkSession

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, dest, length in zip(frame.path, frame.dest_path, frame.length):
                try:
                    read = _one(path, dest if isinstance(dest, str) else None, compress, remove)
                    short = read is not None and not pd.isna(length) and read != length
                    rows.append((path, dest, length, read, "FAILED" if short else "SUCCESS", f"{read} of {length} bytes" if short else None))
                except (OSError, ValueError) as e:
                    rows.append((path, dest, length, None, "FAILED", str(e)))
            yield pd.DataFrame(rows, columns=["path", "dest_path", "length", "written", "status", "error"]).astype({"length": "Int64", "written": "Int64"})

    plain = objects.select("path", F.col("dest_path").cast("string").alias("dest_path"), F.col("length").cast("bigint").alias("length"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done = scratch_path(spark, "objects")
    dealt_by_size(plain, tasks).mapInPandas(work, OUTCOME).write.parquet(done)
    return spark.read.schema(OUTCOME).parquet(done)


def postprocess(files: DataFrame, strategy: str, archive: str | None = None) -> DataFrame:
    """What happens to input files ``(path, length)`` after they were loaded.

    ``none`` leaves them; ``compress`` writes ``<path>.gz`` beside each; ``move`` moves them
    to ``archive``; ``move_and_compress`` puts the compressed copy there; ``delete`` deletes
    them. Where a strategy only makes a copy, the file itself stays. An unknown strategy, or a
    move without an archive, raises."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown post-processing strategy: {strategy}")
    if "move" in strategy and not archive:
        raise ValueError(f"{strategy} needs an archive folder")
    here, there = F.col("path"), F.concat(F.lit(f"{(archive or '').rstrip('/')}/"), base_name(F.col("path")))
    dest = {"compress": F.concat(here, F.lit(".gz")), "move": there, "move_and_compress": F.concat(there, F.lit(".gz"))}.get(strategy, F.lit(None).cast("string"))
    objects = files.select("path", dest.alias("dest_path"), "length")
    if strategy == "none":
        return objects.select("path", "dest_path", "length", F.lit(None).cast("bigint").alias("written"), F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error"))
    return process_objects(objects, compress="compress" in strategy, remove=strategy in ("move", "delete"))
