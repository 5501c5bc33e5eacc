"""File sources.

Listing is itself a Spark job (``binaryFile`` with ``recursiveFileLookup``,
content not selected so it is never read), and paths stay in DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from quarry.sources.objects import process_objects

MANIFEST_SCHEMA = "root string, path string, length bigint, modification_time timestamp, error string"


def read_by_extension(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a delimited file (or folder) by its extension; any other
    extension raises ``ValueError('Unsupported file type: …')``."""
    ext = "." + path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext == ".csv":
        opts = {"header": "true", "inferSchema": "true", **options}
        return spark.read.options(**opts).csv(path)
    raise ValueError(f"Unsupported file type: {ext}")


def _empty_files(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The files of a listing that hold nothing, which a scan leaves out: names that the
    listing knows and its rows don't have."""
    def spelled(uri: str) -> Column:  # local paths come with one slash or three
        return F.regexp_replace(uri, "^file:/+", "file:/")

    names = spark.createDataFrame([(n,) for n in listed.inputFiles()], "uri string")
    rows = []
    for r in names.join(listed.select(spelled("uri").alias("known")), spelled("uri") == F.col("known"), "left_anti").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r.uri))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        rows.append((path.toString(), status.getLen(), status.getModificationTime()))
    return spark.createDataFrame(rows, "path string, length bigint, millis bigint").select("path", "length", F.timestamp_millis("millis").alias("modification_time"))


def file_manifest(spark: SparkSession, roots: Sequence[str], regex: str | None = None) -> DataFrame:
    """Every file under each root (recursively; names that begin with ``_`` or ``.`` are
    not listed), empty ones too, optionally kept when the full path matches ``regex``. A
    root that cannot be listed gives one row with its error instead of failing the manifest."""
    out = None
    for root in roots:
        try:
            listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
                      .select("path", "length", F.col("modificationTime").alias("modification_time"), F.col("_metadata.file_path").alias("uri")))
            df = listed.drop("uri").unionByName(_empty_files(spark, listed)).select(
                F.lit(root).alias("root"), "path", "length", "modification_time", F.lit(None).cast("string").alias("error"))
        except AnalysisException as e:
            df = spark.createDataFrame([(root, None, None, None, str(e))], MANIFEST_SCHEMA)
        if regex:
            df = df.where(F.col("path").isNull() | F.col("path").rlike(regex))
        out = df if out is None else out.unionByName(df)
    return out


def import_folder(spark: SparkSession, folder: str, fmt: str = "parquet") -> list[str]:
    """Register every table exported under ``folder/<table>/`` as a temp
    view; returns the table names. Names come from a distributed listing; only
    the distinct names (one per table) reach the driver."""
    base = folder.rstrip("/")
    names = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        .select(F.regexp_extract("path", r"^.*?/" + re.escape(base.split("/")[-1]) + r"/([^/]+)/", 1).alias("t"))
        .where(F.col("t") != "").distinct().collect()
    )
    tables = sorted(r.t for r in names if not r.t.startswith(("_", ".")))
    for t in tables:
        spark.read.format(fmt).load(f"{base}/{t}").createOrReplaceTempView(t)
    return tables


def relocate_keys(manifest: DataFrame, src_prefix: str, dst_prefix: str) -> DataFrame:
    """S5 key mapping: every object whose path, or key inside its bucket, starts with
    ``src_prefix`` gets the same relative key under ``dst_prefix`` (a column expression, no driver loop)."""
    key = F.when(F.col("path").startswith(src_prefix), F.col("path")).otherwise(F.regexp_replace("path", "^[A-Za-z0-9]+://[^/]*/", ""))
    rel = F.substring(key, len(src_prefix) + 1, 1 << 30)
    return manifest.where(key.startswith(src_prefix)).select("path", F.concat(F.lit(dst_prefix), rel).alias("dest_path"))


def relocate_objects(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """Every object under ``src`` copied byte for byte under ``dst``, relative keys kept
    (``process_objects``: balanced by size, one row per object with its outcome)."""
    listed = file_manifest(spark, [src]).where("error is null").select("path", "length")
    root = src.rstrip("/") + "/"
    prefixes = listed.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))  # one spelling of local paths
    keys = relocate_keys(prefixes, root.removeprefix("file://"), dst.rstrip("/") + "/").join(prefixes, "path")
    return process_objects(keys.select("path", "dest_path", "length"))


def typed_rows_source(spark: SparkSession, path: str, schema: str | T.StructType, **options) -> DataFrame:
    """JSON rows with a fixed schema; an unreachable source gives an empty
    frame of that schema."""
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
