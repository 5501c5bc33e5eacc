"""Sinks (S8-S11): append with auto-create, atomic full refresh, append
refresh, partitioned layout writes.

Tables are parquet folders registered in the session catalog. A full refresh
writes a new versioned folder and then points the table at it, so readers
never see a half-written target and a failed build leaves it untouched.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def _quote(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def full_refresh_swap(df: DataFrame, table: str, base_path: str) -> str:
    """Build ``<base>/<table>/v=<id>``, then switch ``table`` to it. If the
    build fails the table still points at its previous folder and the failed
    folder is removed; after the switch the previous folder is removed. A new
    schema replaces the table's."""
    spark = df.sparkSession
    loc = f"{base_path.rstrip('/')}/{table.replace('.', '__')}/v={uuid.uuid4().hex}"
    try:
        df.write.mode("errorifexists").parquet(loc)
    except Exception:
        _remove(spark, loc)
        raise
    switch_table(spark, table, loc, df.schema)
    return loc


def switch_table(spark: SparkSession, table: str, loc: str, schema: T.StructType) -> None:
    """Point ``table`` (made if missing) at the parquet files below ``loc``, whatever
    folders they lie in; a previous versioned folder (``…/v=<id>…``) is removed."""
    old = None
    if _table_exists(spark, table):
        old = spark.sql(f"DESCRIBE FORMATTED {_quote(table)}").where("col_name = 'Location'").first()["data_type"]
        if [(f.name, f.dataType) for f in spark.table(table).schema] == [(f.name, f.dataType) for f in schema]:
            spark.sql(f"ALTER TABLE {_quote(table)} SET LOCATION '{loc}'")
            spark.catalog.refreshTable(table)
        else:
            spark.sql(f"DROP TABLE {_quote(table)}")
    if not _table_exists(spark, table):
        spark.catalog.createTable(table, path=loc, source="parquet", schema=schema, recursiveFileLookup="true")
    if old and "/v=" in old:
        _remove(spark, re.sub(r"(/v=[^/]+).*", r"\1", old))


def append_autocreate(df: DataFrame, table: str, base_path: str) -> None:
    """Create the table empty from the frame's schema when missing, then append."""
    spark = df.sparkSession
    if not _table_exists(spark, table):
        loc = f"{base_path.rstrip('/')}/{table.replace('.', '__')}"
        spark.createDataFrame([], df.schema).write.mode("overwrite").option("path", loc).saveAsTable(table)
    df.write.mode("append").insertInto(table)


def append_refresh(df: DataFrame, table: str, base_path: str) -> None:
    """Insert the result into the target; reruns accumulate."""
    append_autocreate(df, table, base_path)


def partitioned_write(df: DataFrame, path: str, partition_by: Sequence[str], order_by: Sequence[str],
                      files_per_partition: int = 4, mode: str = "overwrite") -> None:
    """One folder per partition value, rows sorted by ``order_by`` inside
    each file (parquet min/max stats then skip row groups). Rows are spread
    over ``files_per_partition`` tasks per partition value by a hash of the
    sort key, so one hot partition value is written by several tasks. The
    shuffle gets an explicit partition count: AQE may not merge it into a few
    tasks that would then each write thousands of folders one by one."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in order_by]), F.lit(files_per_partition))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartition(n, *[F.col(c) for c in partition_by], salt)
        .sortWithinPartitions(*order_by)
        .write.mode(mode)
        .partitionBy(*partition_by)
        .parquet(path)
    )
