"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on. Runtime SQL confs are re-applied to a session
# handed in by a caller (the driver, a notebook) because results depend on them.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a broadcast side must be small; larger sides fall back to sort-merge joins
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # HotSpot does not JIT-compile methods over 8000 bytecodes; a wide generated
    # stage above that runs interpreted (5x slower measured on the quantity
    # parser). At 8000 Spark falls back to per-operator code that does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(app: str = "quarry", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests, bench and scripts. On a cluster, pass the
    cluster's own session to the operators instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # local runs only: list partition folders with a few tasks, not one per folder,
        # and skip the .crc side files of the checksummed local filesystem
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(2 * cpus))
        .config("spark.hadoop.fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only when it is unset (local
    tests) is a private folder made and registered."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local["):
            # a machine-local folder would not survive a lost executor
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
