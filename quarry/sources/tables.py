"""Access to the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.session import prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy reader: ``Tables(spark, dir).events`` is a parquet scan, so column
    pruning and filter pushdown reach the files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.read(name)
        raise AttributeError(name)


def register_views(t: Tables, names=TABLES) -> None:
    """Register the tables as temp views so SQL text (mart bodies) can name them."""
    for n in names:
        t.read(n).createOrReplaceTempView(n)
