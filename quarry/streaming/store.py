"""A log-structured table for marts that streams keep up to date.

Each micro-batch appends one run of rows; a manifest lists the runs that count. Reading merges
the runs. When a tier has FAN runs they are merged into one run of the next tier, so after n
batches at most FAN runs a tier and log(n) tiers are read, and each row is rewritten log(n)
times. The manifest is a small file written under its number; a number can be taken only
once, so readers see the runs before a merge or the run after it, never both.

A batch is appended once: one that the manifest already holds is left out, so retries of a
batch are exact. Batch numbers must rise, as a stream's do; a store belongs to one stream.

Rows lie in day folders. Runs that a merge has replaced stay for one more merge, for readers
that opened the manifest before, and are then removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources import sinks

FAN = 8
BATCH, DAY = "_batch", "_day"


class RunStore:
    """``merge`` turns the union of all runs' rows (with ``_batch``) into the table's rows."""

    def __init__(self, spark: SparkSession, root: str, schema: str, day: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.day, self.merge = spark, root.rstrip("/"), day, merge
        self.schema = T.StructType.fromDDL(schema)
        self.stored = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(DAY, T.DateType())])

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, dict]:
        """(number, content) of the newest manifest; (-1, empty) before the first."""
        path, fs = self._fs()
        if not fs.exists(path):
            return -1, {"runs": [], "retired": [], "last": -1}
        newest = max((int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()), default=-1)
        if newest < 0:
            return -1, {"runs": [], "retired": [], "last": -1}
        lines = self.spark.read.text(f"{self.root}/manifest/{newest}").collect()
        return newest, json.loads(lines[0].value)

    def _commit(self, number: int, content: dict) -> None:
        """Write manifest ``number``; fails if another writer has taken it."""
        path, fs = self._fs()
        fs.mkdirs(path)
        new = self.spark._jvm.org.apache.hadoop.fs.Path(path, f"_{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray((json.dumps(content) + "\n").encode()))
        out.close()
        final = self.spark._jvm.org.apache.hadoop.fs.Path(path, str(number))
        if fs.exists(final) or not fs.rename(new, final):
            fs.delete(new, False)
            raise RuntimeError(f"another writer changed {self.root}")
        for old in fs.listStatus(path):
            name = old.getPath().getName()
            if name.isdigit() and int(name) < number - 1:
                fs.delete(old.getPath(), False)

    def _paths(self, runs: list[dict]) -> list[str]:
        return [f"{self.root}/runs/{r['name']}" for r in runs]

    def _rows(self, runs: list[dict]) -> DataFrame:
        """The rows of some runs as stored, batch and day included."""
        read = self.spark.read.schema(self.stored)
        frames = [read.parquet(p) for p in self._paths(runs)]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], self.stored)

    def _write(self, rows: DataFrame, tier: int) -> dict:
        run = {"name": f"t{tier}-{uuid.uuid4().hex}", "tier": tier}
        rows.withColumn(DAY, F.to_date(self.day)).hint("rebalance", DAY).write.partitionBy(DAY).parquet(self._paths([run])[0])
        return run

    def append(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Add a batch's rows; returns them as stored (those of the first attempt on a retry)."""
        number, content = self.manifest()
        if batch_id > content["last"]:
            run = self._write(rows.select(*self.schema.names).withColumn(BATCH, F.lit(batch_id).cast("bigint")), 0) | {"batch": batch_id}
            self._commit(number + 1, content | {"runs": [*content["runs"], run], "last": batch_id})
            return self._rows([run])
        return self._rows([r for r in content["runs"] if r.get("batch") == batch_id])

    def stored_rows(self) -> DataFrame:
        """Rows of all runs that count, not merged."""
        return self._rows(self.manifest()[1]["runs"])

    def read(self) -> DataFrame:
        """The table."""
        return self.merge(self.stored_rows()).select(*self.schema.names)

    def compact(self) -> int:
        """Merge every full tier; returns how many runs are left."""
        while True:
            number, content = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for r in content["runs"]:
                tiers.setdefault(r["tier"], []).append(r)
            full = next((t for t in sorted(tiers) if len(tiers[t]) >= FAN), None)
            if full is None:
                return len(content["runs"])
            merged = self._write(self.merge(self._rows(tiers[full])).select(*self.schema.names, BATCH), full + 1)
            names = {r["name"] for r in tiers[full]}
            left = [r for r in content["runs"] if r["name"] not in names]
            self._commit(number + 1, content | {"runs": [*left, merged], "retired": sorted(names)})
            for gone in content["retired"]:
                sinks._remove(self.spark, f"{self.root}/runs/{gone}")


def added_up(keys: list[str], sums: list[str], largest: list[str], least: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge rows of one key by sums and extremes."""
    def merge(rows: DataFrame) -> DataFrame:
        aggs = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in [*largest, BATCH]] + [F.min(c).alias(c) for c in least]
        return rows.groupBy(*keys).agg(*aggs)

    return merge


def newest(keys: list[str], values: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of rows of one key, the latest batch's values count (numbers only, so the aggregate is hash-based)."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.max_by(c, BATCH).alias(c) for c in values], F.max(BATCH).alias(BATCH))

    return merge
