"""Exact duplicate removal against a persistent digest index.

The index is a Spark table of digests, bucketed and sorted by digest. A batch is first
reduced to one row per digest (partial aggregation, so a text holding a third of all rows
costs one row per task), anti-joined to the index bucket by bucket, and appended: new digests
with the id that stays, known ones with their number of rows. Batches have numbers, and a batch
that the index holds is not added again. Everything is DataFrame expressions; no Python runs on the executors.

Defined results: a null text counts as empty. Texts are equal when identical after
lower-casing A-Z only. Of equal texts the largest id stays (a null id is smaller than any
other). Rows repeated with one id and one text are one document: they share its decision.
An empty table gives an empty result. Extra columns are ignored by ``mark_duplicates`` and
kept, whatever their names, by ``drop_duplicates``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table
from quarry.session import shared_dir

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    normal = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.sha2(F.encode(normal, "UTF-8"), 256)


class DigestIndex:
    """A table ``(digest, keep_id, group_size, batch)`` bucketed and sorted by digest.

    The batch that brings a digest first adds a row with the id that stays; later batches add
    their number of rows, without an id. A batch is added once: a rerun of one that the table
    holds changes nothing and is told the same, so a job may fail at any point and run again.

    ``buckets`` is fixed when the table is made; about 1 GB of digests per bucket (10 million)
    is a good size. A batch adds one sorted file per bucket. The files lie in the shared folder."""

    COLUMNS = "digest STRING, keep_id BIGINT, group_size BIGINT, batch BIGINT"

    def __init__(self, spark: SparkSession, name: str, buckets: int = 16, folder: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.folder = folder or f"{shared_dir(spark)}/{name}"

    def create(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'"
        )

    def read(self) -> DataFrame:
        self.create()
        return self.spark.table(self.name)

    def next_batch(self) -> int:
        last = self.read().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def unseen(self, groups: DataFrame, batch: int) -> DataFrame:
        """Groups whose digest no other batch has brought: a sort-merge anti-join that reads the
        index in its buckets, without a shuffle on that side."""
        others = self.read().where(F.col("batch") != batch).select("digest")
        return groups.hint("merge").join(others, "digest", "left_anti")

    def add_batch(self, groups: DataFrame, batch: int) -> DataFrame:
        """Add a batch's groups; returns those that it brings first, as
        ``(digest, keep_id, group_size)``."""
        new = stored(self.unseen(groups, batch).select("digest", "keep_id", "group_size"), "new-digests")
        if not self.read().where(F.col("batch") == batch).limit(1).count():
            brought = new.select("digest", F.lit(True).alias("fresh"))
            rows = groups.join(brought, "digest", "left").select("digest", F.when(F.col("fresh"), F.col("keep_id")).alias("keep_id"), "group_size", F.lit(batch).cast("bigint").alias("batch"))
            rows.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest") \
                .mode("append").saveAsTable(self.name)
        return new

    def groups(self) -> DataFrame:
        """``digest, keep_id, group_size, first_batch`` over all batches; read in buckets."""
        return self.read().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.min("batch").alias("first_batch"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _marked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    # both sides are scans of written tables, so a digest with a third of the rows is one
    # row on the right and is split by the adaptive skew join on the left
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == F.col("first_batch"))
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def mark_duplicates(docs: DataFrame, index: DigestIndex, batch: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, after adding
    the docs to the index as one batch (a rerun gives its number; else it is the next).

    keep_id is the id that the first batch with the text kept, group_size counts the rows of
    all batches so far; a document whose text an earlier batch holds is not kept."""
    batch = index.next_batch() if batch is None else batch
    rows = stored(hashed(docs, id_col, text_col).withColumn("batch", F.lit(batch)), "digests")
    index.add_batch(stored(digest_groups(rows), "digest-groups"), batch)
    return _marked(rows, stored(index.groups(), "digest-groups"))


def drop_duplicates(docs: DataFrame, index: DigestIndex, batch: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns: per text that the index lacks, the
    row with the largest id, one of them if that id is repeated."""
    names = docs.columns
    batch = index.next_batch() if batch is None else batch
    new = index.add_batch(stored(digest_groups(hashed(docs, id_col, text_col)), "digest-groups"), batch).select("digest")
    whole = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    best = whole.groupBy(digest(F.col(at_text)).alias("digest")).agg(
        F.max_by(F.struct(*whole.columns), F.struct(at_id)).alias("row")
    )
    return best.join(new, "digest", "left_semi").select("row.*").toDF(*names)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two batches, the larger ids first, so that of equal texts the
    largest id is always the first in the index."""
    rows = stored(hashed(table(spark, sf_dir, "documents")), "digests")
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    late = F.coalesce(F.col("doc_id") < (0 if lo is None else (lo + hi) // 2), F.lit(True))
    rows = rows.withColumn("batch", late.cast("bigint"))
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")
    for batch in (0, 1):
        index.add_batch(stored(digest_groups(rows.where(F.col("batch") == batch)), "digest-groups"), batch)
    marked = _marked(rows, stored(index.groups(), "digest-groups"))
    index.drop()  # a query of its own leaves no table; the result reads stored files only
    return marked


OP10_SQL = """
WITH h AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256
)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, h.text_sha256
FROM h JOIN g USING (text_sha256)
"""
