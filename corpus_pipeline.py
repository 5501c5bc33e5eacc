"""Corpus preparation, end to end: toxic documents go, exact and near copies go, secrets
are masked, and what stays is packed into training sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import cutting_stock, dart_minhash, digest_index, secret_scan
from quarry.llm import toxicity as toxic_words
from quarry.llm.bpe import tokenizer_path
from quarry.llm.common import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns as op4's does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxic_words.train(docs, labels.where(~toxic_words.held_out("doc_id", 5, 0)))
    return toxic_words.drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, by an index of this run's own."""
    index = digest_index.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex[:12]}")
    kept = digest_index.drop_duplicates(docs, index)
    index.drop()
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return dart_minhash.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows."""
    return secret_scan.mask_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 ids."""
    return cutting_stock.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: a trained classifier and a linear program can't be stated in SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's documents are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
