"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between,
hashed to 2**BITS places. FTRL-proximal keeps a rate per coordinate and an L1 term that
leaves most weights at exactly zero, so the model is a short list of (place, weight), small
enough to broadcast (at most 2**BITS entries; some thousands in practice).

The classifier is fitted on a bounded sample: the ``TRAIN_ROWS`` labelled documents with
the smallest hash of their id, in that order, in one task. Features are extracted, and all
documents scored, in parallel.

Defined results: null and empty texts have no features, and the bias alone scores them.
Without labelled rows every score is 0. Labels repeated for one id: toxic if one says so;
null labels are ignored. Rows stand alone otherwise; extra columns are ignored by
``score_texts`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import LETTERS_DIGITS, U64, mix, small_batches, stored, table, text_slices, words_of

BITS = 20
TRAIN_ROWS = 10_000
#: features of fewer sample rows are left out: they could only learn single texts by heart
LEAST_ROWS = 3
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.01
#: bytes of text at a time: features take about 60 bytes a byte
SLICE = 1 << 19
BIAS = 0  # place of the constant feature


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of words, word pairs and pairs around one word; may repeat."""
    row, word = words_of(texts, LETTERS_DIGITS)
    rows, codes = [row], [word]
    for gap, salt in ((1, 0xA5A5F00D), (2, 0x5EED1234)):
        same = row[gap:] == row[:-gap]
        rows.append(row[gap:][same])
        codes.append(mix((word[:-gap] * U64(3) + U64(salt)) ^ mix(word[gap:] + U64(salt)))[same])
    places = (np.concatenate(codes) >> U64(64 - bits)).astype(np.int64)
    return np.concatenate(rows), np.maximum(places, BIAS + 1)


def ftrl(examples: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over (distinct places, label)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at=slice(None)):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for places, label in examples:
            w = weights(places)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[places])
            n[places] += g * g
            z[places] += g - (np.sqrt(n[places]) - root) / ALPHA * w
    return weights()


def _distinct(row: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row << bits | place)
    return both >> bits, both & ((1 << bits) - 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) other than zero, from at most ``max_rows`` labelled documents."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("rank", F.xxhash64("id"))
    # the sample: a list of ids and labels, broadcast (max_rows rows at most)
    sample = known.orderBy("rank", "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("rank", "id", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(3), SLICE):
                part = batch.slice(start, stop - start)
                row, place = _distinct(*features(part.column(3), bits), bits)
                cut = np.searchsorted(row, np.arange(1, len(part)))
                lists = [np.append(p, BIAS).astype("<u4").tobytes() for p in np.split(place, cut)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lists, pa.binary())], ["rank", "id", "label", "places"])

    kind = rows.schema["id"].dataType.simpleString()
    examples = rows.mapInArrow(extract, f"rank bigint, id {kind}, label int, places binary")
    examples = stored(examples, "toxicity-sample")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cases = [(np.frombuffer(p, "<u4"), int(y)) for f in frames for p, y in zip(f["places"], f["label"], strict=True)]
        seen = np.zeros(1 << bits, np.int32)
        for places, _ in cases:
            seen[places] += 1
        seen[BIAS] = LEAST_ROWS
        for i, (places, y) in enumerate(cases):  # one by one: the whole lists go as the short ones come
            cases[i] = places[seen[places] >= LEAST_ROWS], y
        weights = ftrl(cases, bits) if cases else np.zeros(1)
        at = np.flatnonzero(weights)
        yield pd.DataFrame({"places": [at.astype("<i8").tobytes()], "weights": [weights[at].astype("<f8").tobytes()]})

    fitted = examples.repartition(1).sortWithinPartitions("rank", "id").select("label", "places").mapInPandas(fit, "places binary, weights binary").first()
    if fitted is None:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.frombuffer(fitted[0], "<i8"), np.frombuffer(fitted[1], "<f8")


def _scores(texts: pa.Array, dense: np.ndarray, trained: bool, bits: int) -> np.ndarray:
    if not trained:
        return np.zeros(len(texts))
    row, place = features(texts, bits)
    some = dense[place] != 0
    row, place = _distinct(row[some], place[some], bits)
    total = dense[BIAS] + np.bincount(row, dense[place], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row per row: doc_id, score (0 to 1)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights = shared.value
        dense = np.zeros(1 << bits)
        dense[places] = weights
        for batch in batches:
            for start, stop in text_slices(batch.column(1), SLICE):
                part = batch.slice(start, stop - start)
                scores = _scores(part.column(1), dense, len(places) > 0, bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weights = shared.value
        dense = np.zeros(1 << bits)
        dense[places] = weights
        for batch in batches:
            for start, stop in text_slices(batch.column(at), SLICE):
                part = batch.slice(start, stop - start)
                yield part.filter(pa.array(_scores(part.column(at), dense, len(places) > 0, bits) < threshold))

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def held_out(id_col: str, folds: int, fold: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id", 5, 0)))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
