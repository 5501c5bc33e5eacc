"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A trigram is bound by multiplying its
three letters' vectors, the first permuted twice and the second once (a permutation is a
rotation by one place). A document is the sum of its trigrams' vectors, a language the sum
of its documents'; a document gets the language with the largest cosine.

Letters are lower-cased; each stretch of other characters is one blank. Document vectors
are products of a batch's trigram counts with the trigram vectors. Language sums are whole
numbers, added up by Spark per (language, place), so training covers all rows and its
result doesn't depend on the partitions.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if no
language was learned. Ties go to the first language in alphabetical order. Rows with a null
text or language teach nothing. Rows stand alone; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, text_slices
from quarry.llm.toxicity import held_out

DIMENSIONS = 1024
#: bytes, rows and distinct trigrams worked on at a time
SLICE, ROWS, KINDS = 1 << 20, 128, 8192
#: letters whose vectors are kept between batches
HELD = 4096
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng((code, dimensions, 2718)).choice(np.array([-1, 1], np.int8), dimensions)


class Trigrams:
    """Vectors of a batch's distinct trigrams, from the letters' vectors met so far."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.known: dict[int, np.ndarray] = {}

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of some letters, a row each. Those of earlier batches are kept while they
        are few; a batch with very many letters needs only room for its own."""
        if len(self.known) > HELD:
            self.known.clear()
        out = np.empty((len(codes), self.dimensions), np.int8)
        for i, code in enumerate(codes.tolist()):
            v = self.known.get(code)
            if v is None:
                v = letter_vector(code, self.dimensions)
                if len(self.known) <= HELD:
                    self.known[code] = v
            out[i] = v
        return out

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sums of trigram vectors, whether the text has a letter), one row per text."""
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        strings = [f" {t} " for t in low.to_pylist()]
        sizes = np.array([len(t) for t in strings])
        code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = np.where(_is_letter()[code], code, 0)
        row = np.repeat(np.arange(len(strings)), sizes)
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])
        code, row = code[keep], row[keep]
        letters, small = np.unique(code, return_inverse=True)
        width = len(letters)
        has = np.bincount(row[code != 0], minlength=len(strings)) > 0
        inside = row[2:] == row[:-2]
        gram = ((small[:-2] * width + small[1:-1]) * width + small[2:])[inside]
        if not len(gram):
            return np.zeros((len(strings), self.dimensions)), has
        kinds, which = np.unique(gram, return_inverse=True)
        order = np.argsort(which, kind="stable")
        which, rows = which[order], row[2:][inside][order]
        sums = np.zeros((len(strings), self.dimensions))
        for first in range(0, len(kinds), KINDS):  # a few thousand trigrams at a time
            some = kinds[first : first + KINDS]
            lo, hi = np.searchsorted(which, (first, first + KINDS))
            counts = np.bincount(rows[lo:hi] * len(some) + which[lo:hi] - first, minlength=len(strings) * len(some))
            a, b, c = some // (width * width), some // width % width, some % width
            used, at = np.unique(np.concatenate((a, b, c)), return_inverse=True)  # at most three letters a trigram
            plain, (a, b, c) = self._letters(letters[used]), at.reshape(3, -1)
            vectors = np.roll(plain, 2, axis=1)[a] * np.roll(plain, 1, axis=1)[b] * plain[c]
            # whole numbers below 2**24 are exact in single precision
            sums += counts.reshape(len(strings), len(some)).astype(np.float32) @ vectors.astype(np.float32)
        return sums, has


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for start, stop in text_slices(batch.column(column), SLICE):
        for at in range(start, stop, ROWS):
            yield batch.slice(at, min(ROWS, stop - at))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each language: the sum of its documents' vectors (languages x dimensions
    numbers come to the driver)."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams, sums = Trigrams(dimensions), {}
        for batch in batches:
            for part in _slices(batch, 1):
                vectors, _ = trigrams.documents(part.column(1))
                langs = np.array(part.column(0).to_pylist())
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    parts = rows.mapInArrow(bundle, "lang string, sums array<bigint>")
    places = parts.select("lang", F.posexplode("sums").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    learned: dict[str, np.ndarray] = {}
    for lang, place, value in places.collect():
        learned.setdefault(lang, np.zeros(dimensions))[place] = value
    return {lang: v for lang, v in sorted(learned.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per row: doc_id, lang_pred, score (cosine, 0 if negative)."""
    names = list(prototypes)
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names]) if names else np.zeros((0, dimensions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = Trigrams(dimensions)
        for batch in batches:
            for part in _slices(batch, 1):
                vectors, has = trigrams.documents(part.column(1))
                langs, scores = ["und"] * len(part), np.zeros(len(part))
                if names:
                    size = np.linalg.norm(vectors, axis=1)
                    near = vectors @ unit.T / np.where(size > 0, size, 1)[:, None]
                    best = near.argmax(axis=1)
                    scores = np.where(has, np.clip(near[np.arange(len(part)), best], 0, 1), 0.0)
                    langs = [names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op7_hyper_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 3, 1)
    guessed = predict(docs, train(docs.where(~out)))
    return guessed.select("doc_id", out.alias("held_out"), "lang_pred", "score")
