"""Secrets in texts: fixed patterns, and character Markov models for strings that no pattern names.

Two first-order Markov models over letters and digits are compared by their log-likelihood
ratio: one of random strings, one of ordinary identifiers. Their labelled samples come from
the documents: what a fixed pattern matched is a random string, a long run of letters (with
digits at its end, perhaps) outside such matches is an identifier. Transition counts are
summed over all documents (two tables of 62 x 62, whatever the corpus holds); priors stand in
where samples are few. A run of 20 or more characters with letters and
digits is a secret if the mean ratio per transition reaches ``threshold``.

Positions are code points, ends exclusive. Defined results: null and empty texts have no
spans (a null text stays null when masked); rows stand alone, so repeated rows are scanned
alike; an empty table gives an empty result; extra columns are ignored by ``find_secrets``
and kept by ``mask_secrets``. A span of the models never overlaps one of a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, table, text_slices

KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
THRESHOLD = 1.5
_SIZE = len(ALPHABET)
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(_SIZE)

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # each match is a whole run, as leftmost matches start at a run's start
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # holds every hex match, and every run for the models
_IDENTIFIER = re.compile(r"[A-Za-z_-]+[0-9]*$")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]], list[tuple[int, int]]]:
    """Pattern spans, the random strings inside them, and all long runs of a text."""
    spans: list[Span] = []
    values: list[tuple[int, int]] = []
    runs = [m.span() for m in _RUN.finditer(text)]
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 6:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(1))
    for m in _ACCESS.finditer(text) if "AKIA" in text else ():
        if m.end() - m.start() >= 20:
            spans.append((m.start(), 1, m.end()))
            values.append(m.span())
    for start, stop in runs:
        for m in _HEX.finditer(text, start, stop) if stop - start >= 24 else ():
            spans.append((m.start(), 2, m.end()))
            values.append(m.span())
    return spans, values, runs


def _transitions(run: str) -> np.ndarray:
    """Codes of neighbouring letters and digits, as first * 62 + second."""
    code = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
    both = (code[:-1] >= 0) & (code[1:] >= 0)
    return (code[:-1] * _SIZE + code[1:])[both]


def _counted(texts: Iterator[str | None], counts: np.ndarray) -> None:
    for text in texts:
        if not text:
            continue
        spans, values, runs = base_spans(text)
        for start, stop in set(values):
            np.add.at(counts[0], _transitions(text[start:stop]), 1)
        for start, stop in runs:
            if not any(a < stop and start < b for a, _, b in spans) and _IDENTIFIER.match(text, start, stop):
                np.add.at(counts[1], _transitions(text[start:stop]), 1)


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each transition (62 x 62), from all documents."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _SIZE * _SIZE), np.int64)
        for batch in batches:
            for start, stop in text_slices(batch.column(0)):
                _counted(batch.column(0).slice(start, stop - start).to_pylist(), counts)
        label, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(counts[label, pair])], ["label", "pair", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    sums = texts.mapInArrow(count, "label int, pair int, n bigint").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, _SIZE, _SIZE))
    for label, pair, n in sums.collect():  # 2 x 62 x 62 rows at most
        counts[label].flat[pair] = n
    # where samples are few, a random string is uniform, and an identifier has its letters' shares
    shares = counts[1].sum(axis=0) + 0.5
    prior = np.stack([np.full(_SIZE, 2.0), 5.0 * shares / shares.sum()])[:, None, :]
    chance = (counts + prior) / (counts + prior).sum(axis=2, keepdims=True)
    return np.log(chance[0]) - np.log(chance[1])


def spans_of(text: str, ratio: np.ndarray, threshold: float = THRESHOLD, least: int = 20) -> list[Span]:
    spans, _, runs = base_spans(text)
    base = spans[:]
    flat = ratio.ravel()
    for start, stop in runs:
        if stop - start < least or any(a < stop and start < b for a, _, b in base):
            continue
        run = text[start:stop]
        if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run):
            continue
        pairs = _transitions(run)
        if len(pairs) >= least // 2 and flat[pairs].mean() >= threshold:
            spans.append((start, 3, stop))
    return sorted(spans)


def find_secrets(docs: DataFrame, ratio: np.ndarray | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, spans (array of kind, start, end, by start, then kind)."""
    small_batches(docs.sparkSession)
    ratio = train(docs, text_col) if ratio is None else ratio
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t or "", ratio, threshold)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, span_type)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[Span], mask: str = "[secret]") -> str:
    """The text with each stretch covered by spans replaced by ``mask``."""
    out, at = [], 0
    stop = -1
    for a, _, b in spans:
        if a >= stop:
            if stop >= 0:
                out.append(mask)
            out.append(text[at:a])
        stop = max(stop, b)
        at = stop
    return "".join([*out, mask if stop >= 0 else "", text[at:]])


def mask_secrets(docs: DataFrame, ratio: np.ndarray | None = None, threshold: float = THRESHOLD, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all rows and columns, secrets in the text replaced by ``[secret]``;
    ``length_col``, if given, follows the text where it changed."""
    small_batches(docs.sparkSession)
    ratio = train(docs, text_col) if ratio is None else ratio
    names = docs.columns
    at = names.index(text_col)
    long_at = names.index(length_col) if length_col else -1

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(at)):
                part = batch.slice(start, stop - start)
                columns = part.columns
                texts = columns[at].to_pylist()
                spans = [spans_of(t or "", ratio, threshold) for t in texts]
                new = [masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                columns[at] = pa.array(new, columns[at].type)
                if long_at >= 0:
                    sizes = [len(t) if s else n for t, s, n in zip(new, spans, columns[long_at].to_pylist(), strict=True)]
                    columns[long_at] = pa.array(sizes, columns[long_at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(mask, plain.schema).toDF(*names)


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.sha2(F.expr(_listed("filter(spans, s -> s.kind <> 'markov')")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))
