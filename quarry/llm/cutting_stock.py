"""Packing token sequences as a cutting-stock problem, solved by column generation.

Every document is cut at multiples of the sequence length; what is left is one piece per
document. The pieces' lengths, rounded up to whole units, make a histogram of at most
``seq_len / unit`` widths. A pattern says how many pieces of each width share a sequence. A
linear program finds how often to use each pattern; its columns are priced by a knapsack
dynamic program, until Farley's bound shows that little can be gained. Pattern counts are
rounded down, and the few pieces left (no more than the patterns hold) are fitted by
best-fit decreasing, still as patterns. Only the histogram and the patterns are on the driver.

The pieces of each width are then ranked, and ranks say which pattern, sequence and slot a
piece gets. Ranking splits a width into about sqrt(n) groups by a hash of the piece, so a
width that a third of all documents share is never one group.

Defined results: a null or empty text is the end token alone. Repeated rows are packed like
any others, each once; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.bpe import WORDS_KEPT, Cutter, byte_letters, tokenizer_path
from quarry.llm.common import small_batches, stored, table, text_slices

END_ID = 1
#: the linear program ends when it is this close to its bound, or after so many columns;
#: lengths are rounded up until there are so many widths
GAP, COLUMNS, MOST_WIDTHS = 2e-4, 300, 512
#: words kept per worker while packing
PACKING_WORDS = 250_000

Pattern = tuple[int, dict[int, int]]  # times used, pieces of each width


class LibraryWords(dict[str, bytes]):
    """Little-endian ids of words by the tokenizers library's own model. A word is encoded when
    it is first asked for."""

    def __init__(self, spec: str):
        super().__init__()
        self.cutter = Cutter(spec)
        tokenizer = Tokenizer.from_str(spec)
        self._tokens = tokenizer.model.tokenize
        self._packed = {i: i.to_bytes(4, "little") for i in tokenizer.get_vocab().values()}
        self._letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        special = self.cutter.specials.get(word)
        if special is not None:
            found = self._packed[special]
        else:
            # printable ASCII is its own byte letter
            shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._letters)
            packed = self._packed
            found = b"".join([packed[t.id] for t in self._tokens(shown)])
        self[word] = found
        return found


class LibraryTable:
    """Ids of texts, by a table of the words met so far that is emptied when full."""

    def __init__(self, spec: str, kept: int = WORDS_KEPT):
        self.words, self.kept = LibraryWords(spec), kept

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        out, get, cut = [], self.words.__getitem__, self.words.cutter.words
        for text in texts:
            if len(self.words) > self.kept:
                self.words.clear()
            out.append(b"".join(map(get, cut(text))))
        return out


_TABLES: dict[int, LibraryTable] = {}


def token_table(spec: str, kept: int = WORDS_KEPT) -> LibraryTable:
    """One table per worker process, vocabulary and size."""
    key = hash((spec, kept))
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = LibraryTable(spec, kept)
    return _TABLES[key]


def cut_documents(docs: DataFrame, tokenizer: str, seq_len: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and ids (binary)
    if asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = token_table(spec.value, PACKING_WORDS)
        for batch in batches:
            for first, stop in text_slices(batch.column(1)):
                part = batch.slice(first, stop - first)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, data in enumerate(words.encode([t or "" for t in part.column(1).to_pylist()])):
                    data += end
                    n = len(data) // 4
                    for at in range(0, n, seq_len):
                        piece = data[at * 4 : (at + seq_len) * 4]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        ids.append(piece if with_ids else None)
                columns = [part.column(0).take(pa.array(row, pa.int64()))] + [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary")
    return pieces if with_ids else pieces.drop("ids")


def best_knapsack(widths: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of widths (ascending) that fits the room."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(widths, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        k = fitting[c]
        value[c] = value[c - 1]
        if k:
            offers = value[c - widths[:k]] + worth[:k]
            j = int(offers.argmax())
            if offers[j] > value[c]:
                value[c], choice[c] = offers[j], j
    picked, c = np.zeros(len(widths)), room
    while c > 0:
        j = choice[c]
        if j < 0:
            c -= 1
        else:
            picked[j] += 1
            c -= widths[j]
    return float(value[room]), picked


def first_basis(widths: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns to start from, as columns. Each takes the widest pieces left and the fullest
    filling for the rest, as often as pieces last; so each is the last to use some width:
    with rows in the order in which widths end, the matrix is triangular. Returns its inverse too."""
    left, basis = demand.astype(float).copy(), np.zeros((len(widths), len(widths)))
    open_widths, ended = np.arange(len(widths)), []
    for column in range(len(widths)):
        widest = open_widths[-1]
        _, filling = best_knapsack(widths[open_widths], widths[open_widths] * (1 + 1e-6 * widths[open_widths]), room - widths[widest])
        pattern = np.zeros(len(widths))
        pattern[open_widths] = filling
        pattern[widest] += 1
        lasts = np.where(pattern[open_widths] > 0, left[open_widths] / np.maximum(pattern[open_widths], 1), np.inf)
        ends = open_widths[int(lasts.argmin())]
        left = np.maximum(left - pattern * lasts.min(), 0)
        basis[:, column] = pattern
        open_widths = open_widths[open_widths != ends]
        ended.append(ends)
    lower, inverse = basis[ended], np.eye(len(widths))
    for k in range(len(widths)):
        inverse[k] /= lower[k, k]
        below = k + 1 + np.flatnonzero(lower[k + 1 :, k])
        inverse[below] -= lower[below, k][:, None] * inverse[k]
    inverse[:, ended] = inverse.copy()
    return basis, inverse


def column_generation(widths: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, times each) that cover the demand exactly with few sequences;
    the times are fractions. Revised simplex from :func:`first_basis`."""
    basis, inverse = first_basis(widths, demand, room)
    times = np.maximum((inverse * demand).sum(axis=1), 0)
    least = float((widths * demand).sum()) / room
    for _ in range(COLUMNS):
        worth = inverse.sum(axis=0)
        value, pattern = best_knapsack(widths, worth, room)
        if value <= 1 + 1e-9 or times.sum() - max(times.sum() / value, least) <= GAP * times.sum():
            break
        used = np.flatnonzero(pattern)
        step = (inverse[:, used] * pattern[used]).sum(axis=1)
        limit = np.where(step > 1e-11, times / np.where(step > 1e-11, step, 1), np.inf)
        out = int(limit.argmin())
        times = np.maximum(times - limit[out] * step, 0)
        times[out] = limit[out]
        basis[:, out] = pattern
        pivot = inverse[out] / step[out]
        inverse -= step[:, None] * pivot
        inverse[out] = pivot
    return basis, times


def best_fit(left: dict[int, int], room: int) -> list[Pattern]:
    """Best-fit decreasing of single pieces, equal sequences counted together."""
    bins, free = [], np.zeros(0, np.int64)
    for width in sorted(left, reverse=True):
        for _ in range(left[width]):
            fits = np.where(free >= width, free, room + 1)
            at = int(fits.argmin()) if len(fits) else 0
            if not len(fits) or fits[at] > room:
                bins.append(Counter())
                free = np.append(free, room)
                at = len(bins) - 1
            bins[at][width] += 1
            free[at] -= width
    return [(n, dict(b)) for b, n in Counter(tuple(sorted(b.items())) for b in bins).items()]


def plan_patterns(histogram: dict[int, int], room: int) -> list[Pattern]:
    """Patterns that use up the histogram (pieces of each width, in units)."""
    if not histogram:
        return []
    widths = np.array(sorted(histogram))
    demand = np.array([histogram[w] for w in widths], float)
    basis, times = column_generation(widths, demand, room)
    whole = np.floor(times * (1 - 1e-12) + 1e-9)
    left = np.rint(demand - (basis * whole).sum(axis=1)).astype(np.int64)
    for j in np.argsort(-whole):  # rounding of very large counts must not use a piece twice
        while (left < 0).any() and whole[j] > 0 and (basis[:, j] * (left < 0)).any():
            whole[j] -= 1
            left += np.rint(basis[:, j]).astype(np.int64)
    plan: list[Pattern] = []
    for j in np.flatnonzero(whole):
        plan.append((int(whole[j]), {int(widths[i]): int(basis[i, j]) for i in np.flatnonzero(basis[:, j])}))
    return plan + best_fit({int(w): int(n) for w, n in zip(widths, left, strict=True) if n}, room)


def unit_for(lengths: dict[int, int], seq_len: int) -> int:
    """Tokens per unit of width: the smallest power of two that leaves at most MOST_WIDTHS
    widths. Rounding up costs a piece half a unit on average."""
    unit = 1
    while len({-(-n // unit) for n in lengths}) > MOST_WIDTHS and unit * 2 <= seq_len:
        unit *= 2
    return unit


def pack(pieces: DataFrame, seq_len: int = 2048) -> DataFrame:
    """``pieces`` from :func:`cut_documents` with sequence_id and offset. Reads its input
    several times, so it should be a stored frame."""
    lengths = {n: times for n, times in pieces.groupBy("length").count().collect()}  # seq_len rows at most
    unit = unit_for(lengths, seq_len)
    room = seq_len // unit
    wide = pieces.withColumn("__width", F.expr(f"cast(ceil(length / {unit}) as int)"))
    histogram: Counter[int] = Counter()
    for n, times in lengths.items():
        histogram[-(-n // unit)] += times
    plan = plan_patterns(histogram, room)

    # ranges of ranks per width: first rank, first sequence, pieces per sequence
    used: Counter[int] = Counter()
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    first_sequence = 0
    for times, pattern in plan:
        for width, each in pattern.items():
            ranges.setdefault(width, []).append((used[width], first_sequence, each))
            used[width] += times * each
        first_sequence += times

    groups = pieces.sparkSession.createDataFrame([(w, int(n**0.5) + 1) for w, n in histogram.items()] or [(0, 1)], "__width int, __groups int")
    salted = wide.join(F.broadcast(groups), "__width").withColumn("__salt", F.expr("pmod(xxhash64(doc_id, start), __groups)"))
    counts = salted.groupBy("__width", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__width").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("__width", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__width", "__salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("__rank", F.row_number().over(inside)).join(firsts, ["__width", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__rank") - 1).drop("__first", "__salt", "__groups")

    tables = {w: tuple(np.array(c) for c in zip(*r, strict=True)) for w, r in ranges.items()}
    at = ranked.columns.index("__width"), ranked.columns.index("__rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            sequence = np.zeros(len(batch), np.int64)
            for w in np.unique(width):
                own = width == w
                begin, first, each = tables[int(w)]
                k = np.searchsorted(begin, rank[own], side="right") - 1
                sequence[own] = first[k] + (rank[own] - begin[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], [*batch.schema.names, "sequence_id"])

    fields = ", ".join(f"`{n}` {t}" for n, t in [*ranked.dtypes, ("sequence_id", "bigint")])
    placed = ranked.mapInArrow(place, fields)
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("__width"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset")
    return placed.select(*pieces.columns, "sequence_id", offset)


def pack_documents(docs: DataFrame, tokenizer: str, seq_len: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids, if asked for)."""
    pieces = stored(cut_documents(docs, tokenizer, seq_len, id_col, text_col, with_ids), "pieces")
    return pack(pieces, seq_len)


def padding(packed: DataFrame, seq_len: int = 2048) -> float:
    """Padded share: every sequence is filled up to ``seq_len`` unless its length is a power of two."""
    totals = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    full = F.when(F.expr("bit_count(n) = 1"), F.col("n")).otherwise(seq_len)
    kept, used = totals.agg(F.sum("n"), F.sum(full)).first()
    return 1 - kept / used if used else 0.0


def op6_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
