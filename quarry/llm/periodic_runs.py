"""Runs (maximal repetitions of words) by enumerating maximal pairs.

A maximal pair is two places of a text where the same words follow, whose left words differ
and whose right words differ. Places i < j with ``length`` shared words are such a pair at
distance j - i; if the distance is at most half of the shared length, the words from i to
j + length repeat with the period j - i at least three times, and no neighbour extends them,
because both neighbours differ. So the maximal pairs under that limit are exactly the runs
of three periods or more, and nothing is extended afterwards. A run's multiples of its
period give pairs over the same words; the least period names the run.

Pairs come from the tree of LCP intervals over the suffixes, bottom up: suffixes are ranked
by doubling, neighbours' shared lengths are read from the ranks of each doubling, and
neighbours merge in the order of falling length, the smaller side into the larger. A side
holds its places in order, and the places where the left word changes, so that a place finds
the others within the limit whose left word differs without visiting those that share it.

Only suffixes that can be in a pair enter the tree: a pair shares at least ``depth`` words, so
windows of that many words must repeat in the text, with different left words, and so near
each other as the stretch of repeating windows allows. Repeating windows are found by
64-bit hashes over whole batches; the tree works on the words themselves. A left word that
differs is seen by its hash there, with an error of about one in 2**64.

A word is dropped from the collapsed text if a run holds it after the run's first period.

Defined results: a null, empty or blank text has no words and no runs; its collapsed text
is empty. Rows stand alone: rows that repeat an id, or have none, each give a row. Words are
what stands between ASCII white space, compared as they are. Extra columns are ignored. A
text is one row's work; memory grows with the longest text (some 300 bytes a word of a text
with repeats).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import U64, table, text_slices

LEAST_LENGTH, LEAST_PERIODS = 24, 3


def pair_depth(least_length: int) -> int:
    """Words that every maximal pair of a run shares at least: the larger of twice the period
    and what is left of the least length, for the period where that is least."""
    return min(max(2 * p, least_length - p) for p in range(1, least_length + 1))


def repeating(codes: np.ndarray, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that may hold a run, places that may begin a pair in them), by hashed windows."""
    none = np.zeros(0, np.int64)
    if len(codes) < depth:
        return none, none
    window, width = codes, 1
    while width < depth:  # windows of `width` words; the last step overlaps
        step = min(width, depth - width)
        window = window[: len(window) - step] * U64(0x9FB21C651E98DF25 + 2 * width) + window[step:]
        width += step
    whole = np.flatnonzero(row[: len(window)] == row[depth - 1 :])
    key = window[whole] + row[whole].astype(U64) * U64(0xD6E8FEB86659FD93)
    order = np.lexsort((whole, key)) if len(whole) else none
    key, place = key[order], whole[order]
    same = key[1:] == key[:-1]
    first = np.ones(len(codes), bool)
    first[1:] = row[1:] != row[:-1]
    left = np.where(first, U64(0), np.roll(codes, 1))[place]
    start = first[place]
    group = np.concatenate(([0], np.cumsum(~same))) if len(place) else none
    other = same & ((left[1:] != left[:-1]) | (start[1:] != start[:-1]))
    mixed = np.zeros(group[-1] + 1 if len(group) else 0, bool)
    mixed[group[1:][other]] = True
    if not mixed.any():
        return none, none
    # a pair needs its distance twice over in repeating windows
    ahead = np.zeros(len(codes), np.int64)  # to the next place of the same window
    ahead[place[:-1][same]] = place[1:][same] - place[:-1][same]
    stops = np.flatnonzero(ahead == 0)
    stretch = stops[np.minimum(np.searchsorted(stops, np.arange(len(codes))), len(stops) - 1)] - np.arange(len(codes))
    within = mixed[group]
    begin = place[within]
    able = (ahead[begin] > 0) & (2 * ahead[begin] <= stretch[begin] + depth - 1)
    rows = np.unique(row[begin[able]])
    return rows, np.sort(begin[np.isin(row[begin], rows)])


def suffix_ranks(ids: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their first 1, 2, 4, ... words within the row, until all differ;
    a text's end sorts before any word. Each array has one more, lower rank at its end."""
    _, rank = np.unique(row * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)
    levels, width, n = [np.append(rank, -1)], 1, len(ids)
    while n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(row[width:] == row[: n - width]) if width < n else np.zeros(0, np.int64)
        after[inside] = rank[inside + width] + 1
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        levels.append(np.append(rank, -1))
        width *= 2
    return levels


def shared_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` (different places) share."""
    length, end = np.zeros(len(a), np.int64), len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + length, end)] == levels[k][np.minimum(b + length, end)]
        length += same.astype(np.int64) << k
    return length


def _insert(places: list[int], turns: list[int], place: int, left: dict[int, int]) -> None:
    """Put a place among others in order; ``turns`` are those whose left word isn't that of the place before."""
    at = bisect_left(places, place)
    places.insert(at, place)
    own = left[place]
    if at == 0 or left[places[at - 1]] != own:
        turns.insert(bisect_left(turns, place), place)
    if at + 1 < len(places):
        after = places[at + 1]
        i = bisect_left(turns, after)
        was = i < len(turns) and turns[i] == after
        if was and left[after] == own:
            turns.pop(i)
        elif not was and left[after] != own:
            turns.insert(i, after)


def _partners(places: list[int], turns: list[int], place: int, reach: int, own: int, left: dict[int, int]) -> Iterator[int]:
    """Places at most ``reach`` away whose left word is another than ``own``."""
    at = bisect_left(places, place)
    i = at
    while i < len(places) and places[i] - place <= reach:
        if left[places[i]] != own:
            yield places[i]
            i += 1
        else:
            turn = bisect_right(turns, places[i])
            if turn == len(turns):
                break
            i = bisect_left(places, turns[turn])
    i = at - 1
    while i >= 0 and place - places[i] <= reach:
        if left[places[i]] != own:
            yield places[i]
            i -= 1
        else:
            i = bisect_left(places, turns[bisect_right(turns, places[i]) - 1]) - 1


def near_maximal_pairs(leaves: np.ndarray, shared: np.ndarray, left: dict[int, int], depth: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, words shared) of all maximal pairs, i < j, whose distance is at most half of the
    shared words. ``leaves`` are places in suffix order, ``shared`` the words that neighbours share."""
    held: list[tuple[list[int], list[int]] | None] = [([p], [p]) for p in leaves.tolist()]
    head = list(range(len(held)))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    order = np.argsort(-shared, kind="stable")
    for t, length in zip(order.tolist(), shared[order].tolist(), strict=True):
        if length < depth:
            break
        a, b = find(t), find(t + 1)
        small, large = (a, b) if len(held[a][0]) <= len(held[b][0]) else (b, a)
        places, turns = held[large]
        for p in held[small][0]:
            for q in _partners(places, turns, p, length // 2, left[p], left):
                yield min(p, q), max(p, q), length
        for p in held[small][0]:
            _insert(places, turns, p, left)
        held[small], head[small] = None, large


def runs_of(texts: list[list[bytes]], least_length: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period."""
    depth = pair_depth(least_length)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(w) for w in texts], np.int64)
    codes = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(sizes.sum())).view(U64)
    row = np.repeat(np.arange(len(texts)), sizes)
    some, begin = repeating(codes, row, depth)
    if not len(some):
        return found
    first = np.cumsum(sizes) - sizes
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for r in some.tolist() for w in texts[r]), np.int64)
    inner = np.repeat(np.arange(len(some)), sizes[some])
    shift = np.cumsum(sizes[some]) - sizes[some]  # where a row begins among the rows at hand
    at = np.searchsorted(some, row[begin])
    begin = begin - first[some[at]] + shift[at]
    levels = suffix_ranks(ids, inner)
    leaves = begin[np.argsort(levels[-1][begin])]
    shared = shared_words(levels, leaves[:-1], leaves[1:])
    before = np.where(np.isin(leaves, shift), -1, ids[leaves - 1])
    left = dict(zip(leaves.tolist(), before.tolist(), strict=True))
    least: dict[tuple[int, int], int] = {}
    for i, j, length in near_maximal_pairs(leaves, shared, left, depth):
        period = j - i
        if length + period >= least_length:
            span = (i, length + period)
            least[span] = min(period, least.get(span, period))
    for (i, length), period in least.items():
        r = int(inner[i])
        found[int(some[r])].append((int(i - shift[r]), length, period))
    return [sorted(f, key=lambda x: (x[0], x[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per row: doc_id, n_words, runs (by start, then period), collapsed (the text
    without what runs repeat)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in part.column(1).cast(pa.large_binary())]
                runs = runs_of(texts, least_length)
                flat = [r for each in runs for r in each]
                ends = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
                fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                left = pa.array([collapsed(w, r) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in texts], pa.int64()), spans, left], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; in documents whose crc32 ends in 0, the words from one on repeat."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = rows.withColumn("h", F.expr("crc32(encode(cast(doc_id as string), 'UTF-8'))")).withColumn("g", F.expr("h div 10"))
    words = chosen.withColumn("words", F.expr(r"if(h % 10 = 0, filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), null)"))
    places = words.withColumn("a", F.expr("if(size(words) > 0, g % size(words), null)"))
    periods = places.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    word = "transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)]))"
    return periods.select("doc_id", F.expr(f"if(a is null, text, array_join({word}, ' '))").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # of equal quotients the earlier in order stays: the smaller start, then period
    best = found.withColumn("best", F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"))
    lines = "transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"
    return best.select(
        "doc_id",
        F.expr("cast(size(runs) as bigint)").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.expr(f"sha2(array_join({lines}, ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
