"""Near-duplicate classes by DartMinHash signatures and a banded join.

A text is a weighted set of shingles (runs of five lower-cased words; a shorter text is one
shingle of its own). Darts are thrown at the plane of weight and rank: a Poisson process of
one dart per unit cell, seeded by the shingle's hash and the cell, so equal shingles get
equal darts in every text. A text keeps the darts inside its shingles' weights whose rank is
below ``t / total weight``; each dart belongs to one of K coordinates, and a coordinate's
signature is its dart of least rank. Two texts agree in a coordinate with the probability of
their weighted Jaccard similarity. Texts with an empty coordinate throw again, twice as far.

Bands of R coordinates are join keys. Texts with the same shingle set are one node. In each
bucket every node is paired with the bucket's least node; pairs whose signatures agree too
little to reach the threshold are left out, the rest are checked exactly on their shingle
sets. That joins most copies. Where a bucket's nodes are then still in different classes, all
its pairs are tried inside tasks, which get every node once with its signature and set, skip
pairs that are in one class already, and give links only. So no pair of a bucket goes untried,
and no more rows are made than a bucket has nodes, but for buckets beyond a task's size, whose
blocks meet two by two. Classes are the connected components of the links.

Defined results: a text without words (null, empty, blank) is a class of its own. A row
with a null id has a null class and is kept. Rows that repeat an id are one document. An
empty table gives an empty result. Extra columns are ignored by ``near_classes`` and kept
by ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import U64, drop_stored, mix, small_batches, stored, table, text_slices, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, R = 20, 5
K = BANDS * R
#: nodes and bytes of shingle sets of a block; larger buckets are compared two blocks a task
GROUP, GROUP_BYTES = 1024, 16 << 20
#: a pair is checked if its K coordinates agree in this share (4.5 standard errors below THRESHOLD)
ESTIMATE = 0.62
#: unit cells thrown at together; a text takes about K * (log(K) + 5), however short it is
CELLS = 1 << 17
#: bits of the filter that spares documents outside all pairs a shuffle
BITS = 1 << 25
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])


def shingle_sets(texts: pa.Array, weights: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the distinct shingles of each text, sorted by row and hash.
    Weights are 1 (``set``) or the times a shingle occurs (``count``)."""
    row, word = words_of(texts)
    n = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n) - n
    rows, codes = [], []
    for size in range(1, SHINGLE + 1):
        if size < SHINGLE:
            begin = first[n == size]
        else:
            begin = np.flatnonzero(row[SHINGLE - 1 :] == row[: len(row) - SHINGLE + 1]) if len(row) >= SHINGLE else np.zeros(0, np.int64)
        code = np.full(len(begin), size, U64)
        for i in range(size):
            code = mix(code * U64(0x9FB21C651E98DF25) + word[begin + i])
        rows.append(row[begin])
        codes.append(code)
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(row))) if weights == "count" else np.ones(len(at), np.int64)
    return row[at], code[at], times


def _cells(row, code, weight, reach):
    """Unit cells (row, shingle, weight slab, rank slab) below each shingle's weight and each row's reach."""
    high = np.ceil(reach).astype(np.int64)[row]
    many = weight * high
    which = np.repeat(np.arange(len(row)), many)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    return which, inner // high[which], inner % high[which]


def _throw(row, code, weight, reach, n_rows, k):
    """Least-rank dart per (row, coordinate): ids, and which coordinates have one."""
    which, slab, level = _cells(row, code, weight, reach)
    seed = mix(code[which] ^ mix(slab.astype(U64) * U64(0xA24BAED4963EE407) + level.astype(U64) * U64(0x9FB21C651E98DF25) + U64(1)))
    darts = np.searchsorted(_POISSON, (seed >> U64(11)).astype(np.float64) / 2.0**53)
    cell = np.repeat(np.arange(len(which)), darts)
    number = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
    spot = mix(seed[cell] + (number.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F))
    rank = level[cell] + (spot >> U64(32)).astype(np.float64) / 2.0**32
    own = row[which[cell]]
    # a whole weight fills its slabs, so only the rank can put a dart outside
    inside = rank < reach[own]
    own, rank, spot = own[inside], rank[inside], mix(spot[inside] ^ U64(0x165667B19E3779F9))
    place = own * k + (spot % U64(k)).astype(np.int64)
    order = np.lexsort((spot, rank, place))
    place, spot = place[order], spot[order]
    least = np.ones(len(place), bool)
    least[1:] = place[1:] != place[:-1]
    ids, found = np.zeros(n_rows * k, U64), np.zeros(n_rows * k, bool)
    ids[place[least]], found[place[least]] = spot[least], True
    return ids.reshape(n_rows, k), found.reshape(n_rows, k)


def signatures(row: np.ndarray, code: np.ndarray, weight: np.ndarray, n_rows: int, k: int = K) -> np.ndarray:
    """(rows, k) dart ids; rows without shingles are zeros. ``row`` ascends. Rows are thrown for
    in blocks of about CELLS unit cells, so memory doesn't grow with the number of short texts."""
    total = np.bincount(row, weight, minlength=n_rows)
    reach = k * (math.log(k) + 5) / np.maximum(total, 1)
    ids = np.zeros((n_rows, k), U64)
    block = np.cumsum(total * np.ceil(reach)) // CELLS
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), n_rows]
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        own = slice(*np.searchsorted(row, (start, stop)))
        ids[start:stop] = _thrown(row[own] - start, code[own], weight[own], reach[start:stop], total[start:stop] > 0, k)
    return ids


def _thrown(row: np.ndarray, code: np.ndarray, weight: np.ndarray, reach: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Dart ids of the ``missing`` rows; those with an empty coordinate throw again, twice as far."""
    ids = np.zeros((len(reach), k), U64)
    while missing.any():
        some = missing[row]
        small = np.cumsum(missing) - 1
        got, found = _throw(small[row[some]], code[some], weight[some], reach[missing], int(missing.sum()), k)
        whole = found.all(axis=1)
        rows = np.flatnonzero(missing)
        ids[rows[whole]] = got[whole]
        reach[rows] *= 2
        missing[rows[whole]] = False
    return ids


def _band_keys(ids: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=U64), (len(ids), 1))
    for i in range(R):
        keys = mix(keys * U64(0x9FB21C651E98DF25) + ids[:, i::R][:, :BANDS])
    return keys


def sketches(docs: DataFrame, weights: str = "set") -> DataFrame:
    """doc_id, print_a, print_b (128 bits that name the shingle set, null without words),
    bands (array), signature (K 16-bit numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(1), 1 << 19):
                part = batch.slice(start, stop - start)
                row, code, weight = shingle_sets(part.column(1), weights)
                ids = signatures(row, code, weight, len(part))
                has = np.bincount(row, minlength=len(part)) > 0
                prints = []
                for salt in (0x51ED270B, 0x2F0B4C47):
                    sums = np.zeros(len(part), U64)
                    np.add.at(sums, row, mix(code * U64(2 * salt + 1) + weight.astype(U64)))
                    prints.append(pa.array(mix(sums).view(np.int64), mask=~has))
                keys = _band_keys(ids).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                short = (ids >> U64(48)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *prints, bands, pa.array([s.tobytes() for s in short], pa.binary())],
                    ["doc_id", "print_a", "print_b", "bands", "signature"],
                )

    return docs.mapInArrow(run, "doc_id bigint, print_a bigint, print_b bigint, bands array<bigint>, signature binary")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough."""
    left = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    right = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "sa", "sb")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, K) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= ESTIMATE))

    return both.mapInArrow(near, "a bigint, b bigint")


def _places(ids: np.ndarray) -> np.ndarray:
    """Two places of each id in a bit table of BITS bits."""
    codes = ids.astype(np.int64).view(U64)
    return np.stack([mix(codes + U64(salt)) % U64(BITS) for salt in (1, 2)], axis=1).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``doc_id``: BITS bits, however many ids there are. It
    lets through all ids and some others; joins decide."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_places(batch.column(0).to_numpy()))
            bit = np.left_shift(U64(1), (place & 63).astype(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(bit)], ["word", "bits"])

    merged = ids.select("doc_id").mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[merged.column(0).to_numpy()] = merged.column(1).to_numpy()
    return table


def _items(need: DataFrame, docs: DataFrame, weights: str) -> DataFrame:
    """(node, items) of the documents in the column ``doc_id`` of ``need``, and of some others."""
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(need))  # BITS / 8 bytes

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingle sets as sorted 32-bit hashes; a weight of n is n hashes."""
        held = wanted.value
        for batch in batches:
            place = _places(batch.column(0).to_numpy())
            maybe = ((held[place >> 6].view(U64) >> (place & 63).astype(U64)) & U64(1)).all(axis=1)
            batch = batch.filter(pa.array(maybe))
            for start, stop in text_slices(batch.column(1), 1 << 19):
                part = batch.slice(start, stop - start)
                row, code, weight = shingle_sets(part.column(1), weights)
                again = np.repeat(np.arange(len(row)), weight)
                nth = np.arange(len(again)) - np.repeat(np.cumsum(weight) - weight, weight)
                short = (mix(code[again] + nth.astype(U64)) >> U64(32)).astype("<u4")
                cut = np.searchsorted(row[again], np.arange(1, len(part)))
                lists = [np.unique(s).tobytes() for s in np.split(short, cut)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.binary())], ["node", "items"])

    return stored(docs.mapInArrow(sets, "node bigint, items binary"), "shingles")


def exact_links(pairs: DataFrame, docs: DataFrame, threshold: float, weights: str) -> DataFrame:
    """Pairs whose weighted Jaccard similarity reaches the threshold, from the texts."""
    items = _items(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), docs, weights)
    left = items.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    right = items.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "ia", "ib")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                shared = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(shared >= threshold * (len(u) + len(v) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(similar, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; the label is the least node of its component.

    Each round takes the least label among neighbours, then the label's own label; every
    round's table is written to the shared folder."""
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")), "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("heard"))
        lower = stored(labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was")), "labels")
        heads = lower.select(F.col("node").alias("label"), F.col("label").alias("head"))
        new = stored(lower.join(heads, "label").select("node", F.col("head").alias("label"), (F.col("head") != F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.where("moved").limit(1).count() == 0:
            return labels


class Group:
    """Nodes of one bucket (or of two of its blocks), compared here: links come out, not pairs."""

    def __init__(self, band: int, node: np.ndarray, cls: np.ndarray, side: np.ndarray, signature: np.ndarray, items: list[np.ndarray], threshold: float):
        self.band, self.node, self.cls, self.side, self.threshold = band, node, cls.copy(), side, threshold
        self.signature, self.items = signature, items
        self.size = np.array([len(i) for i in items])

    def _similar(self, x: int, y: int) -> bool:
        u, v = self.items[x], self.items[y]
        shared = len(np.intersect1d(u, v, assume_unique=True))
        return shared >= self.threshold * (len(u) + len(v) - shared)

    def links(self) -> list[tuple[int, int]]:
        """Links (a, b) that join all classes which the exact check joins; a pair already in one
        class isn't tried, nor one whose first common bucket is another."""
        found = []
        for x in range(len(self.node) - 1):
            rest = np.arange(x + 1, len(self.node))
            rest = rest[self.cls[rest] != self.cls[x]]
            if (self.side != self.side[0]).any():
                rest = rest[self.side[rest] != self.side[x]]
            rest = rest[np.minimum(self.size[rest], self.size[x]) >= self.threshold * np.maximum(self.size[rest], self.size[x])]
            if not len(rest):
                continue
            same = self.signature[rest] == self.signature[x]
            close = same.mean(axis=1)
            ours = same.reshape(-1, BANDS, R).all(axis=2).argmax(axis=1) == self.band
            order = np.flatnonzero((close >= ESTIMATE) & ours)
            for y in rest[order[np.argsort(-close[order], kind="stable")]].tolist():
                if self.cls[y] != self.cls[x] and self._similar(x, y):
                    found.append((int(self.node[x]), int(self.node[y])))
                    self.cls[self.cls == self.cls[y]] = self.cls[x]
        return found


def _bucket_links(shared: DataFrame, nodes: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, weights: str, held: list[DataFrame]) -> DataFrame:
    """Links between nodes of different classes that share a bucket, all its pairs tried.

    A bucket whose nodes are still in several classes goes to a task with each node's signature
    and shingle set. A bucket of more than GROUP nodes, or GROUP_BYTES of sets, is dealt into
    blocks by a hash, and every two blocks meet in a task of their own: no task holds more than
    two blocks, and no row is made per pair. (In a bucket of two, the first round has tried
    the only pair.)"""
    classed = shared.select("key", "band", "node").join(classes, "node")
    mixed = classed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2").select("key")
    crowd = stored(classed.join(mixed, "key"), "crowd")
    items = _items(crowd.select(F.col("node").alias("doc_id")).distinct(), docs, weights)
    held += [crowd, items]
    size = items.groupBy("node").agg(F.sum(F.octet_length("items")).alias("bytes"))
    blocks = crowd.join(size, "node").groupBy("key").agg(F.expr(f"greatest(ceil(count(1) / {GROUP}), ceil(sum(bytes) / {GROUP_BYTES}))").alias("m"))
    dealt = crowd.join(blocks, "key").withColumn("own", F.expr("pmod(xxhash64(node, key), m)"))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0L, m - 1)"))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "node", "class", (F.col("own") > F.col("other")).alias("side"))
    rows = met.join(nodes.select("node", "signature"), "node").join(items, "node")
    grouped = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        last: tuple | None = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            column = {n: t.column(n).combine_chunks() for n in ("band", "node", "class", "side", "signature")}
            signature = np.frombuffer(b"".join(column["signature"].to_pylist()), "<u2").reshape(-1, K)
            sets = [np.frombuffer(x.as_buffer(), "<u4") for x in t.column("items")]  # no copies
            group = Group(column["band"][0].as_py(), column["node"].to_numpy(), column["class"].to_numpy(), column["side"].to_numpy(zero_copy_only=False), signature, sets, threshold)
            links = group.links()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in ("key", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                own = tuple(keys[start].tolist())
                if last is not None and own != last:
                    yield done()
                    parts.clear()
                last = own
                parts.append(batch.slice(start, stop - start))
        if parts:
            yield done()

    return grouped.mapInArrow(run, "a bigint, b bigint")


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) after links join classes; a class is named by its least node."""
    of_a = classes.select(F.col("node").alias("a"), F.col("class").alias("ca"))
    of_b = classes.select(F.col("node").alias("b"), F.col("class").alias("cb"))
    between = links.join(of_a, "a").join(of_b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    joined = components(between).select(F.col("node").alias("class"), F.col("label").alias("final"))
    return stored(classes.join(joined, "class", "left").select("node", F.coalesce("final", "class").alias("class")), "classes")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "set", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the class's least id), kept (whether
    this is the class's document)."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = plain.where("doc_id is not null")
    sketched = stored(sketches(named, weights), "sketches")
    worded = sketched.where("print_a is not null")
    same_set = ["print_a", "print_b"]
    heads = stored(worded.groupBy(*same_set).agg(F.min("doc_id").alias("node")), "heads")
    members = stored(worded.select("doc_id", *same_set).join(heads, same_set).select("doc_id", "node").distinct(), "members")
    # one row per set; its bands and signature come from the row of its least id
    nodes = stored(
        worded.join(heads.withColumnsRenamed({"print_a": "pa", "print_b": "pb"}), (F.col("doc_id") == F.col("node")) & (F.col("print_a") == F.col("pa")) & (F.col("print_b") == F.col("pb")))
        .groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature")),
        "nodes",
    )
    rows = stored(nodes.select("node", F.posexplode("bands").alias("band", "key")), "bands")
    buckets = stored(rows.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = stored(rows.join(buckets, "key").select("key", "band", "least", "node"), "shared-bands")
    held = [sketched, heads, members, nodes, rows, buckets, shared]

    first = shared.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    agreeing = stored(_agreeing(first, nodes), "pairs")
    links = stored(exact_links(agreeing, named, threshold, weights), "links")
    classes = _merged(nodes.select("node", F.col("node").alias("class")), links)
    more = stored(_bucket_links(shared, nodes, classes, named, threshold, weights, held), "links")
    held += [agreeing, links, classes, more]
    classes = _merged(classes, more)
    held.append(classes)

    of_doc = stored(members.join(classes, "node").groupBy("doc_id").agg(F.min("class").alias("class_id")), "classes")
    for frame in held:  # the result needs none of them
        drop_stored(frame)
    ids = plain.select("doc_id").join(of_doc, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return ids.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "set", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns: one document of each class."""
    names = docs.columns
    whole = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(id_col)}"
    gone = near_classes(docs, threshold, weights, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return whole.join(stored(gone, "near-copies"), whole[own].cast("bigint") == F.col("gone"), "left_anti").toDF(*names)


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
