"""Approximate nearest neighbours by an adaptive dimension scan.

Largest inner product becomes least distance by one more dimension (what a vector lacks in
length to the longest one), and a random rotation spreads every distance evenly over the
dimensions. Lists come from k-means on a bounded sample; all vectors are indexed. Within a
probed list, candidates stand in blocks of columns: after each block a hypothesis test
compares the partial distance with the query's 20th best so far, and candidates that would
be near only by an unlikely chance (EPSILON) are abandoned. What stays is scored exactly, in
double precision, on the original vectors.

Queries are dealt into parts of about QUERIES by their own list, candidates into STRIPES by
their list; a list with a third of all rows is spread over the stripes by a hash. A part
reads each stripe as a sorted stream, keeps its k best so far, and returns k rows per query
and stripe, so the result grows with the queries only and memory holds one part and one
batch. ``share`` is the share of the lists that a query probes: vectors without clusters need a
large one for a recall of 0.9 (README).

Defined results: vectors that are null, zero, hold a null or non-finite component, or are
not of the most frequent length (ties: the longest) take no part, neither as query nor as
candidate, nor do rows with a null id. A candidate with the query's id is the query itself;
rows that repeat an id are ranked by their best score, once, and hold one of the k places
that set the limit for abandoning. Ties go to the smaller id. A
query gets all candidates if they are fewer than ``k``. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

NEIGHBOURS = 20
SAMPLE_ROWS, ROUNDS = 20_000, 8
ROWS_PER_LIST, MOST_LISTS = 48, 4096
SHARE = 0.75
LEAST_PROBED = 1000
STRIPES, QUERIES, STREAM, SPREAD = 8, 512, 1024, 512
HELD = 100_000
COLUMNS, EPSILON = 16, 2.1


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


class Space:
    """Extends, rotates and assigns vectors."""

    def __init__(self, dim: int, longest: float, seed: int = 11):
        self.dim, self.longest = dim, longest
        turn, signs = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim + 1, dim + 1)))
        self.turn = turn * np.sign(np.diag(signs))
        self.centres = np.zeros((1, dim + 1))

    def rows(self, x: np.ndarray) -> np.ndarray:
        lack = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.column_stack([x, lack]) @ self.turn

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.zeros(len(x))]) @ self.turn

    def near(self, rotated: np.ndarray) -> np.ndarray:
        """Squared distances to the centres, but for each row's own constant."""
        return (self.centres**2).sum(axis=1) - 2 * rotated @ self.centres.T

    def fit(self, sample: np.ndarray, lists: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.centres = sample[rng.permutation(len(sample))[:lists]]
        for _ in range(ROUNDS):
            own = self.near(sample).argmin(axis=1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, sample)
            n = np.bincount(own, minlength=len(self.centres))
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sample[rng.integers(0, len(sample), len(n))])


def parts_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each list's queries: short lists share a part, a
    long one has several."""
    first, many = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    part, held = 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > QUERIES:
            part, held = part + 1, 0
        first[i] = part
        if n > QUERIES:
            many[i] = -(-n // QUERIES)
            part, held = part + int(many[i]), 0
        else:
            held += n
    return first, many


class Part:
    """A part's queries and their k best candidates so far."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, rotated: np.ndarray, probed: list[np.ndarray], k: int):
        self.ids, self.v, self.rotated, self.k = ids, v, rotated, k
        asked, names = np.repeat(np.arange(len(ids)), [len(p) for p in probed]), np.concatenate(probed)
        order = np.argsort(names, kind="stable")
        self.asked, self.names = asked[order], names[order]  # queries that probe each list
        self.near = np.full((len(ids), k), np.inf)  # least distances of k different ids, none the query's own
        self.owner = np.zeros((len(ids), k), np.int64)  # the ids; of no meaning where the distance is infinite
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, candidate id, score
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.size = rotated**2

    def scan(self, name: int, ids: np.ndarray, v: np.ndarray, rows: np.ndarray) -> None:
        """Candidates of one list: column block after column block, then exact scores."""
        lo, hi = np.searchsorted(self.names, (name, name + 1))
        who = self.asked[lo:hi]
        if not len(who):
            return
        dim, row_size = rows.shape[1], rows**2
        limit = self.near[who, -1]
        partial = np.zeros((len(who), len(rows)))
        alive = np.ones(partial.shape, bool)
        live = np.arange(len(rows))
        for c in range(0, dim, COLUMNS):
            d = min(c + COLUMNS, dim)
            step = self.size[who, c:d].sum(axis=1)[:, None] + row_size[live, c:d].sum(axis=1) - 2 * self.rotated[who, c:d] @ rows[live, c:d].T
            partial[:, live] += step
            # a partial distance above this is unlikely if the whole one is within the limit
            bound = limit * (d / dim) * ((1 + EPSILON / d**0.5) ** 2 if d < dim else 1 + 1e-6) + 1e-6
            alive &= partial <= bound[:, None]
            live = np.flatnonzero(alive.any(axis=0))
            if not len(live):
                return
        alive &= ids[None, :] != self.ids[who][:, None]
        some = alive.any(axis=1)
        self._closest(who[some], ids, np.where(alive[some], partial[some], np.inf))
        alive &= partial <= self.near[who, -1][:, None] * (1 + 1e-6) + 1e-6
        q, c = np.nonzero(alive)
        q = who[q]
        score = np.zeros(len(q))
        for j in range(v.shape[1]):  # one order of summation for every pair, so equal vectors tie
            score += v[c, j] * self.v[q, j]
        self.waiting.append((q, ids[c], score))
        self.held += len(q)
        if self.held > HELD:
            self._keep()

    def _closest(self, who: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        """Least distance of each id, then the k least."""
        near = np.concatenate([self.near[who], distance], axis=1)
        owner = np.concatenate([self.owner[who], np.broadcast_to(ids, distance.shape)], axis=1)
        q, c = np.nonzero(np.isfinite(near))
        value, name = near[q, c], owner[q, c]
        order = np.lexsort((value, name, q))
        q, name, value = q[order], name[order], value[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (name[1:] != name[:-1])
        q, name, value = q[once], name[once], value[once]
        order = np.lexsort((value, q))
        q, name, value = q[order], name[order], value[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        top = at < self.k
        q, at = q[top], at[top]
        least, names = np.full((len(who), self.k), np.inf), np.zeros((len(who), self.k), np.int64)
        least[q, at], names[q, at] = value[top], name[top]
        self.near[who], self.owner[who] = least, names

    def _keep(self) -> None:
        q, ids, score = (np.concatenate(x) for x in zip(self.found, *self.waiting, strict=True))
        self.waiting, self.held = [], 0
        order = np.lexsort((-score, ids, q))
        q, ids, score = q[order], ids[order], score[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, score = q[once], ids[once], score[once]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.found = q[top], ids[top], score[top]

    def result(self) -> pa.RecordBatch:
        self._keep()
        q, ids, score = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product."""
    ids = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    good = ids.where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = good.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("long"))
    common = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim, total = common["dim"], common["n"]
    good = good.where(F.size("v") == dim)

    space = Space(dim, common["long"])
    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow()  # bounded
    lists = int(min(max(total // ROWS_PER_LIST, 1), MOST_LISTS, len(sample)))
    space.fit(space.rows(_matrix(sample.column(0), dim)), lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                x = _matrix(batch.column(1), dim)
                rotated = space.rows(x)
                own = space.near(rotated).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2), pa.array(own, pa.int64()),
                     pa.array([r.tobytes() for r in rotated.astype(np.float32)], pa.binary())],
                    ["id", "v", "asks", "list", "rotated"],
                )

    good = good.groupBy("id", "v").agg(F.bool_or("asks").alias("asks"))
    index = stored(good.mapInArrow(assign, "id bigint, v binary, asks boolean, list bigint, rotated binary"), "lists")
    counts = np.zeros(lists, np.int64)
    per_list = np.zeros(lists, np.int64)
    for at, n, asking in index.groupBy("list").agg(F.count(F.lit(1)), F.count_if("asks")).collect():  # one row per list
        counts[at], per_list[at] = n, asking
    spread = np.minimum(-(-counts // SPREAD), STRIPES)  # stripes of each list
    first, many = parts_of(per_list)
    probes = max(1, int(np.ceil(share * lists)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and stripe, with the lists that it probes there."""
        names = np.arange(lists)
        held = [np.array([(s - n) % STRIPES < spread[n] for n in names]) for s in range(STRIPES)]
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dim)
                rotated = space.queries(x)
                order = np.argsort(space.near(rotated), axis=1, kind="stable")
                # enough lists that the nearest can be among them, however short the lists are
                reach = np.cumsum(counts[order], axis=1)
                need = np.maximum(probes, (reach < LEAST_PROBED).sum(axis=1) + 1)
                own, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
                part = first[own] + ids // QUERIES % many[own]
                row, key, wanted = [], [], []
                for i in range(len(batch)):
                    mine = np.sort(order[i, : need[i]])
                    for stripe in range(STRIPES):
                        row.append(i)
                        key.append(int(part[i]) * STRIPES + stripe)
                        wanted.append(mine[held[stripe][mine]].astype("<i8").tobytes())
                take = pa.array(row, pa.int64())
                turned = pa.array([r.tobytes() for r in rotated.astype(np.float32)], pa.binary())
                nothing = pa.array(np.full(len(row), -1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), nothing, batch.column(0).take(take), batch.column(1).take(take), turned.take(take), pa.array(wanted, pa.binary())],
                    ["key", "list", "id", "v", "rotated", "lists"],
                )

    fields = "key bigint, list bigint, id bigint, v binary, rotated binary, lists binary"
    queries = index.where("asks").select("id", "v", "list").mapInArrow(probe, fields)
    n_parts = int((first + many).max())
    table_of = vectors.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(spread)], "list bigint, spread bigint")
    striped = index.join(F.broadcast(table_of), "list").withColumn("stripe", F.expr(f"pmod(list + pmod(xxhash64(id), spread), {STRIPES})"))
    copies = striped.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).select(
        (F.col("part") * STRIPES + F.col("stripe")).alias("key"), "list", "id", "v", "rotated", F.lit(None).cast("binary").alias("lists")
    )
    spark = vectors.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_parts * STRIPES)
    stream = queries.unionByName(copies).repartition(tasks, "key").sortWithinPartitions("key", "list", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(column: pa.Array, kind) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)

        part, key, waiting = None, None, []
        for whole in batches:
            for at in range(0, len(whole), STREAM):
                batch = whole.slice(at, STREAM)
                where, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.flatnonzero(np.diff(where) | np.diff(names)) + 1
                for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(batch)).tolist(), strict=True):
                    if where[lo] != key:
                        if part is not None:
                            yield part.result()
                        part, key, waiting = None, where[lo], []
                    rows = batch.slice(lo, hi - lo)
                    if names[lo] < 0:
                        waiting.append(rows)
                        continue
                    if part is None and waiting:
                        asked = pa.Table.from_batches(waiting)
                        part = Part(asked["id"].to_numpy(), numbers(asked["v"], np.float64), numbers(asked["rotated"], np.float32),
                                    [np.frombuffer(x, "<i8") for x in asked["lists"].to_pylist()], k)
                    if part is not None:
                        part.scan(int(names[lo]), rows.column(2).to_numpy(), numbers(rows.column(3), np.float64), numbers(rows.column(4), np.float32))
        if part is not None:
            yield part.result()

    found = stream.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
