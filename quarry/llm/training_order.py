"""Token sequences written in training order: fixed-stride shards at permuted global slots.

Documents become sequences of ``seq_len`` ids. Every sequence gets an index (its place in
its partition, plus the sequences of earlier partitions) and a global slot: a keyed Feistel
network permutes the smallest even-bit domain that holds all indexes, and indexes that land
outside walk on until they are inside. The slot range is cut evenly into shards; each
partition writes whole shards of records of one size, so slot s lies at
``s % per_shard * stride`` of shard ``s // per_shard``, and a reader resumes at any slot.

A record: doc_id and start (int64), length and zero (int32), then ``seq_len`` ids (uint16,
zeros after the last). A shard is one Parquet row (shard, first_slot, records, payload), so
shards can lie in any store that Spark writes to.

Defined results: a null or empty text is the end token alone; a row with a null id is
written with id -1; repeated rows are written each; an empty table writes no shards; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import tokenizer_path
from quarry.llm.common import U64, mix, scratch, table, text_slices
from quarry.llm.cutting_stock import token_table

END_ID = 49407
SEQ_LEN, PER_SHARD, KEY = 512, 256, 20_240_229
SHARDS_PER_TASK = 64
HEADER = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("length", "<i4"), ("zero", "<i4")])


def slots(index: np.ndarray, n: int, key: int = KEY, rounds: int = 6) -> np.ndarray:
    """Permutation of 0..n-1: a Feistel network with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)
    out = np.asarray(index, U64).copy()
    walking = np.ones(len(out), bool)
    while walking.any():
        x = out[walking]
        left, right = x >> U64(half), x & low
        for r in range(rounds):
            turned = mix(right + mix(np.array([key * 64 + r], U64)))
            left, right = right, left ^ (turned & low)
        out[walking] = left << U64(half) | right
        walking = out >= U64(n)
    return out.astype(np.int64)


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary column over an array's bytes, cut into pieces of the given sizes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _bytes_of(column: pa.Array) -> memoryview:
    """All bytes of a binary column, one value after the other."""
    if not len(column):
        return memoryview(b"")
    first = column.offset
    ends = np.frombuffer(column.buffers()[1], np.int32)[first : first + len(column) + 1]
    return memoryview(column.buffers()[2])[ends[0] : ends[-1]]


def record_type(seq_len: int) -> np.dtype:
    return np.dtype([*HEADER.descr, ("ids", "<u2", (seq_len,))])


def write_shards(docs: DataFrame, tokenizer: str, out: str, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write all sequences of ``docs`` under ``out``; returns their number."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = record_type(seq_len)
    end = END_ID.to_bytes(4, "little")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, made = token_table(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, stop in text_slices(batch.column(1), 4 << 20):
                rows = batch.slice(first, stop - first)
                ids = rows.column(0).fill_null(-1).to_pylist()
                found = []
                for doc, data in zip(ids, words.encode([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    tokens = np.frombuffer(data + end, "<u4")
                    cut = np.zeros(-(-len(tokens) // seq_len), kind)
                    cut["doc_id"], cut["start"] = doc, np.arange(len(cut)) * seq_len
                    cut["length"] = np.minimum(len(tokens) - cut["start"], seq_len)
                    whole = np.zeros(len(cut) * seq_len, "<u2")
                    whole[: len(tokens)] = tokens
                    cut["ids"] = whole.reshape(len(cut), seq_len)
                    found.append(cut)
                records = np.concatenate(found)
                n = len(records)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(made, made + n)), _binaries(records, np.full(n, kind.itemsize))], ["part", "place", "record"])
                made += n

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = scratch(spark, "sequences")
    rows.mapInArrow(sequences, "part bigint, place bigint, record binary").write.option("compression", "zstd").parquet(held)
    tokens = spark.read.schema("part bigint, place bigint, record binary").parquet(held)

    before: dict[int, int] = {}  # one number per input partition
    total = 0
    for part, n in sorted(tokens.groupBy("part").count().collect()):
        before[part] = total
        total += n
    shards = -(-total // per_shard)
    tasks = max(1, -(-shards // SHARDS_PER_TASK), min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offset = np.array([before[p] for p in batch.column(0).to_pylist()], np.int64)
            slot = slots(offset + batch.column(1).to_numpy(), total, key)
            task = slot // per_shard * tasks // shards
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(task.astype(np.int32)), batch.column(2)], ["slot", "task", "record"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records in slot order in, whole shards out."""
        number, payload = -1, bytearray()

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([number * per_shard]), pa.array([len(payload) // kind.itemsize]), pa.array([bytes(payload)], pa.binary())],
                ["shard", "first_slot", "records", "payload"],
            )

        for batch in batches:
            own = batch.column(0).to_numpy() // per_shard
            data = _bytes_of(batch.column(1))
            cuts = np.flatnonzero(np.diff(own)) + 1
            for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(own)).tolist(), strict=True):
                if lo == hi:
                    continue
                if own[lo] != number:
                    if payload:
                        yield done()
                    number, payload = int(own[lo]), bytearray()
                payload += data[lo * kind.itemsize : hi * kind.itemsize]
        if payload:
            yield done()

    dealt = tokens.mapInArrow(ordered, "slot bigint, task int, record binary")
    ranges = dealt.repartitionById(tasks, "task").sortWithinPartitions("slot").select("slot", "record")
    ranges.mapInArrow(shard, "shard bigint, first_slot bigint, records bigint, payload binary").write.option("compression", "zstd").parquet(out)
    path = spark._jvm.org.apache.hadoop.fs.Path(held)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return total


def read_sequences(spark: SparkSession, out: str, from_slot: int = 0, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD) -> DataFrame:
    """Sequences at ``from_slot`` and after it: slot, shard, byte_offset, doc_id, start,
    length, ids (binary, uint16). Shards before it aren't read."""
    kind = record_type(seq_len)
    shards = spark.read.schema("shard bigint, first_slot bigint, records bigint, payload binary").parquet(out)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                skip = max(0, from_slot - first)
                records = np.frombuffer(payload.as_buffer(), kind)[skip:]
                place = np.arange(skip, skip + len(records))
                columns = [pa.array(first + place), pa.array(np.full(len(records), shard)), pa.array(place * kind.itemsize)]
                columns += [pa.array(records[c].astype(np.int64)) for c in ("doc_id", "start", "length")]
                ids = _binaries(records["ids"][np.arange(seq_len) < records["length"][:, None]], 2 * records["length"])
                yield pa.RecordBatch.from_arrays([*columns, ids], ["slot", "shard", "byte_offset", "doc_id", "start", "length", "ids"])

    later = shards.where(F.col("shard") >= from_slot // per_shard).select("shard", "first_slot", "payload")
    return later.mapInArrow(split, "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, start bigint, length bigint, ids binary")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), out)
    return read_sequences(spark, out).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
