"""Helpers shared by the corpus operators: reading tables, shared folders, and
vectorised word hashing over whole Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarry.session import shared_dir

U64 = np.uint64
#: bytes of text worked on at a time inside a task; longer single texts form a slice of their own
SLICE_BYTES = 1 << 20
#: bytes of an Arrow batch. Each running task holds batches in the JVM and in Python; Spark's own limit is 64 MB
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a
    lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the folder behind a frame from :func:`stored`."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that tasks exchange with Python by BATCH_BYTES, whatever the length of
    a row; a smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column holding about ``limit`` bytes each (one row at least)."""
    n = len(col)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < n:
        before = total[start - 1] if start else 0
        stop = int(np.searchsorted(total, before + limit, side="right"))
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


#: bytes inside a word: all but ASCII white space, and all but ASCII white space, signs and controls
BETWEEN_SPACES = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
LETTERS_DIGITS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words_of(col: pa.Array, inner: np.ndarray = BETWEEN_SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Words of lower-cased texts: (row of each word, 64-bit hash of each word).

    A word is a run of ``inner`` bytes. The hash is a polynomial over the bytes,
    taken from prefix sums, so the whole column is hashed without a Python loop."""
    low = pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    n = len(low)
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + n + 1] if n else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    data = np.frombuffer(low.buffers()[2], np.uint8)[first:last]
    ends_of_rows = offsets - first
    inside = inner[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = ends_of_rows[1:-1]  # a new text begins a new word
    cut = cut[cut < len(data)]
    starts[cut] |= inside[cut]
    begin = np.flatnonzero(starts)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(np.where(inside, data.astype(U64) + U64(1), U64(0)) * up[: len(data)], out=total[1:])
    stop = np.append(begin[1:], len(data))  # what lies between two words adds nothing
    code = (total[stop] - total[begin]) * down[begin]
    row = np.searchsorted(ends_of_rows, begin, side="right") - 1
    return row.astype(np.int64), mix(code)
