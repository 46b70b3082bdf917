"""What several corpus operators share: the shared folder, Arrow mapping, and vectorised word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent a temporary folder takes its place on one machine (tests); on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rollprobe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rollprobe-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later steps start from files, not from lineage.

    The shuffle files of the write go when it ends; nothing reads them again.
    """
    conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean, None)
    conf.set(clean, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.unset(clean) if before is None else conf.set(clean, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store with Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


CACHES: list[dict] = []  # what tasks of one kind leave in a worker for each other


def empty_caches() -> None:
    """Tasks of another kind begin: what earlier ones left in the worker goes."""
    if any(CACHES):
        for c in CACHES:
            c.clear()
        give_back()


def give_back() -> None:
    """Return freed buffers to the system: a worker lives on between tasks and keeps what its allocators hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows hold whole texts: fewer of them in a batch between Spark and Python keep a task's memory small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, max_bytes: int = 1 << 20) -> DataFrame:
    """``mapInArrow`` over slices of at most ``max_bytes`` (one row at least); ``fn`` yields column dicts."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(kind)
        empty_caches()
        for batch in batches:
            for part in slices(batch, max_bytes):
                for cols in fn(part):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], (pa.Array, pa.ChunkedArray)) else cols[f.name].cast(f.type) for f in out], schema=out)
        give_back()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its string, binary and list columns reach ``max_bytes``."""
    n = batch.num_rows
    if not n:
        return
    size = np.full(n, 16, dtype=np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            size += np.diff(offsets(col))
        elif pa.types.is_list(col.type):
            size += 8 * np.diff(np.frombuffer(col.buffers()[1], np.int32, n + 1, col.offset * 4))
    start, block = 0, np.cumsum(size) // max_bytes
    for stop in [*(np.flatnonzero(np.diff(block)) + 1).tolist(), n]:
        if stop > start:
            yield batch.slice(start, stop - start)
        start = stop


# ---------------------------------------------------------------- text buffers
def offsets(col: pa.Array) -> np.ndarray:
    return np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the offset of each row, from 0."""
    if col.null_count:
        col = pa.array(col.fill_null(""))
    at, data = offsets(col), col.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return whole, at - at[0]


# ---------------------------------------------------------------- hashing
def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    h = h.astype(U64, copy=True) + U64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> U64(shift)
        h *= U64(mul)
    return h ^ (h >> U64(31))


BASE = 0x9E3779B97F4A7C15 | 1
LETTER = mix(np.arange(256, dtype=U64), 77) | U64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
FOLDED = LETTER[_FOLD]  # A-Z hash as a-z
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            step = np.full(size, b, U64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of all rows of a text column: byte range, row and 64-bit hash of each, in order."""

    def __init__(self, col: pa.Array, separators: np.ndarray = SPACE, table: np.ndarray = FOLDED) -> None:
        self.data, self.at = text_bytes(col)
        n, data = len(self.data), self.data
        inside = ~separators[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        row_start = self.at[:-1][self.at[:-1] < self.at[1:]]
        before[row_start] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[row_start[1:] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(self.at, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.at)  # index of each row's first word
        self.pw, self.ipw = powers(n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(table[data] * self.pw, out=self.sums[1:])
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range."""
        return mix((self.sums[end] - self.sums[start]) * self.ipw[np.minimum(start, max(len(self.ipw) - 1, 0))]) if len(start) else np.zeros(0, U64)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words (a shorter text: its whole sequence), and each row's first index.

    The top byte falls with the letters of the run, so that in the order of the hashes long runs, which are rare,
    come before runs of short words, which many texts share.
    """
    h, n_words = words.hash, np.diff(words.first)
    count = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1], U64)
    letters = np.concatenate([[0], np.cumsum(words.end - words.start)])
    begin = np.repeat(words.first[:-1] - first[:-1], count) + np.arange(first[-1])
    size = letters[np.minimum(begin + k, np.repeat(words.first[1:], count))] - letters[begin]
    with np.errstate(over="ignore"):
        if len(h) >= k:
            run = sum((h[i : len(h) - k + 1 + i] * U64((0xD6E8FEB86659FD93 + 2 * i * 0x632BE59BD9B4E019) & (2**64 - 1) | 1) for i in range(k)), np.zeros(len(h) - k + 1, U64))
            rows = np.repeat(np.arange(len(count)), count)
            long = n_words[rows] >= k
            src = words.first[rows] + np.arange(first[-1]) - first[rows]
            out[long] = run[src[long]]
        for r in np.flatnonzero((n_words > 0) & (n_words < k)):
            ws = h[words.first[r] : words.first[r + 1]]
            out[first[r]] = _short(ws)
    return (U64(255) - np.minimum(size, 255).astype(U64)) << U64(56) | mix(out, 3) >> U64(8), first


def _short(ws: np.ndarray) -> np.uint64:
    total = len(ws) * 0xA24BAED4963EE407
    for i, w in enumerate(mix(ws, 9).tolist()):
        total += w * (0x9FB21C651E98DF25 + 2 * i)
    return U64(total % 2**64)
