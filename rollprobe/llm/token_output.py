"""Token-id output in binary shards with a minimal-perfect-hash index of document keys.

Payload: documents in ascending ``doc_id`` order, one file a range partition. A file is the bare ids, little-endian
unsigned, two bytes each where the vocabulary fits, else four; nothing lies between documents.
Index: keys are dealt to index parts by hash. Each part is one file with a minimal perfect hash of its keys
(levels of bit arrays; a key's slot is the rank of its bit), and by slot a 32-bit fingerprint of the key, the shard,
the first id within the shard and the number of ids. A lookup touches a few words of the bit arrays and one slot;
a key that was never stored fails the fingerprint but for 1 in 2**32.

Shards are ranges of ``doc_id`` between quantiles. Files are written by tasks under the shared folder: into a temporary name, then renamed, so a repeated or
speculative attempt leaves the same file. Texts are encoded where they lie; only ids are shuffled.

Repeated ``doc_id``s: every row is stored, copies in the order of the hash of their ids, and has a key of its own (the
``doc_id`` for the first, a hash of ``doc_id`` and number for the copies). Rows with a null ``doc_id`` are copies of one
another and come first. Null texts are empty documents. Texts may be of any length; an empty table gives no shard; extra
columns are ignored. A key that collides with another (copies only, 1 in 2**64) ends the build with an error.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_tokens import encoder
from .common import U64, drop, give_back, mix, parallelism, shared_dir, slices, small_batches, stored

MAGIC = b"IDX1"
GAMMA = 1.5  # bits of a level for each key still without a slot
LEVELS = 100  # of distinct keys, so many are never needed
PART_KEYS = 1 << 20  # keys of an index part, about


# ---------------------------------------------------------------- files on any store
def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def put(path: str, chunks: Iterator[bytes], attempt: str) -> int:
    """Write a file whole or not at all."""
    fs, p = _open(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    n = 0
    with fs.open_output_stream(f"{p}.{attempt}") as f:
        for c in chunks:
            f.write(c)
            n += len(c)
    fs.move(f"{p}.{attempt}", p)
    return n


# ---------------------------------------------------------------- minimal perfect hash
class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = np.cumsum([0, *(int(np.bitwise_count(b).sum()) for b in levels)])
        self.rank = [np.concatenate([[0], np.cumsum(np.bitwise_count(b), dtype=np.int64)]) for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(U64)
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys must be distinct")
            words = max(1, int(len(left) * GAMMA) // 64 + 1)
            at = (mix(left, len(levels) + 1) % U64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64)[at] == 1
            bits = np.zeros(words, U64)
            np.bitwise_or.at(bits, at[alone] >> 6, U64(1) << (at[alone] & 63).astype(U64))
            levels.append(bits)
            left = left[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has its bit."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[open_].astype(U64), k + 1) % U64(len(bits) * 64)).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[k] + self.rank[k][at >> 6] + below)[hit]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<I", len(b)) + b.astype("<u8").tobytes() for b in self.levels)

    @classmethod
    def load(cls, f: io.BytesIO) -> PerfectHash:
        return cls([np.frombuffer(f.read(8 * struct.unpack("<I", f.read(4))[0]), "<u8").astype(U64) for _ in range(struct.unpack("<I", f.read(4))[0])])


SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("count", "<u8")])


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(U64), 101) >> U64(32)).astype(np.uint32)


class Index:
    """One index part: keys to (shard, first id, number of ids)."""

    def __init__(self, hash_: PerfectHash, slots: np.ndarray) -> None:
        self.hash, self.slots = hash_, slots

    @classmethod
    def build(cls, keys: np.ndarray, shard: np.ndarray, first: np.ndarray, count: np.ndarray) -> Index:
        hash_ = PerfectHash.build(keys)
        slots = np.zeros(len(keys), SLOT)
        at = hash_.slots(keys)
        for name, values in (("print", fingerprint(keys)), ("shard", shard), ("first", first), ("count", count)):
            slots[name][at] = values
        return cls(hash_, slots)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, slots) for each key."""
        if not len(self.slots):
            return np.zeros(len(keys), bool), np.zeros(len(keys), SLOT)
        at = self.hash.slots(keys)
        got = self.slots[np.maximum(at, 0)]
        return (at >= 0) & (got["print"] == fingerprint(keys)), got

    def dump(self) -> bytes:
        return MAGIC + struct.pack("<Q", len(self.slots)) + self.hash.dump() + self.slots.tobytes()

    @classmethod
    def load(cls, data: bytes) -> Index:
        f = io.BytesIO(data)
        if f.read(4) != MAGIC:
            raise ValueError("not an index file")
        (n,) = struct.unpack("<Q", f.read(8))
        hash_ = PerfectHash.load(f)
        return cls(hash_, np.frombuffer(f.read(n * SLOT.itemsize), SLOT))


# ---------------------------------------------------------------- the two directions
def encoded(docs: DataFrame, vocabulary: str, end_id: int | None, bounds: np.ndarray) -> DataFrame:
    """(doc_id, ids, width, shard): each document's ids, end id included, as little-endian bytes of ``width`` a token.

    A shard holds the ids between two bounds. An id that is the bound of several shards is dealt over them at random, so
    that very many rows of one id do not land in one file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, random = encoder(vocabulary), np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for part in slices(batch, 1 << 20):
                ids, per = enc.column(part.column("text"))
                if end_id is not None:
                    ids, per = np.insert(ids, np.cumsum(per), end_id), per + 1
                width = enc.type.itemsize
                cut = np.concatenate([[0], np.cumsum(per)]).astype(np.int32) * np.int32(width)
                whole = pa.BinaryArray.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(ids.tobytes())])
                key = part.column("doc_id").fill_null(-(2**63)).to_numpy()  # null ids come first
                low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
                shard = (low + (random.random(len(key)) * (high - low + 1)).astype(np.int64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), whole, pa.array(np.full(len(per), width, np.int32)), pa.array(shard)], names=["doc_id", "ids", "width", "shard"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids binary, width int, shard int")


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int | None, shards: int | None = None) -> DataFrame:
    """Write shards and index below ``path``; returns the shards: shard, width, base (ids of all shards before), n_ids, parts."""
    spark = docs.sparkSession
    small_batches(spark)
    n = shards or parallelism(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, keys, sizes = task.partitionId(), [], []
        first = next(batches, None)
        if first is None:
            return
        width = first.column("width")[0].as_py() if first.num_rows else 2

        def payload() -> Iterator[bytes]:
            for batch in (x for y in ([first], batches) for x in y):
                keys.append(batch.column("doc_id"))
                sizes.append(np.diff(np.frombuffer(batch.column("ids").buffers()[1], np.int32, batch.num_rows + 1, batch.column("ids").offset * 4)).astype(np.int64) // width)
                for x in batch.column("ids"):
                    yield x.as_buffer()

        put(f"{path}/ids/{shard:06d}.{width * 8}", payload(), str(task.taskAttemptId()))
        at = 0
        for key, count in zip(keys, sizes, strict=True):
            begin = at + np.cumsum(count) - count
            at += int(count.sum())
            yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(count), shard, np.int32)), pa.array(begin), pa.array(count), pa.array(np.full(len(count), width, np.int32))], names=["doc_id", "shard", "first", "count", "width"])

    parts_of = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)] or [0.5], 10000).alias("q")).first().q  # n ids
    bounds = np.array(parts_of or [], np.int64)[: n - 1]
    dealt = encoded(docs, vocabulary, end_id, bounds).repartitionById(n, "shard").withColumn("h", F.xxhash64("ids")).sortWithinPartitions("doc_id", "h")
    table = stored(dealt.select("doc_id", "ids", "width").mapInArrow(write, "doc_id long, shard int, first long, count long, width int"), f"{path}/rows")

    sums = table.groupBy("shard", "width").agg(F.sum("count").alias("n_ids"), F.count("*").alias("rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    sums = stored(sums.select("shard", "width", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_ids", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"), "rows"), f"{path}/sums")
    parts = max(1, n, -(-(sums.agg(F.sum("rows")).first()[0] or 0) // PART_KEYS))

    def index(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        c = {x: t.column(x).to_numpy() for x in ("key", "shard", "first", "count")}
        put(f"{path}/index/{part:06d}", iter([Index.build(c["key"], c["shard"], c["first"], c["count"]).dump()]), str(TaskContext.get().taskAttemptId()))
        return pa.table({"part": pa.array([part], pa.int32()), "keys": pa.array([t.num_rows], pa.int64())})

    # the number of a copy is its place behind the first row of its doc_id, counted over all files
    many = table.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    placed = table.select("doc_id", "shard", "first", "count").join(many.withColumnRenamed("doc_id", "again"), F.col("doc_id").eqNullSafe(F.col("again")), "left_outer")
    plain = placed.where("doc_id is not null and again is null").withColumn("copy", F.lit(0).cast("long")).drop("again")
    hot = placed.where("doc_id is null or again is not null").drop("again")
    inside = Window.partitionBy("doc_id", "shard").orderBy("first", "count")
    hot = hot.withColumn("nth", F.row_number().over(inside) - 1)
    per = hot.groupBy("doc_id", "shard").agg(F.count("*").alias("c"))
    per = per.select(F.col("doc_id").alias("d"), F.col("shard").alias("s"), F.coalesce(F.sum("c").over(Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row for an id and file
    hot = hot.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("shard") == F.col("s"))).select("doc_id", "shard", "first", "count", (F.col("base") + F.col("nth")).cast("long").alias("copy"))
    keyed = plain.select("doc_id", "shard", "first", "count", "copy").union(hot).withColumn("key", key_of()).select("key", "shard", "first", "count", part_of(parts).alias("part"))
    keyed.groupBy("part").applyInArrow(index, "part int, keys long").write.mode("overwrite").parquet(f"{path}/parts")
    out = stored(sums.select("shard", "width", "base", "n_ids", F.lit(parts).alias("parts")), f"{path}/shards")
    drop(spark, f"{path}/rows")
    return out


def key_of():
    """The key of copy ``copy`` of ``doc_id``."""
    return F.when(F.col("doc_id").isNotNull() & (F.col("copy") == 0), F.col("doc_id")).otherwise(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy")))


def part_of(parts: int):
    return F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")


def read_ids(keys: DataFrame, path: str) -> DataFrame:
    """Look each key up through the index and read its ids: doc_id, copy, shard, start, n_tokens, ids_crc32, found.

    ``keys`` needs a ``doc_id`` and may have a ``copy`` (0, the first, where it is absent); repeated keys are read once
    for all. Unknown keys come back with ``found`` false.
    """
    spark = keys.sparkSession
    small_batches(spark)
    shards = spark.read.parquet(f"{path}/shards")
    parts, width = shards.select(F.coalesce(F.max("parts"), F.lit(1)), F.coalesce(F.max("width"), F.lit(2))).first()

    def look(t: pa.Table) -> pa.Table:
        part, key = t.column("part")[0].as_py(), t.column("key").to_numpy()
        fs, p = _open(f"{path}/index/{part:06d}")
        if fs.get_file_info(p).type == pa.fs.FileType.File:
            with fs.open_input_stream(p) as f:
                found, s = Index.load(f.read()).look(key)
        else:
            found, s = np.zeros(len(key), bool), np.zeros(len(key), SLOT)
        return pa.table({"doc_id": t.column("doc_id"), "copy": t.column("copy"), "shard": s["shard"].astype(np.int32), "first": s["first"].astype(np.int64), "count": s["count"].astype(np.int64), "found": found})

    copy = F.col("copy").cast("long") if "copy" in keys.columns else F.lit(0).cast("long")
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id"), copy.alias("copy")).distinct().withColumn("key", key_of()).withColumn("part", part_of(parts))
    at = wanted.groupBy("part").applyInArrow(look, "doc_id long, copy long, shard int, first long, count long, found boolean")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, f = np.dtype(f"<u{width}"), None, None
        for batch in batches:
            crc = []
            for shard, first, count, found in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "count", "found")), strict=True):
                if not found:
                    crc.append(0)
                    continue
                if shard != now:
                    fs, p = _open(f"{path}/ids/{shard:06d}.{8 * width}")
                    now, f = shard, fs.open_input_file(p)
                f.seek(first * width)
                crc.append(zlib.crc32(np.frombuffer(f.read(count * width), kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "copy", "shard", "first", "count", "found")), pa.array(crc, pa.int64())], names=["doc_id", "copy", "shard", "first", "count", "found", "ids_crc32"])

    near = at.repartition(parallelism(spark), "shard").sortWithinPartitions("shard", "first")
    read = near.mapInArrow(ids, "doc_id long, copy long, shard int, first long, count long, found boolean, ids_crc32 long")
    base = shards.select("shard", "base")
    return read.join(base, "shard", "left").select("doc_id", "copy", F.when(F.col("found"), F.col("base") + F.col("first")).alias("start"), F.when(F.col("found"), F.col("count")).alias("n_tokens"), F.when(F.col("found"), F.col("ids_crc32")).alias("ids_crc32"), "shard", "found")


def token_output(docs: DataFrame, vocabulary: str, end_id: int | None, path: str | None = None) -> DataFrame:
    """Write the ids of all documents, then read every document back by its key: one row for each row of ``docs``."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens"
    write_ids(docs, path, vocabulary, end_id)
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    return read_ids(counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")), path)
