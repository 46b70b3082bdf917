"""Best-fit packing of tokenized documents into sequences of a fixed length, in bulk-synchronous rounds.

Documents longer than a sequence are cut into full pieces and a rest. Lengths are integers up to the sequence
length, so the range-sorted tables of pieces and of gaps are tables of runs of equal values: at most ``size`` runs of
pieces at any corpus size. The rounds work on those tables:

* tasks tokenize, cut, and count their pieces by length; the counts of all tasks give the sorted runs of pieces, and
  a running sum over tasks gives every piece its rank in its run (no run is gathered anywhere);
* a round sweeps pieces and gaps together from the largest value down. A run of pieces takes the smallest gaps that
  are large enough and not yet taken (its successors); where several runs want one gap, the longer pieces rank first,
  and pieces of one length go by their rank. As many pieces of a run go into a gap as fit. The sweep is distributed: ranges
  of values are swept apart, and what they leave open is swept once more across ranges (pairs that a range finds on its
  own are those of the whole sweep, as with nested brackets);
* updated gaps are offered in the next round. A round takes pieces of at least ``SHARE`` of the longest open one, so that
  small pieces are left for small gaps. Where nothing fits, new sequences are opened, as many as the open pieces
  of the round fill; rounds go on until no piece is open;
* the rounds yield intervals (length, ranks, sequences, offset), which every task applies to its own pieces.

Null texts are empty documents (one piece, of the end id alone); rows with a null ``doc_id`` are packed like others;
repeated rows are packed as often as they occur; a text of any length is cut into pieces; an empty table gives no row;
extra columns are ignored. Without an end id, empty documents have no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunk_tokens import encoder
from .common import drop, give_back, shared_dir, slices, small_batches, stored

RANGES = 8  # of values that are swept apart
SHARE = 0.25  # of the longest open piece: shorter ones wait
GAP, PIECE, PLACED, UPDATED = range(4)  # kinds of rows of a round
RUNS = "kind int, value int, first long, n long, each int, seq long, offset int"

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int | None, size: int) -> DataFrame:
    """Pieces of every document, each with its number among its task's pieces of that length."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(vocabulary, spaceless=True), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        end = [] if end_id is None else [end_id]
        for batch in batches:
            for part in slices(batch, 1 << 20):
                ids, per = enc.column(part.column("text"))
                if end:
                    ids, per = np.insert(ids, np.cumsum(per), end[0]), per + 1
                wide = ids.astype("<u4")
                cuts = np.maximum(1, -(-per // size))  # pieces of each document
                doc = np.repeat(np.arange(len(per)), cuts)
                nth_piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = nth_piece * size
                length = np.minimum(per[doc] - start, size)
                at = (np.cumsum(per) - per)[doc] + start
                data = memoryview(wide.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")  # number of each among the pieces of its length
                sorted_ = length[order]
                nth = np.zeros(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(length, minlength=size + 1)
                columns = part.column("doc_id").take(pa.array(doc)), pa.array(nth_piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)
                yield pa.RecordBatch.from_arrays(list(columns), names=[x.split()[0] for x in PIECES.split(", ")])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(fn, PIECES)


def sweep(rows: list[tuple[int, int, int, int]], size: int, least: int) -> list[tuple]:
    """One sweep over rows (kind, value, first, n) from the largest value down; rows of RUNS.

    A gap's ``first`` is a sequence, a piece's its rank. Pieces shorter than ``least`` are passed on.
    """
    out: list[tuple] = []
    open_: list[list[int]] = []  # gaps at least as large as the row at hand, the smallest last
    for kind, value, first, n in sorted(rows, key=lambda r: (-r[1], r[0], r[2])):
        if kind == GAP:
            open_.append([value, first, n])
            continue
        while n and open_ and value >= least:
            gap, seq, many = open_[-1]
            each = gap // value
            seqs, k = (min(many, n // each), each) if n >= each else (1, n)
            out.append((PLACED, value, first, seqs * k, k, seq, size - gap))
            if gap > k * value:
                out.append((UPDATED, gap - k * value, seq, seqs, 0, 0, 0))
            first, n = first + seqs * k, n - seqs * k
            open_[-1][1:] = seq + seqs, many - seqs
            if many == seqs:
                open_.pop()
        if n:
            out.append((PIECE, value, first, n, 0, 0, 0))
    return out + [(GAP, *g, 0, 0, 0) for g in open_]


def matched(now: DataFrame, size: int, least: int) -> DataFrame:
    """Rows after a round's sweeps: within ranges of values, then across them."""

    def swept(t: pa.Table) -> pa.Table:
        cols = [t.column(c).to_pylist() for c in ("kind", "value", "first", "n", "each", "seq", "offset")]
        rows = list(zip(*cols, strict=True))
        out = [r for r in rows if r[0] > PIECE] + sweep([r[:4] for r in rows if r[0] <= PIECE], size, least)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in RUNS.split(", ")])

    apart = now.groupBy(F.floor(F.col("value") * RANGES / (size + 1)).alias("range")).applyInArrow(swept, RUNS)
    return apart.groupBy((F.col("kind") * 0).alias("all")).applyInArrow(swept, RUNS)  # runs that are left: at most ``size`` of pieces, and gaps


def intervals(runs: DataFrame, size: int, path: str) -> DataFrame:
    """Rounds over runs (value, n) of pieces until all are placed; rows of kind PLACED."""
    spark = runs.sparkSession
    none = [F.lit(0).cast(t).alias(c) for c, t in (("each", "int"), ("seq", "long"), ("offset", "int"))]
    now = stored(runs.select(F.lit(PIECE).alias("kind"), F.col("value").cast("int").alias("value"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), *none), f"{path}/0")
    placed, opened, new, k = [], 0, None, 0
    piece = F.col("kind") == PIECE
    while True:
        top = F.max(F.when(piece, F.col("value")))
        s = now.agg(top.alias("top"), F.sum(F.when(F.col("kind") == PLACED, F.col("n"))).alias("placed"), F.sum(F.when(piece & (2 * F.col("value") > size), F.col("n"))).alias("halves")).first()
        if k:
            placed.append(now.where(F.col("kind") == PLACED))
        if s.top is None:
            return spark.createDataFrame([], RUNS) if not placed else _union(placed)
        least, new = int(np.ceil(s.top * SHARE)), 0
        if not k:
            new = s.halves or 0  # no two of these share a sequence
        if not (s.placed or new):
            filled = now.where(piece & (F.col("value") >= least)).agg(F.sum(F.col("value") * F.col("n"))).first()[0]
            new = -(-filled // size)
        open_ = now.where(F.col("kind") != PLACED).withColumn("kind", F.when(F.col("kind") == UPDATED, GAP).otherwise(F.col("kind")))
        if new:
            open_ = open_.union(spark.range(1).select(F.lit(GAP), F.lit(size), F.lit(opened).cast("long"), F.lit(new).cast("long"), *none))
            opened += new
        k += 1
        now = stored(matched(open_, size, least), f"{path}/{k}")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int | None, size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    at = shared_dir(spark)
    table = stored(pieces(docs, vocabulary, end_id, size), f"{at}/pieces")
    counts = stored(table.where("length > 0").groupBy("length", "task").agg(F.count("*").alias("n")), f"{at}/counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rounds = intervals(counts.groupBy(F.col("length").alias("value")).agg(F.sum("n").alias("n")), size, f"{at}/rounds")
    plan = rounds.select("value", "first", "n", "each", "seq", "offset").toPandas().to_numpy(np.int64).reshape(-1, 6)
    drop(spark, f"{at}/rounds")
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = spark.sparkContext.broadcast(plan[order])  # intervals of at most ``size`` runs: grows with the length of a sequence, not with the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("base").to_numpy() + b.column("nth").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                lo, hi = np.searchsorted(plan[:, 0], [v, v + 1])
                rows = np.flatnonzero(length == v)
                p = plan[lo:hi][np.searchsorted(plan[lo:hi, 1], rank[rows], side="right") - 1]
                i = rank[rows] - p[:, 1]
                seq[rows], offset[rows] = p[:, 4] + i // p[:, 3], p[:, 5] + (i % p[:, 3]) * v
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start")), pa.array(length), b.column("ids_crc32"), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = table.where("length > 0").join(based, ["length", "task"])
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
