"""Hard negatives by a norm-bucketed search: the best candidates below a window's upper limit, for every anchor and positive.

Components x become ``floor(scale * x)``; a score is the integer inner product with the anchor. An anchor's positives are
its best ``positives`` other rows of the same label. For each, the best ``negatives`` rows of other labels are wanted
whose score lies in ``[low% , high%]`` of the positive's (exact integer bounds). Ties go to the smaller ``vec_id``.

1. Candidates are sorted by norm (range partitions, so that any number of equal norms spreads) and cut into buckets of at
   most ``BUCKET`` rows that know their greatest norm; for the positives they are sorted by label first and buckets end
   where a label does.
2. Anchors stand in blocks of at most ``BLOCK`` rows of similar need: a bucket can only hold something for an anchor if
   ``|anchor| * (greatest norm) >= need`` (Cauchy-Schwarz), where need is the window's lower limit or, once that many are
   found, the score of the last one held.
3. Buckets are searched in three waves (two for the positives) from the greatest norms down. A wave joins blocks with the buckets
   that their bound lets through, each pair is one group of bounded size, and puts out only rows that reach the need; then
   the running last scores are taken anew, and with them the next wave's bounds.

Scores are exact: products of norms below 2**53 go through floating-point products, which are exact there; larger ones
through Python integers, and scores beyond a long saturate. Rows with a null id, label or vector, or a component that is
null or (also after scaling) not finite, take no part, nor do vectors of another than the most common length (ties: the
shorter one). Of rows of one ``vec_id`` the one with the smallest label, then the smallest bytes of its components,
stands; repeated rows count once. Extra columns are ignored, an empty table gives no row, an anchor without positives or
windows without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Tables, numbered

BUCKET = 4096  # candidates of a bucket
BLOCK = 4096  # anchors of a block
BLOCK_BYTES = 8 << 20  # of vectors in either
EXACT = 2.0**52  # products of norms below this are exact in double precision
LONG = 2**63 - 1


def prepared(vectors: DataFrame, relabel: Column, scale: int) -> DataFrame:
    """(vec_id, label, v, d, n2): components as little-endian doubles in a binary, their number, and the squared norm."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e")).where("vec_id is not null and label is not null and e is not null")
    rows = rows.withColumn("label", relabel).where("label is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * flat) + 0.0  # no negative zero
            d = np.asarray(b.column("e").value_lengths(), dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(d)])
            ok = [bool(np.isfinite(flat[x:y]).all()) for x, y in zip(at[:-1], at[1:], strict=True)]
            with np.errstate(over="ignore"):
                n2 = [float(min(np.dot(flat[x:y], flat[x:y]), 1e300)) if k else 0.0 for x, y, k in zip(at[:-1], at[1:], ok, strict=True)]
            v = [flat[x:y].astype("<f8").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            kept = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([c.take(kept) for c in (b.column("vec_id"), b.column("label"), pa.array(v, pa.binary()), pa.array(d, pa.int32()), pa.array(n2, pa.float64()))], names=["vec_id", "label", "v", "d", "n2"])

    rows = rows.mapInArrow(run, "vec_id long, label long, v binary, d int, n2 double")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v", "d", "n2")).alias("m")).select("vec_id", "m.*")


def bucketed(t: Tables, rows: DataFrame, size: int) -> DataFrame:
    """Rows with their bucket: its number in the order of falling norms among those of the group ``g``."""
    placed = numbered(t, rows, "g", [F.desc("n2"), F.col("vec_id")], 2 * size)
    return t.keep(placed.withColumn("bucket", F.floor(F.col("nth") / size).cast("long")).drop("part", "nth"))


def product(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs; those beyond a long saturate."""
    with np.errstate(over="ignore"):
        most = np.sqrt((a * a).sum(axis=1).max(initial=0.0)) * np.sqrt((v * v).sum(axis=1).max(initial=0.0))
    if most < EXACT:
        return (a @ v.T).astype(np.int64)
    ia, iv = ([[int(x) for x in row] for row in m] for m in (a, v))
    return np.array([[max(-LONG, min(LONG, sum(x * y for x, y in zip(p, q, strict=True)))) for q in iv] for p in ia], np.int64).reshape(len(a), len(v))


def matrix(col: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(-1, d)


def best_positives(d: int, top: int):
    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """The best rows of a bucket for every anchor of a block, all of one label, that reach its need."""
        out = [[np.zeros(0, np.int64)] * 3]
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")  # a stable order by score leaves ties in order of the ids
            ids, v, mine, need = rows.column("vec_id").to_numpy(), matrix(rows.column("v"), d), anchors.column("anchor_id").to_numpy(), anchors.column("need").to_numpy()
            a = matrix(anchors.column("av"), d)
            for x in range(0, len(a), 256):
                s = product(a[x : x + 256], v)
                for i in range(len(s)):
                    j = np.flatnonzero((s[i] >= need[x + i]) & (ids != mine[x + i]))
                    j = j[np.argsort(-s[i, j], kind="stable")[:top]]
                    out.append([np.full(len(j), mine[x + i]), ids[j], s[i, j]])
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["anchor_id", "vec_id", "score"])

    return meet, "anchor_id long, vec_id long, score long"


def best_negatives(d: int, top: int):
    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """The best rows of a bucket in every window of every anchor of a block, of other labels, that reach its need."""
        out = [[np.zeros(0, np.int64)] * 4]
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            ids, label, v = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("v"), d)
            mine, own, a, need = anchors.column("anchor_id").to_numpy(), anchors.column("label").to_numpy(), matrix(anchors.column("av"), d), anchors.column("need").to_numpy()
            windows = anchors.column("windows").to_pylist()
            for x in range(0, len(a), 256):
                s = product(a[x : x + 256], v)
                for i in range(len(s)):
                    j = np.flatnonzero((s[i] >= need[x + i]) & (label != own[x + i]))
                    j = j[np.argsort(-s[i, j], kind="stable")]
                    fall = -s[i, j]
                    for w in windows[x + i]:
                        first, stop = np.searchsorted(fall, -w["high"]), np.searchsorted(fall, -w["need"], side="right")
                        k = j[first : min(stop, first + top)]
                        out.append([np.full(len(k), mine[x + i]), np.full(len(k), w["positive_id"]), ids[k], s[i, k]])
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["anchor_id", "positive_id", "vec_id", "score"])

    return meet, "anchor_id long, positive_id long, vec_id long, score long"


def _wave(t: Tables, anchors: DataFrame, rows: DataFrame, buckets: DataFrame, first: float, stop: float, size: int, meet, schema: str) -> DataFrame:
    """What ``meet`` finds between the anchors and those buckets that can hold something for them.

    Of each group's buckets, in the order of falling norms, the wave takes the share from ``first`` to ``stop``. Anchors
    stand in blocks by the norm (``n2``) that a bucket must have for them.
    """
    asks = F.when(F.col("need") <= 0, F.lit(0.0)).otherwise(F.col("need").cast("double") * F.col("need").cast("double") / F.greatest("n2", F.lit(1e-9)) * (1 - 1e-9))
    blocked = bucketed(t, anchors.withColumn("n2", asks), size).withColumnRenamed("bucket", "block")
    least = blocked.groupBy("g", "block").agg(F.min("n2").alias("asks"))
    many = buckets.groupBy("g").agg(F.count("*").alias("n"))
    begin, end = (F.lit(0).cast("long") if share == 0 else F.greatest(F.floor(F.col("n") * share), F.lit(1)).cast("long") for share in (first, stop))
    asked = least.join(many, "g").select("g", "block", "asks", F.explode(F.when(begin < end, F.sequence(begin, end - 1))).alias("bucket"))
    pairs = t.keep(asked.join(buckets, ["g", "bucket"]).where("top >= asks").select("g", "block", "bucket"))
    left = blocked.join(pairs, ["g", "block"]).drop("n2", "vec_id")
    right = rows.join(pairs, ["g", "bucket"]).select("g", "bucket", "block", "vec_id", "label", "v")
    key = ["g", "block", "bucket"]
    got = t.keep(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema))
    t.release(blocked, pairs)
    return got


def mine(vectors: DataFrame, anchors: Column, relabel: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on vec_id; ``relabel`` an expression of vec_id and label that replaces the label.
    """
    t = Tables(vectors.sparkSession)
    rows = t.keep(prepared(vectors, F.col("label") if relabel is None else relabel, scale))
    sizes = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if sizes is None or sizes.d == 0:
        return t.spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    d = sizes.d
    rows = rows.where(F.col("d") == d).drop("d")
    bucket, block = (max(1, min(n, BLOCK_BYTES // (8 * d))) for n in (bucket, block))
    asking = rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), "vec_id", "label", F.col("v").alias("av"), "n2")

    # positives: the anchor's label is the group, an eighth of its buckets come first
    placed = bucketed(t, rows.withColumn("g", F.col("label")), bucket)
    buckets = t.keep(placed.groupBy("g", "bucket").agg(F.max("n2").alias("top")))
    held = asking.withColumn("g", F.col("label"))
    found = _search(t, held.withColumn("need", F.lit(-LONG)), held, ["anchor_id"], placed, buckets, (0, 1 / 8, 1), block, positives, *best_positives(d, positives))

    # windows: ceil(low% of the score) to floor(high% of it), without overflow; a negative score has none
    part = lambda p, up: F.expr(f"(score div 100) * {p} + ({p} * (score % 100) + {99 if up else 0}) div 100")
    windows = found.where("score >= 0").select("anchor_id", F.col("vec_id").alias("positive_id"), "score", part(low, True).alias("low"), part(high, False).alias("high")).where("low <= high")
    windows = t.keep(windows)
    t.release(placed, buckets, found)
    placed = bucketed(t, rows.withColumn("g", F.lit(0).cast("long")), bucket)
    buckets = t.keep(placed.groupBy("g", "bucket").agg(F.max("n2").alias("top")))
    best = _search(t, windows.withColumn("need", F.col("low")), asking.withColumn("g", F.lit(0).cast("long")), ["anchor_id", "positive_id"], placed, buckets, (0, 1 / 64, 1 / 8, 1), block, negatives, *best_negatives(d, negatives))
    by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    out = best.join(windows.select("anchor_id", "positive_id", F.col("score").alias("positive_score")), ["anchor_id", "positive_id"]).withColumn("rank", F.row_number().over(by))
    out = t.keep(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    t.release_but(out)
    return out


def _search(t: Tables, asked: DataFrame, anchors: DataFrame, key: list[str], placed: DataFrame, buckets: DataFrame, shares: tuple[float, ...], block: int, top: int, meet, schema: str) -> DataFrame:
    """The ``top`` rows of each key, wave after wave; ``asked`` has the keys with their need at first."""
    best, most = None, buckets.groupBy("g").count().agg(F.max("count")).first()[0]
    by = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    ends = [0 if s == 0 else max(int(most * s), 1) for s in shares]  # waves that are empty in the largest group are left out
    steps = [s for k, s in enumerate(shares) if k == 0 or ends[k] > ends[k - 1]]
    for first, stop in zip(steps[:-1], steps[1:], strict=True):
        need = asked
        if best is not None:
            last = best.groupBy(*key).agg(F.count("*").alias("n"), F.min("score").alias("last")).where(f"n >= {top}").drop("n")
            need = asked.join(last, key, "left").withColumn("need", F.greatest("need", F.coalesce("last", "need"))).drop("last")
        if len(key) > 1:  # several windows of an anchor: it needs what the least of them does
            held = need.groupBy("anchor_id").agg(F.min("need").alias("need"), F.collect_list(F.struct("positive_id", "high", "need")).alias("windows"))
            held = anchors.join(held, "anchor_id")
        else:
            held = need
        got = _wave(t, held, placed, buckets, first, stop, block, meet, schema)
        both = got if best is None else best.unionByName(got)
        before, best = best, t.keep(both.withColumn("nth", F.row_number().over(by)).where(f"nth <= {top}").drop("nth"))
        t.release(got, before)
    return best
