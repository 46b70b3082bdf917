"""Approximate nearest neighbours over learned partitions.

Fit: on a bounded sample (``sample_size`` vectors, smallest hash of the id) a task cuts the exact neighbour graph of the
sample into ``parts`` balanced partitions by recursive spectral bisection with swaps, and trains a small classifier (one
hidden layer) that learns the partition of a vector from its coordinates, with the neighbours' partitions as soft
labels. The number of partitions to probe is the smallest that reaches ``target`` recall on every fifth vector of the
sample, as queries and as neighbours; these are held out from the graph and the training. Partitions of more than
``LEAF`` vectors are cut again in the same way, each from a sample of its own, so partitions stay about as large at any
number of rows; the classifiers are broadcast, and cutting ends before they take more than ``ROUTERS_BYTES``.

Index and search cover all rows: every vector belongs to its most probable partition; a query goes to its most probable
partitions (at every level the number found for that classifier), meets their vectors in blocks (vectors and queries of
a partition are dealt into blocks of bounded size, so no partition has to fit a task), and the best of all blocks are
merged. A query that finds fewer than ``top`` goes to all partitions. Scores are exact cosines in double precision of
vectors scaled by powers of two, so that very large and very small components neither overflow nor vanish.

Vectors that are null, zero or hold null or non-finite components take no part. Ties go to the smaller vec_id; a row is
left out of its own query by its id. Repeated rows count once. Where one vec_id has several vectors, the smallest of them
(component by component) asks, and as a candidate the nearest one counts. Vectors must have one length; others than the
most common length take no part. Extra columns are ignored, an empty table gives no row.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

BLOCK = 2048  # vectors of a block
QUERIES = 2048  # queries of a block
LEAF = 65536  # vectors of a partition that is not cut again
ROUTERS_BYTES = 64 << 20


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probe: int
    recall: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest of every unit vector, in blocks of rows."""
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(near: np.ndarray, rows: np.ndarray, r: np.random.Generator, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few neighbour edges between them."""
    place = np.full(len(near), -1)
    place[rows] = np.arange(len(rows))
    j = place[near[rows]]
    i = np.repeat(np.arange(len(rows)), near.shape[1])[(j >= 0).ravel()]
    j = j[j >= 0]
    add = lambda v: np.bincount(i, v[j], minlength=len(rows)) + np.bincount(j, v[i], minlength=len(rows))
    degree = np.maximum(np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows)), 1)
    v = r.standard_normal(len(rows))
    for _ in range(rounds):  # second eigenvector of the random walk, by power iteration
        v = 0.5 * (v + add(v) / degree)
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(len(rows), bool)
    side[np.argsort(v, kind="stable")[len(rows) // 2 :]] = True
    for _ in range(8):  # swap the pairs that gain most
        pull = add(np.where(side, 1.0, -1.0))
        gain = np.where(side, -pull, pull)
        a, b = (np.flatnonzero(m)[np.argsort(-gain[m], kind="stable")] for m in (side, ~side))
        n = min(len(a), len(b), max(1, len(rows) // 16))
        ok = gain[a[:n]] + gain[b[:n]] > 0
        if not ok.any():
            break
        side[a[:n][ok]], side[b[:n][ok]] = False, True
    return rows[~side], rows[side]


def partition(near: np.ndarray, parts: int) -> np.ndarray:
    r, todo, label = np.random.default_rng(3), [np.arange(len(near))], np.zeros(len(near), np.int64)
    while len(todo) < parts:
        todo = [h for rows in todo for h in bisect(near, rows, r)]
    for k, rows in enumerate(todo):
        label[rows] = k
    return label


def train(sample: np.ndarray, parts: int, top: int, target: float, hidden: int = 64, epochs: int = 40) -> Router:
    """Partition the graph of four fifths of the sample, learn to route, choose on the rest how many partitions to probe."""
    d = sample.shape[1]
    held = np.arange(len(sample)) % 5 == 4
    x, unseen = sample[~held], sample[held]
    k = min(10, len(x) - 1)
    if k < 1 or len(sample) < 8 * parts:  # too few to learn from: all are one partition
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1, 1.0)
    near = graph(x, k)
    label = partition(near, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.arange(len(x)), label), 0.5)
    np.add.at(soft, (np.repeat(np.arange(len(x)), k), label[near].ravel()), 0.5 / k)
    r = np.random.default_rng(5)
    p = [r.standard_normal((d, hidden)) / np.sqrt(d) * 2, np.zeros(hidden), r.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    m, v, n = [0 * a for a in p], [0 * a for a in p], 0
    for _ in range(epochs):
        order = r.permutation(len(x))
        for a in range(0, len(x), 256):
            b = order[a : a + 256]
            h = np.tanh(x[b] @ p[0] + p[1])
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (e / e.sum(axis=1, keepdims=True) - soft[b]) / len(b)
            dh = dz @ p[2].T * (1 - h**2)
            n += 1
            for i, g in enumerate((x[b].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g**2
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**n)) / (np.sqrt(v[i] / (1 - 0.99**n)) + 1e-8)
    router = Router(*p, probe=parts, recall=1.0)
    if len(unseen) < 2:
        return router
    order = np.argsort(-router.scores(unseen), axis=1, kind="stable")
    home, q = order[:, 0], np.arange(0, len(unseen), max(1, len(unseen) // 1024))
    truth = graph(unseen, min(top, len(unseen) - 1))[q]
    place = np.argsort(order[q], axis=1)  # rank of each partition for the query
    needed = np.take_along_axis(place, home[truth], axis=1)
    for probe in range(1, parts + 1):
        router.probe, router.recall = probe, float((needed < probe).mean())
        if router.recall >= target:
            break
    return router


def _unit(col: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """Vectors scaled by powers of two (exactly) so that their largest component is below 1 and at least 1/2."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) if len(x) else x


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v an array of doubles, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def routers_of(rows: DataFrame, d: int, parts: int, top: int, sample_size: int, target: float) -> dict[int, Router]:
    """The classifiers by the number of the partition that they cut: 1 is all rows, the parts of k are k * parts and up."""
    routers: dict[int, Router] = {}

    def fit(t: pa.Table) -> pa.Table:
        x = _unit(t.column("v"), d)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return pa.table({"path": [t.column("path")[0].as_py()], "router": [pickle.dumps(train(x, parts, top, target))]})

    homes, open_ = rows.withColumn("path", F.lit(1).cast("long")), {1: rows.count()}
    while open_:
        # hashes below a share of their range: about 5/4 of the sample, so that no partition sends more to the task that sorts them
        low = {p: min(2**63 - 1, -(2**63) + (5 * sample_size * 2**62) // n) for p, n in open_.items() if n}
        if not low:
            break
        below = F.create_map(*[F.lit(x).cast("long") for kv in low.items() for x in kv])
        nth = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("vec_id"), "vec_id"))
        some = homes.where(F.col("path").isin(list(low)) & (F.xxhash64("vec_id") <= below[F.col("path")])).withColumn("nth", nth).where(f"nth <= {sample_size}").select("path", "v")
        new = {r.path: pickle.loads(r.router) for r in some.groupBy("path").applyInArrow(fit, "path long, router binary").collect()}  # one row a partition that is cut
        routers |= new
        one = max(len(pickle.dumps(r)) for r in new.values())
        shared = rows.sparkSession.sparkContext.broadcast(routers)

        def home(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(_homes(_unit(b.column("v"), d), shared.value, parts))], names=["vec_id", "v", "path"])

        homes = rows.mapInArrow(home, "vec_id long, v array<double>, path long")
        if one * len(routers) * parts > ROUTERS_BYTES:
            break
        sizes = {r.path: r.n for r in homes.groupBy("path").agg(F.count("*").alias("n")).where(f"n > {LEAF}").collect()}  # at most one row a partition
        open_ = {p: n for p, n in sizes.items() if p not in routers and routers[p // parts].w1.any()}
    return routers


def _homes(x: np.ndarray, routers: dict[int, Router], parts: int) -> np.ndarray:
    path, unit = np.ones(len(x), np.int64), x / np.linalg.norm(x, axis=1, keepdims=True)
    while True:
        moved = False
        for p in np.unique(path).tolist():
            if p in routers:
                rows = np.flatnonzero(path == p)
                path[rows], moved = p * parts + np.argmax(routers[p].scores(unit[rows]), axis=1), True
        if not moved:
            return path


def _probes(x: np.ndarray, routers: dict[int, Router], parts: int) -> list[list[int]]:
    """Of each row the partitions to look in: at every level as many as the classifier needs for its recall."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    row, path = np.arange(len(x)), np.ones(len(x), np.int64)
    while True:
        inner = np.isin(path, list(routers))
        if not inner.any():
            break
        rows, paths = [row[~inner]], [path[~inner]]
        for p in np.unique(path[inner]).tolist():
            mine, r = row[path == p], routers[p]
            order = np.argsort(-r.scores(unit[mine]), axis=1, kind="stable")[:, : r.probe]
            rows.append(np.repeat(mine, order.shape[1]))
            paths.append(p * parts + order.ravel())
        row, path = np.concatenate(rows), np.concatenate(paths)
    order = np.argsort(row, kind="stable")
    return [x.tolist() for x in np.split(path[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])]


def search(vectors: DataFrame, queries, top: int = 5, parts: int = 16, sample_size: int = 8192, target: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score; ``queries`` is a condition on vec_id that picks the query rows."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    d = sizes["d"]
    rows = rows.where(F.size("v") == d)
    routers = spark.sparkContext.broadcast(routers_of(rows, d, parts, top, sample_size, target))

    def route(batches):
        for b in batches:
            if b.num_rows:
                x, asked = _unit(b.column("v"), d), b.column("asked").fill_null(False).to_numpy(zero_copy_only=False)
                probes: list[list[int]] = [[] for _ in range(len(x))]
                for i, p in zip(np.flatnonzero(asked), _probes(x[asked], routers.value, parts) if asked.any() else [], strict=True):
                    probes[i] = p
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("asked"), pa.array(_homes(x, routers.value, parts)), pa.array(probes, pa.list_(pa.int64()))], names=["vec_id", "v", "asked", "part", "probes"])

    at = shared_dir(spark)
    routed = stored(rows.withColumn("asked", queries).mapInArrow(route, "vec_id long, v array<double>, asked boolean, part long, probes array<long>"), f"{at}/routed")
    vectors_of = stored(routed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("vbs")), f"{at}/parts")  # one row a partition
    asking = stored(routed.where("asked").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "probes")).alias("m")).select("query_id", F.col("m.v").alias("q"), "m.probes"), f"{at}/asking")
    asked = asking.select("query_id", "q", F.explode("probes").alias("part"))
    found = stored(_met(routed, asked, vectors_of, d, top), f"{at}/found")
    few = found.groupBy("query_id").agg(F.count("*").alias("n")).where(f"n >= {top}").select("query_id")
    short = asking.select("query_id", "q").join(few, "query_id", "left_anti")
    parts_there = [r.part for r in vectors_of.select("part").collect()]  # their number is bounded by ROUTERS_BYTES
    everywhere = short.withColumn("part", F.explode(F.array(*map(F.lit, parts_there)).cast("array<long>")))  # the few queries that found too little look in all
    rest = _met(routed, everywhere, vectors_of, d, top)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = found.join(few, "query_id").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(w)).where(f"rank <= {top}").select("query_id", "rank", "vec_id", "score")


def _met(routed: DataFrame, asked: DataFrame, vectors_of: DataFrame, d: int, top: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every block of a partition that a query (query_id, q, part) looks in."""
    queries_of = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qbs"))
    sizes = vectors_of.join(queries_of, "part")
    left = routed.select("vec_id", "v", "part").join(sizes, "part").withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.col("vbs")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1))).select("vec_id", "v", "part", "vb", "qb")
    right = asked.join(sizes, "part").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qbs")).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vbs") - 1))).select("query_id", "q", "part", "vb", "qb")
    key = ["part", "vb", "qb"]

    def meet(vs: pa.Table, qs: pa.Table) -> pa.Table:
        ids, asked_ids = vs.column("vec_id").to_numpy(), qs.column("query_id").to_numpy()
        out = []
        if len(ids) and len(asked_ids):
            v, q = _unit(vs.column("v"), d), _unit(qs.column("q"), d)
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            vn, qn = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for a in range(0, len(q), 256):
                s = (q[a : a + 256] @ v.T) / (qn[a : a + 256, None] * vn)
                s[asked_ids[a : a + 256, None] == ids] = -np.inf
                best = s if len(first) == len(ids) else np.maximum.reduceat(s, first, axis=1)  # one score an id
                cut = -np.partition(-best, min(top, best.shape[1]) - 1, axis=1)[:, min(top, best.shape[1]) - 1]
                i, j = np.nonzero(s >= np.maximum(cut[:, None] - 1e-12, -2))  # last bits of s differ among equal vectors
                exact = (q[a + i] * v[j]).sum(axis=1) / (qn[a + i] * vn[j])
                if len(first) < len(ids):  # of several rows of one id the nearest
                    order = np.lexsort((-exact, ids[j], i))
                    i, j, exact = i[order], j[order], exact[order]
                    one = np.concatenate([[True], (i[1:] != i[:-1]) | (ids[j[1:]] != ids[j[:-1]])])[: len(i)]
                    i, j, exact = i[one], j[one], exact[one]
                order = np.lexsort((ids[j], -exact, i))  # ties at the cut: the smaller ids stay
                i, j, exact = i[order], j[order], exact[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < top
                out.append((asked_ids[a + i[keep]], ids[j[keep]], exact[keep]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # vectors of one id may lie in several blocks
