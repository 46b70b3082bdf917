"""Exact Jaccard metric-space join of documents on word shingles.

Jaccard distance ``d = 1 - J`` is a metric, so a *pivot* tells something about pairs it is not part of:
``|d(x,p) - d(y,p)| <= d(x,y)``. That only helps where distances to the pivot are below 1, and most pairs of documents
share no shingle at all. So the space is cut twice, by shingles first and by pivots inside:

1. Exact copies (equal shingle sets) are one *node*; groups of copies collapse before anything is joined.
2. Two sets with ``J >= t`` share one of their first ``n - ceil(t*n) + 1`` shingles in any fixed order (here:
   rare shingles first, by classes of their frequency in the corpus, then hash order). A region is the set of nodes
   that hold the same such shingle; a node in no shared region is provably further than ``1 - t`` from every other.
   Lines and passages that many documents share come late in the order, so they make no regions but among documents
   that consist of them.
3. Every region's smallest node is its first pivot; members within ``1 - t`` of it are linked through it. Regions whose
   nodes are all of one component are done.
4. A region of at most ``SMALL`` nodes compares its open pairs (those of different components). A larger one is cut
   into Voronoi cells: ``PIVOTS`` nodes picked by hash, every member measured exactly against all of them, each member
   in the cell of its nearest pivot and, as a copy, in every cell whose pivot is at most ``2 * (1 - t)`` further away
   (if x lies in p's cell and ``d(x,y) <= 1 - t``, then ``d(y,p) <= d(x,p) + (1-t) <= d(x,q) + (1-t) <= d(y,q) +
   2(1-t)`` for y's nearest pivot q: y is in p's cell or copied there). Cells are regions again, cut recursively.
5. Where cutting does not halve the pairs to look at (all members about equally far from all pivots, as in a group of
   near copies), the region is cut by set size, which is the distance to the empty set as pivot (linked sets differ by at
   most 1/t in size, so a node is replicated into its own and the next band), and each band is compared in blocks of
   ``BLOCK`` nodes, which go to different tasks: first each block with itself and the next, then what lies outside
   the largest component so found with all.
6. Links are joined into components by distributed label propagation with pointer jumping.
7. The join counts every link of a node: the sets of a component meet, block against block, in 0/1 matrix products.

Pair tests are exact: a 256-bin count sketch gives a lower bound of the symmetric difference that rejects most
pairs, and the rest compare their whole shingle sets. Shingles are held as 64-bit hashes, as are nodes. Every step is a
table in the shared folder and is deleted when its last reader has run.

Nulls: a null text counts as empty; empty texts have no shingles and link with nothing. Rows with a null ``doc_id``
are returned with a null component. Repeated rows and equal texts share a component. Every row stands for itself: one id
with two texts has two nodes, each with the smallest id that *its* text reaches, and links nothing by its id. Texts of any
length are shingled whole. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, drop, empty_caches, give_back, map_arrow, mix, parallelism, shared_dir, shingles, slices, stored
from .graph import Tables, components, lookup

BLOCK = 512  # nodes of a block of a larger region
BLOCKS = 8  # blocks of a side that one task holds where every block of a group meets every other: a node's copies there are its group's nodes / (BLOCK * BLOCKS)
SMALL = 64  # nodes of a region that are compared directly (those of different components)
PIVOTS = 8  # of a region that is cut into cells
LIGHT = 100_000  # rows of a table that is one partition in the search for components
BLOCK_SHINGLES = 1 << 20  # shingles of the sets that one task holds at once, about
FILTER_WORDS = 1 << 19  # 64-bit words of the filter that finds documents by id in a scan (4 MB)
BINS = 256
COLUMNS = 4096  # shingles of a 0/1 matrix
SLOTS = 1 << 22  # of the table of frequency classes, one byte each
PART_BYTES = 32 << 20  # of text behind one part of the shingle counts
HELD = SLOTS // 4  # most slots in use; beyond it, only higher classes are told apart
CLASS = 5  # least class told apart: shingles that occur 2**CLASS times


def _prefix(n: int, num: int, den: int) -> int:
    return n + (-num * n // den) + 1  # n - ceil(n * num / den) + 1


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    sh, first = shingles(Words(batch.column("text")), k)
    for r in range(batch.num_rows):
        yield r, np.unique(sh[first[r] : first[r + 1]])


def _node(u: np.ndarray) -> int:
    return int((mix(u, 11).sum(dtype=U64) ^ np.bitwise_xor.reduce(mix(u, 12))).view(np.int64)) if len(u) else 0


def frequencies(docs: DataFrame, k: int = 5) -> np.ndarray:
    """Frequency classes (base-2 logarithms, 0 for all below the least class held) by the hashed slot of a shingle.

    Every shingle of every text is counted. Tasks send sorted runs of 32-bit hashes with their local counts, dealt by
    hash, and a part adds up its own. Two shingles that share a slot get the higher class: the table only makes an
    order, and any order gives exact results. Its size is fixed; where more than ``HELD`` slots would be in use, the
    lowest classes are left out.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(1, parallelism(docs.sparkSession), -(-size // PART_BYTES))  # a part stays the same size at any size of the corpus

    def local(batch: pa.RecordBatch) -> Iterator[dict]:
        h = mix(shingles(Words(batch.column("text")), k)[0], 21)
        values, counts = np.unique((h >> U64(32)) % U64(parts) << U64(32) | h & U64(0xFFFFFFFF), return_counts=True)
        if not len(values):
            return
        part, at = np.unique(values >> U64(32), return_index=True)
        ends = [*at[1:].tolist(), len(values)]
        low, many = values.astype("<u4"), counts.astype("<u4")
        yield {"part": part.astype(np.int32), "low": [low[a:b].tobytes() for a, b in zip(at, ends, strict=True)], "many": [many[a:b].tobytes() for a, b in zip(at, ends, strict=True)]}

    def add_up(t: pa.Table) -> pa.Table:
        low, many = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u4") for c in ("low", "many"))
        order = np.argsort(low)
        low = low[order]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        kind = np.log2(np.add.reduceat(many[order].astype(np.int64), first)).astype(np.int32)
        often = kind >= CLASS
        return pa.table({"slot": (low[first][often] % SLOTS).astype(np.int32), "kind": kind[often]})

    spark = docs.sparkSession
    runs = map_arrow(docs.select(F.col("text").cast("string").alias("text")), local, "part int, low binary, many binary")
    at = f"{shared_dir(spark)}/kinds"
    held = stored(runs.groupBy("part").applyInArrow(add_up, "slot int, kind int").groupBy("slot").agg(F.max("kind").alias("kind")), at)
    total, least = 0, 64
    for kind, n in sorted(((r.kind, r.n) for r in held.groupBy("kind").agg(F.count("*").alias("n")).collect()), reverse=True):  # one row a class
        total += n
        if total > HELD:
            break
        least = kind
    table = np.zeros(SLOTS, np.uint8)
    got = held.where(F.col("kind") >= least).toPandas()  # at most HELD rows
    table[got["slot"].to_numpy(np.int64)] = got["kind"].to_numpy(np.uint8)
    drop(spark, at)
    return table


def describe(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, sent: list | None = None) -> DataFrame:
    """One row per document: hash of the text, set size, node (hash of the set), first shingles of the order, count sketch.

    Of the copies that one task meets only the first carries the shingles and the sketch, so that a large group of
    copies sends a row for each task and not for each copy into its regions.
    """
    kinds = docs.sparkSession.sparkContext.broadcast(frequencies(docs, k))
    if sent is not None:
        sent.append(kinds)

    def first(u: np.ndarray) -> np.ndarray:
        """Rare shingles first; ties in hash order."""
        kind = kinds.value[(mix(u, 21) & U64(SLOTS - 1)).astype(np.int64)]
        return u[np.argsort(kind, kind="stable")[: _prefix(len(u), num, den)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches()
        seen: set[int] = set()  # nodes of this task
        for batch in batches:
            for part in slices(batch, 1 << 20):
                n, node, prefix, sketch = [], [], [], []
                for (_, u), doc in zip(_sets(part, k), part.column("doc_id").to_pylist(), strict=True):
                    n.append(len(u))
                    node.append(_node(u))
                    if not len(u) or doc is None or node[-1] in seen:
                        prefix.append(None)
                        sketch.append(None)
                        continue
                    seen.add(node[-1])
                    prefix.append(first(u).view(np.int64))
                    sketch.append(np.minimum(np.bincount((u & U64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "mark", "n", "node", "prefix", "sketch"])
        give_back()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(run, "doc_id long, mark long, n int, node long, prefix array<long>, sketch binary")


def _close(na: np.ndarray, nb: np.ndarray, diff: np.ndarray, num: int, den: int) -> np.ndarray:
    """J >= num/den, by sizes and symmetric difference: den * (na+nb-diff) >= num * (na+nb+diff)."""
    return (den - num) * (na + nb) >= (den + num) * diff


def _links(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets of two lists have J >= num/den: overlaps as products of 0/1 matrices, ``COLUMNS`` shingles at a time."""
    na, nb = (np.array([len(u) for u in side], np.int64) for side in (left, right))
    if len(na) * len(nb) <= 16:
        both = np.array([[len(np.intersect1d(u, v, assume_unique=True)) for v in right] for u in left], np.int64).reshape(len(na), len(nb))
        return den * both >= num * (na[:, None] + nb[None] - both)
    a, b = (np.concatenate(side) for side in (left, right))
    shared = np.intersect1d(a, b)
    place = [(np.repeat(np.arange(len(n)), n), np.searchsorted(shared, u), u) for n, u in ((na, a), (nb, b))]
    place = [(row[ok], col[ok]) for row, col, u in place for ok in [shared[np.minimum(col, len(shared) - 1)] == u if len(shared) else np.zeros(len(u), bool)]]
    both = np.zeros((len(na), len(nb)), np.int64)
    for low in range(0, len(shared), COLUMNS):
        m = []
        for (row, col), n in zip(place, (na, nb), strict=True):
            here = (col >= low) & (col < low + COLUMNS)
            x = np.zeros((len(n), min(COLUMNS, len(shared) - low)), np.float32)
            x[row[here], col[here] - low] = 1
            m.append(x)
        both += (m[0] @ m[1].T).astype(np.int64)  # whole numbers below 2**24
    return den * both >= num * (na[:, None] + nb[None] - both)


class _Join(Tables):
    def __init__(self, docs: DataFrame, k: int, num: int, den: int) -> None:
        super().__init__(docs.sparkSession)
        self.docs, self.k, self.num, self.den = docs, k, num, den
        self.sent: list = []  # broadcasts that the next stored step still needs
        self.whole = self.stored_from(describe(docs, k, num, den, self.sent))
        self.all = self.keep(self.whole.select("doc_id", "mark", "n", "node"))
        rep = self.whole.where("sketch is not null")
        self.nodes = self.keep(rep.groupBy("node").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("m")).select("node", "m.doc_id", "m.n", "m.sketch"))
        self.links: list[DataFrame] = []
        self.tested: list[DataFrame] = []
        self.spent: list[DataFrame] = []  # kept tables behind the pairs that settle() looks at next
        self.comps = self.nodes.where("false").select("node", F.col("node").alias("comp"))

    def stored_from(self, df: DataFrame) -> DataFrame:
        """Keep a step, and let workers drop the broadcasts that it was made with."""
        out = self.keep(df)
        for b in self.sent:
            b.unpersist()
        self.sent = []
        return out

    # ------------------------------------------------------------ regions
    def near(self, a: str, b: str) -> str:
        """Sizes allow J >= t."""
        return f"{self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b})"

    def first_common(self, n: tuple[str, str], pos: tuple[str, str]) -> str:
        """Whether the overlap can suffice if the region's shingle is the first that the two share."""
        return f"{self.num + self.den} * least({n[0]} - {pos[0]}, {n[1]} - {pos[1]}) >= {self.num} * ({n[0]} + {n[1]})"

    def first_in(self, least: str) -> str:
        """Whether the region's shingle can be the first that a row shares with a linked set, if its sets have ``least`` shingles or more."""
        n = "cast(n as long)"
        return f"{self.den * (self.num + self.den)} * ({n} - pos) >= {self.num} * ({self.den} * {n} + greatest({self.den} * cast({least} as long), {self.num} * {n}))"

    def regions(self, rows: DataFrame) -> DataFrame:
        """Rows (key, pos, node, n) of the regions with more than one node, with their pivot.

        A linked pair is looked for in the region of the first shingle that the two share, so a row stays only where its
        shingle can be that: among sets of one size, in about half of the prefix.

        Rows are dealt by key once; the region figures and the join back to the rows both read that one exchange (the
        figures use every column and ``n`` is asked for first, so that pruning and the join's condition do not make two different
        exchanges of it).
        """
        rows = rows.where("n is not null").repartition("key")
        keys = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("n").alias("least_n"), F.min("pos").alias("least_pos")).where("lo <> hi and least_n > 0 and least_pos >= 0").select("key", "least_n")
        rows = self.keep(rows.join(keys, "key").where(self.first_in("least_n")).drop("least_n").dropDuplicates(["key", "node"]))
        pivots = rows.groupBy("key").agg(F.min(F.struct("node", "n", "pos")).alias("p"), F.max("node").alias("hi")).where("p.node <> hi")
        out = self.keep(rows.join(pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.pos").alias("pivot_pos")), "key"))
        self.release(rows)
        return out

    def first(self) -> DataFrame:
        out = self.regions(self.whole.where("prefix is not null").select(F.posexplode("prefix").alias("pos", "key"), "node", "n"))
        self.release(self.whole)
        return out

    def banded(self, rows: DataFrame) -> DataFrame:
        """Cut regions by set size: sets that can be linked lie in one band or in neighbouring bands."""
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(self.den / self.num) + 1e-9)).cast("int")
        return rows.withColumn("band", F.explode(F.array(band, band + 1))).select(F.xxhash64("key", "band").alias("key"), "node", "n")

    def sweep(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that look closest by their sketches, in linear work and output.

        Every node goes to its largest region only and meets its own block and the next, and the two partners nearest
        by sketch in each are put out. Links among them make one component of most groups of near copies before
        their other regions are looked at.
        """
        rows = rows.drop("size")
        counts = rows.groupBy("key").agg(F.count("*").alias("size"))
        best = rows.join(counts, "key").groupBy("node").agg(F.max(F.struct("size", "key")).alias("best")).select("node", F.col("best.key").alias("key"))
        rows = rows.join(best, ["key", "node"])
        rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("size")), "key").withColumn("many", F.ceil(F.col("size") / BLOCK).cast("int"))
        rows = self.keep(rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("many")).cast("int")))
        self.spent.append(rows)
        x = rows.select("key", F.explode(F.array_distinct(F.array("own", F.expr("(own + 1) % many")))).alias("i"), "node", "n", "comp")
        y = rows.select("key", F.col("own").alias("i"), "node", "n", "comp")
        return self.facing(x, y, ["key", "i"], 2)

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that the sketches do not rule out.

        Nodes outside a region's largest component are held against all its nodes, block against block.
        """
        rows = rows.drop("size")
        counts = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("main"))
        rows = rows.join(counts.select("key", "size", F.col("main.comp").alias("main"), (F.col("size") - F.col("main.c")).alias("rest")), "key")
        lots = lambda size: F.ceil(F.col(size) / (BLOCK * BLOCKS)).cast("int")
        deal = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
        rows = self.keep(rows.withColumn("many_x", lots("rest")).withColumn("many_y", lots("size")))
        self.spent.append(rows)
        x = rows.where("comp <> main").select("key", deal("many_x").alias("i"), F.explode(F.sequence(F.lit(0), F.col("many_y") - 1)).alias("j"), "node", "n", "comp")
        y = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("many_x") - 1)).alias("i"), deal("many_y").alias("j"), "node", "n", "comp")
        return self.facing(x, y, ["key", "i", "j"], None)

    def facing(self, x: DataFrame, y: DataFrame, key: list[str], nearest: int | None) -> DataFrame:
        """Pairs (a, b) across components that sketches leave open, of rows of x and y that share a key.

        ``nearest`` keeps that many of each x, those with the smallest share of differing bins (ties: smaller node).
        """
        sketches = self.nodes.select("node", "sketch")
        x, y = x.join(sketches, "node"), y.join(sketches, "node")
        y = y.toDF(*(f"{c}_y" for c in y.columns))
        num, den = self.num, self.den

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if left.num_rows and right.num_rows:
                (na, ca, ua), (nb, cb, ub) = ([t.column(c + end).to_numpy() for c in ("n", "comp", "node")] for t, end in ((left, ""), (right, "_y")))
                sa, sb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for t, c in ((left, "sketch"), (right, "sketch_y")))
                na, nb = na.astype(np.int64), nb.astype(np.int64)
                for r in range(len(na)):
                    c = np.flatnonzero((den * np.minimum(na[r], nb) >= num * np.maximum(na[r], nb)) & (ca[r] != cb))
                    diff = np.abs(sb[c] - sa[r]).sum(axis=1, dtype=np.int64)
                    ok = _close(na[r], nb[c], diff, num, den)
                    c, diff = c[ok], diff[ok]
                    if nearest is not None:
                        c = c[np.lexsort((ub[c], diff / (na[r] + nb[c])))[:nearest]]
                    low.append(np.minimum(ua[r], ub[c]))
                    high.append(np.maximum(ua[r], ub[c]))
            return pa.table({"a": np.concatenate(low), "b": np.concatenate(high)})

        return x.groupBy(*key).cogroup(y.groupBy(*(f"{c}_y" for c in key))).applyInArrow(compare, "a long, b long").distinct()

    def mixed(self, rows: DataFrame) -> DataFrame:
        """Rows (key, node, n, comp, size) of the regions that hold several components; of regions with the same nodes one stays."""
        rows = rows.select("key", "node", "n").join(self.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        h = F.xxhash64("node")
        keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y")).where("lo <> hi")
        return self.keep(rows.join(keys.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size"), "key"))

    # ------------------------------------------------------------ exact tests
    def sets(self, ids: DataFrame) -> tuple[DataFrame, int]:
        """(node, set): the whole shingle sets of the nodes in ``ids`` (node, doc_id), and about how many they are (0: none).

        Texts are scanned once; a filter of fixed size (one bit for each hash of an id) lets few others than the
        wanted documents through, and a semi-join by node takes those out, other texts of the same id among them.
        """
        k, bits = self.k, FILTER_WORDS * 64
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        got = ids.select(F.floor(slot / 64).cast("int").alias("w"), (slot % 64).cast("int").alias("s")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, s))").alias("m"))
        got = got.toPandas()  # FILTER_WORDS rows at most
        filter_ = np.zeros(FILTER_WORDS, np.int64)
        filter_[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64)
        wanted = self.spark.sparkContext.broadcast(filter_.view(U64))
        self.sent.append(wanted)
        docs = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").withColumn("slot", slot)

        def whole(batch: pa.RecordBatch) -> Iterator[dict]:
            at = batch.column("slot").to_numpy()
            have = (wanted.value[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1
            parts = pa.Table.from_batches([batch]).filter(pa.array(have)).combine_chunks().to_batches()
            if parts and parts[0].num_rows:
                sets = [u for _, u in _sets(parts[0], k)]
                yield {"node": [_node(u) for u in sets], "set": [u.tobytes() for u in sets]}

        return map_arrow(docs, whole, "node long, set binary").join(ids.select("node"), "node", "left_semi").dropDuplicates(["node"]), int(np.bitwise_count(filter_.view(U64)).sum())

    def measure(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among the pairs (a, b)."""
        num, den = self.num, self.den
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("doc_id").alias(f"{x}_doc"), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sk"))

        def bound(batch: pa.RecordBatch) -> Iterator[dict]:
            s = [np.frombuffer(b"".join(batch.column(f"{x}_sk").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for x in "ab"]
            na, nb = (batch.column(f"{x}_n").to_numpy().astype(np.int64) for x in "ab")
            diff = np.maximum(np.abs(s[0] - s[1]).sum(axis=1, dtype=np.int64), np.abs(na - nb))
            rows = pa.array(np.flatnonzero(_close(na, nb, diff, num, den)))
            yield {c: batch.column(c).take(rows) for c in ("a", "b", "a_doc", "b_doc")}

        rest = self.keep(map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), bound, "a long, b long, a_doc long, b_doc long"))
        ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(f"{x}_doc").alias("doc_id")) for x in "ab"))
        sets, n_ids = self.sets(rest.select(F.explode(ends).alias("x")).select("x.*"))
        if not n_ids:
            return rest.select("a", "b")
        sets = self.stored_from(sets)

        def exact(batch: pa.RecordBatch) -> Iterator[dict]:
            link = []
            for x, y in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True):
                u, v = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                link.append(den * both >= num * (len(u) + len(v) - both))
            rows = pa.array(np.flatnonzero(link))
            yield {"a": batch.column("a").take(rows), "b": batch.column("b").take(rows)}

        at = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"))
        if rest.count() > 2 * n_ids:  # many pairs a set: ship each set once a block instead of once a pair
            sure = self.keep(self.dense(rest.select("a", "b"), sets))
        else:
            sure = self.keep(map_arrow(rest.select("a", "b").join(at("a"), "a").join(at("b"), "b").select("a", "b", "a_set", "b_set"), exact, "a long, b long"))
        self.release(rest, sets, *self.spent)
        self.spent = []
        return sure

    def dense(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The links among pairs, by connected groups of pairs, block against block of their nodes.

        Small groups share a task; a group of more than ``BLOCK * BLOCKS`` nodes or ``BLOCK_SHINGLES`` shingles is dealt to several.
        """
        num, den = self.num, self.den
        group = components(self, pairs, LIGHT).join(self.nodes.select("node", "n"), "node")
        size = group.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / (BLOCK * BLOCKS)), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("many"))
        lots = max(parallelism(self.spark), 2 * (group.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES)
        small = F.col("many") <= 1
        own = F.pmod(F.xxhash64("node"), F.col("many")).cast("int")
        place = self.keep(group.join(size, "comp").select("node", small.alias("small"), F.when(small, F.pmod(F.xxhash64("comp"), F.lit(lots))).otherwise(F.col("comp")).alias("g"), own.alias("own"), "many"))
        whole = sets.join(place, "node").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        whole = whole.select("small", "g", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "node", "set")
        left, right = (place.select(F.col("node").alias(x), *([F.col("small").alias("small_p"), F.col("g").alias("g_p")] if x == "a" else []), F.col("own").alias(f"own_{x}")) for x in "ab")
        asked = pairs.select("a", "b").join(left, "a").join(right, "b").select("small_p", "g_p", F.least("own_a", "own_b").alias("i_p"), F.greatest("own_a", "own_b").alias("j_p"), "a", "b")

        def exact(p: pa.Table, t: pa.Table) -> pa.Table:
            if not p.num_rows:
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            have = {n: np.frombuffer(x, U64) for n, x in zip(t.column("node").to_pylist(), t.column("set").to_pylist(), strict=True)}
            a, b, link = p.column("a").to_pylist(), p.column("b").to_pylist(), []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                both = len(np.intersect1d(have[x], have[y], assume_unique=True))
                if den * both >= num * (len(have[x]) + len(have[y]) - both):
                    link.append(i)
            return pa.table({"a": pa.array([a[i] for i in link], pa.int64()), "b": pa.array([b[i] for i in link], pa.int64())})

        self.spent += [place]
        return asked.groupBy("small_p", "g_p", "i_p", "j_p").cogroup(whole.groupBy("small", "g", "i", "j")).applyInArrow(exact, "a long, b long")

    def settle(self, pairs: DataFrame, sweeps: tuple[int | None, ...] = (2, None)) -> None:
        """Find the components that the links among the pairs (a, b) make.

        Links are looked for in two sweeps (two partners a node, then all that is left), since most pairs of a group of
        near copies have become one component by the links of the first.
        """
        for most in sweeps:
            own = lambda x: self.comps.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp"))
            open_ = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").where("coalesce(a_comp, a) <> coalesce(b_comp, b)").select("a", "b")
            for done in self.tested:
                open_ = open_.join(done, ["a", "b"], "left_anti")
            if most is not None:
                open_ = open_.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b")))
            pairs = self.keep(open_)
            self.release(*self.spent)
            self.spent = []
            if pairs.isEmpty():
                return
            now = pairs.select("a", "b") if most is None else pairs.where(f"nth <= {most}").select("a", "b")
            self.found(self.measure(now))
            self.tested.append(now)
            pairs = pairs.select("a", "b")

    def found(self, links: DataFrame) -> None:
        """Take links in: components that they connect become one."""
        if links.isEmpty():
            self.release(links)
            return
        self.links.append(links)
        own = lambda x: self.comps.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp"))
        ends = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select("a", "b", F.coalesce("a_comp", "a").alias("a_comp"), F.coalesce("b_comp", "b").alias("b_comp"))
        merged = components(self, ends.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).where("a <> b"), LIGHT)
        fresh = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.comps, "node", "left_anti").select("node", F.col("node").alias("comp"))
        new = self.comps.union(fresh).join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left")
        before, self.comps = self.comps, self.keep(new.select("node", F.coalesce("now", "comp").alias("comp")))
        self.release(before, merged)

    def join(self) -> tuple[DataFrame, list[DataFrame]]:
        """(node, comp) of the nodes that have links, and the links found (a spanning set of them)."""
        rows = self.first()
        near, common = self.near, self.first_common
        stars = rows.where("node <> pivot").where(near("n", "pivot_n")).where(common(("n", "pivot_n"), ("pos", "pivot_pos")))
        self.found(self.measure(stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()))
        mine = rows.join(self.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        sizes = mine.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").drop("lo", "hi")
        open_ = self.keep(mine.join(sizes, "key").select("key", "node", "n", "pos", "comp", "pivot", "size"))
        self.release(rows)
        small, flat = self.cells(self.keep(open_.where(f"size > {SMALL}").select("key", "node", "n")))
        x, y = (open_.where(f"size <= {SMALL} and node <> pivot").select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "pos", "comp"))) for s in "ab")
        pairs = x.join(y, "key").where("node_a < node_b and comp_a <> comp_b").where(near("n_a", "n_b")).where(common(("n_a", "n_b"), ("pos_a", "pos_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        for cell in small:
            x, y = (cell.where(f"size <= {SMALL}").select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "comp"))) for s in "ab")
            pairs = pairs.union(x.join(y, "key").where("node_a < node_b and comp_a <> comp_b").where(near("n_a", "n_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
        self.spent += [open_, *small]
        self.settle(pairs.distinct())
        if flat:
            rows = flat[0]
            for more in flat[1:]:
                rows = rows.union(more)
            banded = self.keep(self.banded(rows))
            self.release(*flat)
            now = self.mixed(banded)
            if not now.isEmpty():
                self.settle(self.sweep(now), (None,))
                again = self.mixed(banded)
                if not again.isEmpty():
                    self.settle(self.blocks(again))
        return self.comps, self.links

    def cells(self, rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        """Cut regions (key, node, n) into Voronoi cells, again and again.

        Returns tables that hold the small cells, and tables of the regions that cutting does not make easier: those whose cells hold
        more than half of their pairs.
        """
        small, flat, depth = [], [], 0
        while True:
            now = self.mixed(rows)
            self.release(rows)
            small.append(now)
            large = now.where(f"size > {SMALL}")
            if large.isEmpty():
                return small, flat
            told = self.keep(self.to_pivots(large, depth))
            self.release(*self.spent)
            self.spent = []
            self.found(self.keep(told.select("node", F.explode("links").alias("pivot")).select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()))
            counts = [F.count(F.when(F.col("cells").bitwiseAND(1 << k) != 0, 1)) for k in range(PIVOTS)]
            work = told.groupBy("key").agg(F.count("*").alias("size"), sum(c * c for c in counts).alias("work"))
            easier = self.keep(work.where("2 * work <= size * size").select("key"))
            flat.append(self.keep(told.join(easier, "key", "left_anti").select("key", "node", "n")))
            cell = F.filter(F.array(*(F.when(F.col("cells").bitwiseAND(1 << k) != 0, F.lit(k)) for k in range(PIVOTS))), lambda k: k.isNotNull())
            rows = self.keep(told.join(easier, "key").withColumn("cell", F.explode(cell)).select(F.xxhash64("key", "cell", F.lit(depth)).alias("key"), "node", "n"))
            self.release(told, easier)
            depth += 1

    def to_pivots(self, large: DataFrame, depth: int) -> DataFrame:
        """(key, node, n, cells, links): exact distances of every member to its region's pivots, one row a member.

        ``cells`` has a bit for each cell that the member is in or copied to, ``links`` the pivots of other components
        that it is linked with. Members are dealt into blocks of bounded size, and each block gets a copy of the pivots' sets.
        """
        num, den, h = self.num, self.den, F.xxhash64("node", F.lit(depth))
        reach = 2 * (1 - num / den) + 1e-9
        many = large.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("many"))
        picked = large.groupBy("key", F.pmod(h, F.lit(PIVOTS)).cast("int").alias("slot")).agg(F.min_by(F.struct("node", "comp"), h).alias("m")).select("key", "slot", "m.*")
        sets, _ = self.sets(large.select("node").distinct().join(self.nodes.select("node", "doc_id"), "node"))
        sets = self.stored_from(sets)
        self.spent.append(sets)
        x = large.join(many, "key").select("key", F.pmod(F.xxhash64("node"), F.col("many")).cast("int").alias("i"), "node", "n", "comp").join(sets, "node")
        p = picked.join(many, "key").select(F.col("key").alias("key_p"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("i_p"), "slot", F.col("node").alias("pivot"), F.col("comp").alias("comp_p")).join(sets.select(F.col("node").alias("pivot"), F.col("set").alias("pivot_set")), "pivot")

        def compare(rows: pa.Table, pivots: pa.Table) -> pa.Table:
            cells, links = [], []
            slots, comps = (pivots.column(c).to_pylist() for c in ("slot", "comp_p"))
            there = [(a, np.frombuffer(b, U64)) for a, b in zip(pivots.column("pivot").to_pylist(), pivots.column("pivot_set").to_pylist(), strict=True)]
            for comp, whole in zip(rows.column("comp").to_pylist(), rows.column("set").to_pylist(), strict=True):
                u = np.frombuffer(whole, U64)
                both = [len(np.intersect1d(u, v, assume_unique=True)) for _, v in there]
                union = [len(u) + len(v) - c for (_, v), c in zip(there, both, strict=True)]
                d = [1 - c / w for c, w in zip(both, union, strict=True)]
                cells.append(sum(1 << k for k, y in zip(slots, d, strict=True) if y <= min(d) + reach))
                links.append([a for (a, _), g, c, w in zip(there, comps, both, union, strict=True) if g != comp and den * c >= num * w])
            return pa.table([*(rows.column(c) for c in ("key", "node", "n")), pa.array(cells, pa.int32()), pa.array(links, pa.list_(pa.int64()))], names=["key", "node", "n", "cells", "links"])

        return x.groupBy("key", "i").cogroup(p.groupBy("key_p", "i_p")).applyInArrow(compare, "key long, node long, n int, cells int, links array<long>")

    def degrees(self) -> DataFrame:
        """(node, n_links): how many other nodes each is linked with, of all that have links.

        Links lie within components, so a component's sets meet in blocks, ``BLOCKS`` of them a side in one task, which
        adds up its links and puts out one row a node. Small components share a task. The pairs to count grow with the
        square of a component, and so do its copies of sets beyond ``BLOCK * BLOCKS`` nodes; a task's memory does not.
        """
        num, den = self.num, self.den
        lone = self.comps.groupBy("comp").agg(F.count("*").alias("c")).where("c > 1").select("comp")
        group = self.keep(self.comps.join(lone, "comp").join(self.nodes.select("node", "doc_id", "n"), "node"))
        sets, _ = self.sets(group.select("node", "doc_id"))
        sets = self.stored_from(sets)
        size = group.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / (BLOCK * BLOCKS)), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("many"))
        lots = max(parallelism(self.spark), 2 * (group.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES)
        small = F.col("many") <= 1
        place = group.join(size, "comp").select("node", "comp", small.alias("small"), F.when(small, F.pmod(F.xxhash64("comp"), F.lit(lots))).otherwise(F.col("comp")).alias("g"), F.pmod(F.xxhash64("node"), F.col("many")).cast("int").alias("own"), "many")
        rows = sets.join(place, "node").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        rows = rows.select("small", "g", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "comp", "own", "node", "set")

        def count(t: pa.Table) -> pa.Table:
            comp, own = t.column("comp").to_numpy(), t.column("own").to_numpy()
            sets, links = [np.frombuffer(x, U64) for x in t.column("set").to_pylist()], np.zeros(t.num_rows, np.int64)
            ends, order = (t.column("i")[0].as_py(), t.column("j")[0].as_py()), np.argsort(comp, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
                left, right = (at[own[at] == k] for k in ends)
                for a, b in ((left[x : x + BLOCK], right[y : y + BLOCK]) for x in range(0, len(left), BLOCK) for y in range(0, len(right), BLOCK)):
                    link = _links([sets[r] for r in a], [sets[r] for r in b], num, den)
                    links[a] += link.sum(axis=1)
                    if ends[0] != ends[1]:
                        links[b] += link.sum(axis=0)
                if ends[0] == ends[1]:
                    links[left] -= 1  # itself
            return pa.table({"node": t.column("node"), "links": links})

        out = rows.groupBy("small", "g", "i", "j").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("n_links"))
        return self.keep(out)


def _joined(docs: DataFrame, k: int, num: int, den: int, counted: bool) -> DataFrame:
    """doc_id, mark, n, comp, component_id, n_links (0 unless ``counted``) of every row; comp is the component of the row's node, by nodes."""
    j = _Join(docs, k, num, den)
    comps, _ = j.join()
    degree = j.degrees() if counted else j.nodes.where("false").select("node", F.lit(0).cast("long").alias("n_links"))
    of = j.nodes.select("node", F.col("doc_id").alias("low")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = of.groupBy("comp").agg(F.min("low").alias("component_id"))
    table = j.keep(of.join(least, "comp").join(degree, "node", "left").select("node", "comp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    out = j.all.join(table, "node", "left")
    has = F.col("n") > 0
    out = j.keep(out.select("doc_id", "mark", "n", "comp", F.when(has & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(has, F.col("n_links")).otherwise(0).cast("long").alias("n_links")))
    j.release_but(out)
    return out


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links with J >= num/den), n_links.

    ``n_links`` counts all other texts (sets; copies count once) that the row's is linked with.
    """
    return _joined(docs, k, num, den, True).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")


def deduplicate(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Rows of which one of each component stays: the one with the smallest id, then the smallest hash of its text.

    Rows without words and rows without an id are compared with nothing; of rows with the same id and text one stays.
    """
    found = _joined(docs, k, num, den, False).where("n > 0 and doc_id is not null").select("comp", "doc_id", "mark")
    best = found.groupBy("comp").agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    gone = lookup(found, best, "comp").where(F.struct("doc_id", "mark") != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    text = F.col("text").cast("string")
    marked = docs.withColumn("_hash", F.xxhash64(text))
    kept = marked.join(gone, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_hash") == F.col("_mark")), "left_anti")
    w = Window.partitionBy("doc_id", "_hash").orderBy(F.lit(1))  # rows of one id and text are repeats
    return kept.withColumn("_copy", F.row_number().over(w)).where("_copy = 1").select(*docs.columns)
