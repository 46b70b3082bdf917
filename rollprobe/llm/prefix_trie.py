"""Trie of conversation prefixes: owners by binary search against prefix-digest minima, chains aggregated bottom-up.

Turns of a conversation are ordered by ``turn`` (null first; turns of equal number by the digest of what they say, an
order fixed by their content). :func:`rebuilt` gives every conversation c a head, the first ``h`` turns of conversation
``c - c % span``, in place of its own first ``h`` turns. A node is a distinct sequence of the first ``d`` turns (role and
text); the conversations that begin with it are its members, and its *owner* is the smallest of them.

1. Texts are read once, for their 128-bit digests and byte lengths; from there on rows are a few numbers each. A prefix's
   digest is the exclusive-or of digests of (position, turn), so it is a running sum that needs no conversation in one
   task: turns are numbered over range partitions, and running sums go by segments of ``SEGMENT`` turns.
2. The minima: for every prefix digest its smallest member, its number of members, and its last turn's bytes.
3. A conversation owns a node only if it owns all that follow along it, so the first depth it owns is found by binary
   search: in each round every open conversation asks the minima for the owner of the prefix in the middle, in one join.
   The last owner met that is not itself owns the turn before: that is where its chain hangs.
4. Owned chains form the tree. Totals of chains (leaves, saved tokens) go up by pointer doubling: a round adds what is
   2**k chains below, so their number grows with the logarithm of the tree's height. Within a chain nodes sum what
   hangs at or below them, by segments again.
5. The conversations that end at a node are sorted over range partitions and joined to strings in tasks; one hash runs
   over a node's strings in order.

Nulls: a null ``conv_id`` takes no part; null roles and texts are empty. Repeated rows are turns of their own. Texts and
conversations of any length are used whole. A table without conversations has no node; extra columns are ignored.
Digests take 128 bits for equality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import LEAST, Tables, lookup, numbered

EACH = 100_000  # rows of a range partition, about
SEGMENT = 4096  # turns of a segment of a conversation
IDS = 1024  # ids of one string
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, bytes): 128 bits of what a turn says, and its text's length in UTF-8."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), whole.alias("m"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id is not null")
    part = lambda at: F.conv(F.substring("m", at, 16), 16, -10).cast("long")
    return rows.select("conv_id", "turn", part(1).alias("h1"), part(17).alias("h2"), "bytes")


def rebuilt(t: Tables, turns: DataFrame, span: int = 5, most: int = 9, least: int = LEAST, each: int = EACH) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, h1, h2, bytes) with positions from 1, and (conv_id, len) of every conversation, turnless ones included."""
    placed = t.keep(numbered(t, turns, "conv_id", [F.asc_nulls_first("turn"), F.col("h1"), F.col("h2")], each).drop("part", "turn"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = placed.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % span)
    own = t.keep(own)
    sizes = own.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = own.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).select("conv_id", "h", "k", "base", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    convs = t.keep(convs)
    heads = placed.where(f"nth < {most - 1}").select(F.col("conv_id").alias("base"), "nth", "h1", "h2", "bytes").join(convs.select("conv_id", "base", "k"), "base").where("nth < k").select("conv_id", (F.col("nth") + 1).alias("pos"), "h1", "h2", "bytes")
    after = lookup(placed.where(F.col("nth") >= h), convs.select("conv_id", "k"), "conv_id", least=least)
    after = after.select("conv_id", (F.col("nth") - h + F.col("k") + 1).alias("pos"), "h1", "h2", "bytes")
    out = t.keep(heads.unionByName(after))
    t.release(placed, own)
    return out, convs.select("conv_id", "len")


def running(t: Tables, rows: DataFrame, group: str, order: str, sums: dict[str, str], down: bool = False) -> DataFrame:
    """Running aggregates (``sums``: column to SQL aggregate) along ``order`` within ``group``, or from its end, both inclusive.

    Rows of a group meet by segments of ``SEGMENT`` places, and segments by what each comes to.
    """
    rows = rows.withColumn("seg", F.floor(F.col(order) / SEGMENT))
    by = (lambda c: F.desc(c)) if down else F.col
    inner = Window.partitionBy(group, "seg").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(group).orderBy(by("seg")).rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(group, "seg").agg(*(F.expr(f"{f}({c})").alias(f"{c}_all") for c, f in sums.items()))
    for c, f in sums.items():
        total = total.withColumn(f"{c}_before", F.expr(f"{f}({c}_all)").over(outer))
    total = total.drop(*(f"{c}_all" for c in sums))
    for c, f in sums.items():
        rows = rows.withColumn(c, F.expr(f"{f}({c})").over(inner))
    rows = rows.join(total, [group, "seg"])
    for c, f in sums.items():
        before = F.coalesce(f"{c}_before", F.lit(0))
        rows = rows.withColumn(c, F.col(c).bitwiseXOR(before) if f == "bit_xor" else F.col(c) + before)
    return rows.drop("seg", *(f"{c}_before" for c in sums))


def prefixes(t: Tables, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, bytes) of every prefix of every conversation, the empty one included."""
    marked = turns.select("conv_id", F.col("pos").alias("depth"), F.xxhash64("pos", "h1", "h2").alias("x1"), F.xxhash64("h2", F.lit(11), "h1", "pos").alias("x2"), "bytes")
    root = convs.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "x1", "x2", "bytes")))
    return t.keep(running(t, marked, "conv_id", "depth", {"x1": "bit_xor", "x2": "bit_xor"}).unionByName(root))


def first_owned(t: Tables, convs: DataFrame, prefix: DataFrame, minima: DataFrame, least: int = LEAST) -> DataFrame:
    """(conv_id, len, first, up): the first depth that a conversation owns (len + 1: none), and the owner of the depth before."""
    prefix, minima = prefix.select("conv_id", "depth", "x1", "x2"), minima.select("depth", "x1", "x2", "owner")
    done, state = [], t.keep(convs.select("conv_id", "len", F.lit(0).cast("long").alias("lo"), (F.col("len") + 1).alias("hi"), F.lit(None).cast("long").alias("up")))
    while True:
        open_ = state.where("lo < hi")
        done.append(state.where("lo >= hi").select("conv_id", "len", F.col("lo").alias("first"), "up"))
        if open_.isEmpty():
            break
        asked = open_.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2)).join(prefix, ["conv_id", "depth"])
        key = F.xxhash64("x1", "x2")
        asked, there = asked.withColumn("key", key), minima.select(key.alias("key"), F.col("x1").alias("m1"), F.col("x2").alias("m2"), F.col("depth").alias("at"), "owner")
        asked = t.keep(asked)
        met = lookup(asked, there, "key", least=least).where("x1 = m1 and x2 = m2 and depth = at")
        mine = F.col("owner") == F.col("conv_id")
        state = t.keep(met.select("conv_id", "len", F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("up")).otherwise(F.col("owner")).alias("up")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return t.keep(out)


def doubled(t: Tables, chains: DataFrame, least: int = LEAST) -> DataFrame:
    """(conv_id, saved, leaves) of whole subtrees, of chains (conv_id, up, saved, leaves) whose ``up`` is the chain they hang on."""
    while True:
        more = chains.where("up is not null").groupBy("up").agg(F.sum("saved").alias("saved_more"), F.sum("leaves").alias("leaves_more"))
        grown = chains.join(more.withColumnRenamed("up", "conv_id"), "conv_id", "left")
        grown = grown.select("conv_id", "up", *((F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in ("saved", "leaves")))
        above = chains.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        if above.isEmpty():
            return grown.select("conv_id", "saved", "leaves")
        grown = t.keep(grown)
        hung = lookup(grown.where("up is not null"), above, "up", "left", least=least).select("conv_id", F.col("next").alias("up"), "saved", "leaves")
        chains = t.keep(hung.unionByName(grown.where("up is null").select("conv_id", "up", "saved", "leaves")))


def hashes(t: Tables, ends: DataFrame, each: int = EACH) -> DataFrame:
    """(owner, depth, ends_sha256) of nodes (owner, depth) at which conversations (conv_id) end."""
    parts = max(1, -(-ends.count() // each))
    at = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("low", pa.int64()), ("ids", pa.string())])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for b in batches:
            for owner, depth, c in zip(*(b.column(x).to_pylist() for x in ("owner", "depth", "conv_id")), strict=True):
                if held and (now != (owner, depth) or len(held) == IDS):
                    out.append((*now, held[0], ",".join(map(str, held))))
                    held = []
                now = owner, depth
                held.append(c)
            if len(out) >= IDS:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), at, strict=True)], schema=at)
                out = []
        if held:
            out.append((*now, held[0], ",".join(map(str, held))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), at, strict=True)], schema=at)

    dealt = ends.select("owner", "depth", "conv_id").repartitionByRange(parts, "owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    pieces = t.keep(dealt.mapInArrow(strings, "owner long, depth long, low long, ids string"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        close = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["owner", "depth", "ends_sha256"])
        for b in batches:
            for owner, depth, ids in zip(*(b.column(x).to_pylist() for x in ("owner", "depth", "ids")), strict=True):
                if now == (owner, depth):
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (owner, depth), hashlib.sha256(ids.encode())
            if len(out) >= IDS:
                yield close()
                out = []
        if now is not None:
            out.append((*now, sha.hexdigest()))
        if out:
            yield close()

    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "low").mapInArrow(digest, "owner long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, span: int = 5, most: int = 9, least: int = LEAST, each: int = EACH) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    t = Tables(conversations.sparkSession)
    turns = t.keep(turns_of(conversations))
    sequence, convs = rebuilt(t, turns, span, most, least, each)
    prefix = prefixes(t, sequence, convs)
    minima = t.keep(prefix.groupBy("depth", "x1", "x2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes")))
    t.release(turns, sequence)
    found = first_owned(t, convs, prefix, minima, least)
    t.release(prefix)

    chains = t.keep(found.where("first <= len"))
    ends = found.select("conv_id", F.when(F.col("first") <= F.col("len"), F.col("conv_id")).otherwise(F.col("up")).alias("owner"), F.col("len").alias("depth"))
    ended = t.keep(hashes(t, ends, each))

    # what each chain comes to by itself: saved tokens of its nodes, and one leaf unless a chain hangs on its last node
    hung = t.keep(chains.where("up is not null").groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hanging")))
    nodes = minima.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    saved = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("saved"))
    last = chains.join(hung.select(F.col("owner").alias("conv_id"), F.col("depth").alias("len"), "hanging"), ["conv_id", "len"], "left")
    own = last.join(saved, "conv_id").select("conv_id", "up", "saved", F.when(F.col("hanging").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    totals = t.keep(doubled(t, t.keep(own), least))

    # nodes: their own share, what hangs on them, whether their chain begins or ends there
    below = chains.where("up is not null").join(totals, "conv_id").groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hanging"), F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
    begin = chains.select(F.col("conv_id").alias("owner"), F.col("first").alias("depth"), "up", F.lit(True).alias("begins"))
    end = chains.select(F.col("conv_id").alias("owner"), F.col("len").alias("depth"), F.lit(True).alias("ends"))
    at = ["owner", "depth"]
    rows = nodes.join(below, at, "left").join(begin, at, "left").join(end, at, "left").join(ended, at, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = rows.select(
        "owner", "depth", "n_convs", F.when(F.col("begins"), F.col("up")).otherwise(F.col("owner")).alias("parent_conv_id"),
        (zero("hanging") + F.when(F.col("ends"), 0).otherwise(1)).cast("long").alias("n_children"),
        (zero("leaves_below") + F.when(F.col("ends") & F.col("hanging").isNull(), 1).otherwise(0)).cast("long").alias("n_leaves"),
        (F.col("saved") + zero("saved_below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    rows = running(t, t.keep(rows), "owner", "depth", {"n_leaves": "sum", "saved_tokens": "sum"}, down=True)
    out = t.keep(rows.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    t.release_but(out)
    return out
