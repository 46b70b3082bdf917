"""SimHash near-duplicates: deletion variants of two half fingerprints, joined by equality and verified.

A document's fingerprint has a bit set where more than half of the XXH64 values (UTF-8, seed 42) of its ``k``-word
shingles have it set, repeats counted; a text of fewer words is one shingle, one without words has fingerprint zero. Two
fingerprints link where they differ in at most two bits. They are cut into two halves of 32 bits, so that one half
differs in at most one bit:

1. Documents of one fingerprint are one node; a half's distinct values are counted.
2. Every distinct value of a half is indexed 32 times, each time with another bit left out. A key (half, position,
   remaining bits) holds at most two values; where it holds both, their documents' fingerprints are candidates of each
   other, as are those that share a value.
3. Candidates of small groups are paired and verified by counting the bits that differ. Where a value is shared by more
   than ``LIMIT`` fingerprints, the other half is indexed too, with two bits left out (same value) or one (neighbouring
   values): a key of both halves then holds at most four fingerprints, any two of which link, so no group's pairs are
   put out and none is cut.
4. Components of the links, by the smallest node reachable, give each document the smallest ``doc_id`` it reaches.

Nulls: a null text counts as empty. Rows with a null ``doc_id`` are returned with their fingerprint and a null component
and link nothing. Every row stands for itself: repeated rows share a fingerprint, and two texts of one id have two, each
with its own component (the smallest id that *this* text reaches). Texts without words all link. Texts of any length are
read whole, in pieces of bounded memory. An empty table gives no row, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, map_arrow, parallelism, text_bytes
from .graph import LEAST, Tables, components, lookup

LIMIT = 32  # fingerprints of a value whose pairs are compared directly
PIECE = 1 << 16  # shingles hashed at a time
HALF = 0xFFFFFFFF
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_ranges(col: pa.Array, k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with words lower-cased and one space apart, and of each shingle its row, start and end in them."""
    data, at = text_bytes(col)
    gap = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at[:-1]] = True  # a text begins
    before = np.ones(len(data), bool)
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & (before | first[:-1]))
    row = np.searchsorted(at, start, side="right") - 1
    words = np.bincount(row, minlength=len(col))
    of = np.concatenate([[0], np.cumsum(words)])  # a row's first word
    keep, low = ~gap, LOWER[data]
    inner = start[np.flatnonzero(np.diff(row, prepend=-1) == 0)] - 1  # the gap before a word that is not its row's first
    keep[inner], low[inner] = True, 32
    place = np.concatenate([[0], np.cumsum(keep)])
    begin = place[start]
    stop = np.concatenate([begin[1:] - (np.diff(row) == 0), place[-1:]]) if len(start) else begin
    count = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(col)), count)
    a = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + of[rows]
    return low[keep].tobytes(), rows, begin[a], stop[a + np.minimum(words[rows], k) - 1]


def fingerprint(col: pa.Array, k: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    text, rows, begin, stop = shingle_ranges(col, k)
    digest, on, n = xxhash.xxh64_intdigest, np.zeros((len(col), 64), np.int64), np.bincount(rows, minlength=len(col))
    for at in range(0, len(rows), PIECE):
        r = rows[at : at + PIECE]
        h = np.fromiter((digest(text[a:b], 42) for a, b in zip(begin[at : at + PIECE].tolist(), stop[at : at + PIECE].tolist(), strict=True)), np.uint64, len(r))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.diff(r, prepend=-1))
        on[r[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return np.packbits(2 * on > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a long."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id"), "fp": fingerprint(batch.column("text"), k).view(np.int64)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def _without(value: str, bit) -> F.Column:
    return F.col(value).bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, {bit})")))


def links(t: Tables, nodes: DataFrame, limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """(a, b): enough links between the fingerprints of ``nodes`` (fp) that differ in at most two bits to reach all that they reach."""
    half = lambda s: (F.shiftrightunsigned("fp", 32) if s else F.col("fp")).bitwiseAND(F.lit(HALF))
    sides = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), half(s).alias("value"), half(1 - s).alias("other")) for s in (0, 1)))).alias("x"))
    sides = t.keep(sides.select("fp", (F.col("x.side") * (1 << 32) + F.col("x.value")).alias("value"), F.col("x.other").alias("other")))  # bit 32 of value is the side
    values = t.keep(sides.groupBy("value").agg(F.count("*").alias("n")))

    # two values that differ in one bit meet where it is left out
    variants = values.repartition(parallelism(t.spark), "value").select("n", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")).withColumn("set", F.getbit("value", F.col("bit")).cast("long"))
    met = variants.groupBy("bit", _without("value", "bit").alias("rest")).agg(F.sum("set").alias("ones"), F.count("*").alias("c"), F.sum(F.col("n") * (1 - F.col("set"))).alias("n0"), F.sum(F.col("n") * F.col("set")).alias("n1"))
    edges = t.keep(met.where("c = 2").select(F.col("rest").alias("v0"), F.col("rest").bitwiseOR(F.expr("shiftleft(1L, bit)")).alias("v1"), "bit", "n0", "n1"))
    few, many = edges.where(f"n0 * n1 <= {limit * limit}"), edges.where(f"n0 * n1 > {limit * limit}")
    tagged = t.keep(lookup(sides, values, "value", least=least))
    verified = lambda pairs: pairs.where("bit_count(a ^ b) <= 2").select("a", "b")

    # small groups: pairs of fingerprints, verified
    small = tagged.where(f"n > 1 and n <= {limit}").select("value", "fp")
    same = verified(small.select("value", F.col("fp").alias("a")).join(small.select("value", F.col("fp").alias("b")), "value").where("a < b"))
    side = tagged.where(f"n <= {limit * limit}").select("value", "fp")
    near = few.join(side.select(F.col("value").alias("v0"), F.col("fp").alias("a")), "v0").join(side.select(F.col("value").alias("v1"), F.col("fp").alias("b")), "v1")
    out = [same, verified(near)]

    # large groups: the other half is indexed as well, keys of both hold at most four fingerprints
    hot = tagged.where(f"n > {limit}").select("value", "fp", "other")
    two = F.explode(F.array(*(F.lit((1 << i) | (1 << j)) for i in range(32) for j in range(i)))).alias("bits")  # 496 of them
    keyed = [hot.select(F.col("value").alias("key"), F.col("other"), "fp", two).select("key", "bits", F.col("other").bitwiseAND(F.bitwise_not("bits")).alias("rest"), "fp")]
    ends = many.select(F.explode(F.array("v0", "v1")).alias("value"), (F.col("v0") * 64 + F.col("bit") + (1 << 40)).alias("key"))
    wide = lookup(tagged.select("value", "fp", "other"), ends, "value", least=least) if not many.isEmpty() else None
    if wide is not None:
        bit = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bits")
        keyed.append(wide.select("key", bit, "fp", "other").select("key", "bits", _without("other", "bits").alias("rest"), "fp"))
    for rows in keyed:
        group = rows.groupBy("key", "bits", "rest").agg(F.count("*").alias("c"), F.collect_set("fp").alias("fps")).where("c > 1")  # at most four
        out.append(group.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    found = t.keep(found.distinct())
    t.release(sides, values, edges, tagged)
    return found


def simhash_join(docs: DataFrame, k: int = 3, limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text)."""
    t = Tables(docs.sparkSession)
    rows = t.keep(fingerprints(docs, k))
    nodes = t.keep(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = links(t, nodes.select("fp"), limit, least)
    comps = components(t, found, least=least)
    low = nodes.join(comps.select(F.col("node").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    smallest = low.groupBy("comp").agg(F.min("low").alias("component_id"))
    table = t.keep(lookup(t.keep(low.select("fp", "comp")), smallest, "comp", least=least).select("fp", "component_id"))
    named = lookup(rows, table, "fp", "left", least=least)
    out = t.keep(named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))
    t.release_but(out)
    return out
