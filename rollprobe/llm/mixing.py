"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Rows of a source are put in a hash order and grouped into blocks of ``block`` rows. Block k of a source with weight
share w is released at slot floor(k / w) and due by slot ceil((k+1) / w); every slot takes the released block with the
earliest deadline. In every prefix, a source's blocks then differ from w times the slots by less than one.

Weights are whole units, so a schedule repeats after as many slots as there are units. One such period is laid out when
the plan is built (a table of ``units`` rows) and rows find their slot by arithmetic and one lookup. Sources end; what
remains is scheduled anew with the weights of the sources that are left, so that no row is dropped or repeated: the
target holds until the first source ends, and among those left until the next one does.

Ranks inside a source come from two levels: about sqrt(rows) buckets of the hash order, counts of buckets added up, and
row numbers inside a bucket; no source, however large, is ordered in one task. A source's last block may be short;
positions are moved up for the short blocks before them (one a source), so ``position`` runs from 0 without gaps.

Nulls: a null source is a source of its own. Rows with a null ``doc_id`` take part; repeated rows are kept. Rows are
ordered by the hash of ``doc_id`` and then by ``doc_id``; rows equal in both take any order among themselves. Weights
must be positive; sources that ``weights`` lacks get one unit.
"""

from __future__ import annotations

import bisect
import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pfair(units: list[int]) -> list[int]:
    """One period (sum of units slots): the source index that each slot goes to. Slots times the logarithm of the sources."""
    period, done, out = sum(units), [0] * len(units), []
    deadline = lambda i: (-((-(done[i] + 1) * period) // units[i]), Fraction(done[i], units[i]), i)  # noqa: E731  ties go to the source further behind its share
    ready, later = [deadline(i) for i in range(len(units))], []
    heapq.heapify(ready)
    for slot in range(period):
        while later and later[0][0] <= slot:
            heapq.heappush(ready, deadline(heapq.heappop(later)[1]))
        i = heapq.heappop(ready)[2]
        out.append(i)
        done[i] += 1
        if done[i] < units[i]:
            heapq.heappush(later, (done[i] * period // units[i], i))  # released
    return out


def phases(blocks: list[int], units: list[int]) -> list[tuple[list[int], list[int], list[int], int, int, list[list[int]]]]:
    """(active sources, their first blocks, their number of blocks, first slot, slots, each one's slots of the period): ends when any active source ends."""
    first, left, out, slot = [0] * len(blocks), list(blocks), [], 0
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        share = [units[i] for i in active]
        template, period = pfair(share), sum(share)
        own: list[list[int]] = [[] for _ in active]
        for s, k in enumerate(template):
            own[k].append(s)
        # the slot at which the first of them places its last block
        slots = 1 + min((left[i] - 1) // share[k] * period + own[k][(left[i] - 1) % share[k]] for k, i in enumerate(active))
        took = [slots // period * share[k] + bisect.bisect_left(own[k], slots % period) for k in range(len(active))]
        out.append((active, [first[i] for i in active], took, slot, slots, own))
        for i, n in zip(active, took, strict=True):
            first[i], left[i] = first[i] + n, left[i] - n
        slot += slots
    return out


def tempered(rows: dict[str | None, int], power: float = 0.5, units: int = 64) -> dict[str | None, int]:
    """Whole units in proportion to rows ** power: large sources are held back, small ones raised.

    There are at least four units a source, so that many small sources do not flatten a large one.
    """
    total, units = sum(n**power for n in rows.values()) or 1, max(units, 4 * len(rows))
    return {s: max(1, round(units * n**power / total)) for s, n in rows.items()}


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block: int = 8, source: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with mix_source, block, slot and position (0-based, gapless)."""
    spark = docs.sparkSession
    names = {c: f"_{c}" if c in docs.columns else c for c in ("mix_source", "mix_block", "slot", "position")}
    src, order = F.col(source).cast("string"), F.xxhash64(F.col("doc_id").cast("long"))
    counts = {r.s: r.n for r in docs.groupBy(src.alias("s")).agg(F.count("*").alias("n")).collect()}  # one row a source
    sources = sorted(counts, key=lambda s: (s is not None, s or ""))
    given = tempered(counts) if weights is None else weights
    units = [int(given.get(s, 1)) for s in sources]
    if any(u <= 0 for u in units):
        raise ValueError("weights must be positive")
    n_blocks = [-(-counts[s] // block) for s in sources]

    # ---- rank of each row in its source
    index = F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(sources) if s is not None for x in (F.lit(s), F.lit(i))]), src), F.lit(0)) if any(s is not None for s in sources) else F.lit(0)
    buckets = F.element_at(F.array(*[F.lit(max(1, int(counts[s] ** 0.5))) for s in sources] or [F.lit(1)]), F.col("_source") + 1)
    part: Column = F.floor((F.shiftrightunsigned(F.col("_order"), 32) * buckets) / F.lit(2**32)).cast("int")
    rows = docs.withColumn("_source", index.cast("int")).withColumn("_order", order).withColumn("_bucket", part)
    sizes = docs.select(index.cast("int").alias("_source"), order.alias("_order")).withColumn("_bucket", part).groupBy("_source", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id")
    ranked = rows.withColumn("_nth", F.row_number().over(inside)).join(base, ["_source", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_nth") - 1)

    # ---- slot of each block: phase, then arithmetic on the period
    plan, short = [], []
    for active, first, took, slot, _, slots_of in phases(n_blocks, units):
        share = [units[i] for i in active]
        for k, i in enumerate(active):
            own = slots_of[k]
            if took[k]:
                plan.append((i, first[k], first[k] + took[k], slot, sum(share), own))
            last = n_blocks[i] - 1
            if took[k] and first[k] <= last < first[k] + took[k] and counts[sources[i]] % block:
                n = last - first[k]
                short.append((slot + n // len(own) * sum(share) + own[n % len(own)], block - counts[sources[i]] % block))
    table = F.broadcast(spark.createDataFrame(plan, "_s int, _from long, _to long, _slot long, _period long, _own array<int>"))  # at most sources x (sources + 1) / 2 rows
    at = F.floor(F.col("_rank") / block).cast("long")
    n = F.col("_b") - F.col("_from")
    each = F.size("_own")
    slot = F.col("_slot") + F.floor(n / each) * F.col("_period") + F.element_at("_own", (n % each + 1).cast("int"))
    gaps = sum((F.when(F.col("_at") > F.lit(s), F.lit(k)).otherwise(F.lit(0)) for s, k in short), F.lit(0))
    placed = ranked.withColumn("_b", at).join(table, (F.col("_source") == F.col("_s")) & (F.col("_b") >= F.col("_from")) & (F.col("_b") < F.col("_to"))).withColumn("_at", slot.cast("long"))
    where = (F.col("_at") * block + F.col("_rank") % block - gaps).cast("long")
    return placed.select(*[F.col(c) for c in docs.columns], src.alias(names["mix_source"]), F.col("_b").alias(names["mix_block"]), F.col("_at").alias(names["slot"]), where.alias(names["position"]))
