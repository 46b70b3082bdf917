"""Tables of the steps of a job, joins on keys that may be hot, rows numbered in order, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, parallelism, shared_dir, stored

SHARE = 1000  # a key that holds more than one row in so many is joined apart
LEAST = 10_000  # rows of a key that are never too many for one task


class Tables:
    """Steps kept as Parquet in one folder of the shared store, and deleted when nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.dir, self.step = spark, shared_dir(spark), 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.step += 1
        path = f"{self.dir}/{self.step}"
        out = stored(df, path)
        self.paths[id(out)] = out, path
        return out

    def release(self, *tables: DataFrame | None) -> None:
        """Delete kept tables; other frames are passed over."""
        for df in tables:
            if (found := self.paths.pop(id(df), None)) is not None:
                drop(self.spark, found[1])

    def release_but(self, *tables: DataFrame) -> None:
        held = {id(t) for t in tables}
        self.release(*(df for k, (df, _) in list(self.paths.items()) if k not in held))


def hot_keys(df: DataFrame, key: str, least: int = LEAST) -> list:
    """Keys with more than ``least`` rows and more than one row in ``SHARE``: at most ``SHARE`` of them."""
    n = df.count()
    if n <= least:
        return []
    return [r[0] for r in df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > least) & (F.col("n") * SHARE > n) & F.col(key).isNotNull()).collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = LEAST) -> DataFrame:
    """Join on ``key``, of which ``right`` holds few rows each and ``left`` any number.

    Rows of hot keys stay where they are and meet a broadcast of those keys' rows (at most ``SHARE`` keys); the others
    are shuffled.
    """
    hot = hot_keys(left, key, least)
    if not hot:
        return left.join(right, key, how)
    cold = left.where(~F.coalesce(F.col(key).isin(hot), F.lit(False))).join(right, key, how)
    return cold.unionByName(left.where(F.col(key).isin(hot)).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how))


def numbered(t: Tables, rows: DataFrame, group: str, order: list[Column], each: int) -> DataFrame:
    """Rows with ``nth`` (from 0), their place by ``order`` among those of one ``group`` (a long), and the range partition ``part`` they were sorted in.

    Rows are sorted over range partitions of about ``each`` rows, so a group of any size spreads; a task counts within its
    partition, and a group that goes on from earlier partitions (one for each partition at most) is moved by their counts.
    ``order`` must tell rows of a group apart, but for equal ones.
    """
    n = rows.count()
    parts = max(1, min(-(-n // each), max(parallelism(t.spark), -(-n // (32 * each)))))
    dealt = rows.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(group, *order)
    names, kinds = rows.columns, dict(rows.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(names.index(group)).to_numpy()
            fresh = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0 if fresh[0] else -done))
            nth = np.arange(len(g)) - start
            last, done = g[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(nth)], names=[*names, "part", "nth"])

    out = t.keep(dealt.mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", part int, nth long"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moved = out.groupBy(group, "part").agg(F.count("*").alias("n")).withColumn("before", before).where("before > 0").select(group, "part", "before")
    return out.join(F.broadcast(moved), [group, "part"], "left").withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0))).select(*names, "part", "nth")


def components(t: Tables, links: DataFrame, light: int = 0, least: int = LEAST) -> DataFrame:
    """(node, comp), a kept table of the ends of the links (a, b): comp is the smallest node reachable.

    A step looks at a node's neighbours twice and at its component's component once, so the number of steps grows with
    the logarithm of a component's width. Hubs and giant components are hot keys of the two joins. Tables of up to
    ``light`` rows are one partition each, which Spark groups and joins without an exchange.
    """
    edges = links.select("a", "b")
    edges = t.keep(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    small = light > 0 and edges.count() <= light
    one = lambda df: df.coalesce(1) if small else df
    join = (lambda left, right, key: left.join(right, key)) if small else lambda left, right, key: lookup(left, right, key, least=least)
    ends, label = one(edges).select(F.col("a").alias("near"), F.col("b").alias("node")), None
    while True:
        was = one(label).select("node", "comp") if label is not None else ends.groupBy(F.col("near").alias("node")).agg(F.min("node").alias("m")).select("node", F.least("node", "m").alias("comp"))
        around = join(ends, was, "node").groupBy("near").agg(F.min("comp").alias("m"))
        new = was.join(around, was.node == around.near).select("node", F.least("comp", "m").alias("next"), F.col("comp").alias("was"))
        if not small:
            new = t.keep(new)
        jump = new.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = t.keep(join(new, jump, "next").select("node", F.least("next", "far").alias("comp"), "was"))
        t.release(new, label)
        label = after
        if label.where("comp <> was").isEmpty():
            t.release(edges)
            return label
