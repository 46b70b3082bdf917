"""Running values over segments of an order, and tables that several uses of one plan share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWEST = -(1 << 31)  # of all hashes
SEGMENT = 1 << 16  # places of an order whose running values are taken together


def running(df: DataFrame, within: tuple[str, ...], order: str, values: dict[str, tuple[str, Column]], size: int | None = None) -> DataFrame:
    """Adds running aggregates (name: (sum, min or max; expression)) along ``order``, each row included.

    Rows meet by segments of ``order``, and segments by one row each, so a group of any size spreads over tasks: what a
    row needs to know of all before it is the state at its segment's start. Rows are dealt out once: the segments' values
    use every column, so that pruning does not make a second exchange of the same rows.
    """
    by = [*within, "_segment"]
    rows = df.withColumn("_segment", F.floor(F.col(order) / (size or SEGMENT))).repartition(*by)
    inner = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*within).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
    ends = rows.groupBy(*by).agg(*(agg[f](e).alias(f"_{n}_all") for n, (f, e) in values.items()), F.max(F.hash(*df.columns)).alias("_rows")).where(f"_rows >= {LOWEST}")
    ends = ends.select(*by, *(agg[f](f"_{n}_all").over(outer).alias(f"_{n}_before") for n, (f, _) in values.items()))
    rows = rows.withColumns({f"_{n}_here": agg[f](e).over(inner) for n, (f, e) in values.items()})
    rows = rows.join(ends, by).withColumns({n: both[f](F.col(f"_{n}_here"), F.col(f"_{n}_before")) for n, (f, _) in values.items()})
    return rows.drop("_segment", *(f"_{n}_{x}" for n in values for x in ("here", "before")))


def once(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys``, for several uses within one plan: they share the exchange, so what is before it runs once.

    Uses share it only if they read the same columns of it, so a condition that always holds reads all of them; it names the
    partition, so that it stays behind the exchange.
    """
    return df.repartition(*keys).where((F.hash(*df.columns) >= LOWEST) | (F.spark_partition_id() < 0))
