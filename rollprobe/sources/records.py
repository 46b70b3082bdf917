"""Row rules of structure files: alternate locations, models, residue runs, frame choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..segments import LOWEST


def altloc_filter(atoms: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    """Of rows with an alternate location the first of each key stays; rows without one all stay."""
    blank = F.trim("altloc") == ""
    w = Window.partitionBy(*keys, blank).orderBy(order)
    return atoms.withColumn("_nth", F.row_number().over(w)).where(blank | (F.col("_nth") == 1)).drop("_nth")


def altloc_letter_filter(atoms: DataFrame, residue: list[str], atom: list[str], order: str = "line") -> DataFrame:
    """The first letter seen in a residue holds for the whole residue."""
    has = atoms.where(F.trim("altloc") != "")
    first = has.groupBy(*residue).agg(F.min_by("altloc", order).alias("_letter"))
    kept = atoms.join(first, residue, "left").where((F.trim("altloc") == "") | (F.col("altloc") == F.col("_letter"))).drop("_letter")
    w = Window.partitionBy(*atom).orderBy(order)
    return kept.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


RANGE = 4096  # atom numbers whose runs are counted together


def residue_runs(atoms: DataFrame, keys: list[str], within: tuple[str, ...] = (), order: str = "atom", number: str | None = None) -> DataFrame:
    """residue_id counts up where the key differs from the row before (runs, not distinct values).

    Runs are counted inside ranges of ``order``, and from one range to the next on one row a range. ``number`` names a
    column that gets the row's place, from 0.
    """
    key, by = F.struct(*keys), [*within, "_range"]
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce((key != F.lag(key).over(w)).cast("int"), F.lit(1)))
    rows = atoms.withColumn("_range", F.floor(F.col(order) / RANGE)).repartition(*by)
    rows = rows.withColumns({"_new": new, "_nth": F.row_number().over(w)}).withColumn("_run", F.sum("_new").over(w))
    ends = rows.groupBy(*by).agg(F.min_by(key, order).alias("_first"), F.max_by(key, order).alias("_last"), F.sum("_new").alias("_inner"), F.count("*").alias("_n"), F.max(F.hash(*atoms.columns)).alias("_all")).where(f"_all >= {LOWEST}")
    on = Window.partitionBy(*within).orderBy("_range")
    ends = ends.withColumn("_start", F.coalesce((F.col("_first") != F.lag("_last").over(on)).cast("int"), F.lit(1)))
    earlier = on.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, (F.sum("_start").over(on) + F.coalesce(F.sum("_inner").over(earlier), F.lit(0)) - 1).alias("_base"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.join(ends, by).withColumn("residue_id", (F.col("_base") + F.col("_run")).cast("int"))
    if number is not None:
        rows = rows.withColumn(number, (F.col("_before") + F.col("_nth") - 1).cast("int"))
    return rows.drop("_range", "_new", "_run", "_base", "_nth", "_before")


def frame_numbers(spec: str, n: int | None) -> tuple[int, int | None, int]:
    """(start, stop, step) of ``:``, ``n``, ``-n``, ``a:b[:s]``; without a length only forward ranges are known."""
    spec = spec.strip()
    if spec in ("", ":"):
        return 0, n, 1
    if ":" not in spec:
        i = int(spec)
        if i < 0:
            if n is None:
                raise ValueError("a length is needed")
            i += n
        if i < 0 or n is not None and i >= n:
            raise ValueError(f"frame {spec} is out of range")
        return i, i + 1, 1
    parts = (spec.split(":") + [""])[:3]
    start, stop, step = (int(p) if p.strip() else None for p in parts)
    step = 1 if step is None else step
    if step <= 0:
        raise ValueError("the step must be positive")
    start = 0 if start is None else start + n if start < 0 and n is not None else start
    if start < 0 or n is not None and start >= n:
        raise ValueError(f"start of {spec} is out of range")
    if stop is not None and stop < 0:
        if n is None:
            raise ValueError("a length is needed")
        stop += n
    if n is not None:
        stop = n if stop is None else min(stop, n)
    return start, stop, step


def frame_slice(df: DataFrame, spec: str, n: int | None = None) -> DataFrame:
    start, stop, step = frame_numbers(spec, n)
    cond = (F.col("frame") >= start) & ((F.col("frame") - start) % step == 0)
    return df.where(cond if stop is None else cond & (F.col("frame") < stop))
