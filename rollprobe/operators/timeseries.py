"""Series (feature, idx, frame, value): summaries, exposure kinetics, uncertainty, fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import segments
from ..segments import running

SUMMARY_STATISTIC_NAMES = ("mean", "variance", "std", "min", "max", "median", "q05", "q25", "q75", "q95", "iqr", "mad", "exposure_frequency", "transitions")
BY = ("feature", "idx")


def quantiles(series: DataFrame, probabilities: tuple[float, ...], by: tuple[str, ...] = BY, value: str = "value", parts: int | None = None) -> DataFrame:
    """by, q: the exact quantiles (an array in the order asked for), interpolated linearly; nulls do not count.

    Values are sorted over range partitions, so a series of any length spreads. The sizes of its stretches say in which of
    them the wanted ranks lie, and only those stretches are numbered.
    """
    by = list(by)
    parts = parts or int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = series.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    rows = rows.repartitionByRange(parts, *by, "_v").withColumn("_part", F.spark_partition_id())
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*by, "_part").agg(F.count("_v").alias("_n")).withColumn("_all", F.sum("_n").over(whole)).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    ranks = F.array(*(F.struct(F.lit(k).alias("k"), f(place(p)).cast("long").alias("rank"), place(p).alias("at")) for k, p in enumerate(probabilities) for f in (F.floor, F.ceil)))
    wanted = sizes.select(*by, "_part", "_before", F.filter(ranks, lambda x: (x["rank"] >= F.col("_before")) & (x["rank"] < F.col("_before") + F.col("_n"))).alias("_want")).where("size(_want) > 0")
    nth = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_v")) - 1
    found = rows.join(wanted, [*by, "_part"]).withColumn("_rank", nth + F.col("_before")).select(*by, "_v", F.explode(F.filter("_want", lambda x: x["rank"] == F.col("_rank"))).alias("x"))
    low, high = F.min("_v"), F.max("_v")  # of one probability at most two ranks are wanted
    one = found.groupBy(*by, F.col("x.k").alias("k"), F.col("x.at").alias("at")).agg(low.alias("low"), high.alias("high"))
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    return one.select(*by, F.struct("k", mixed.alias("v")).alias("x")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("q"))


def runs(states: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """by, transitions, frames, up, and of interior runs their number and frames by state (runs0, frames0, runs1, frames1).

    ``states`` has by, frame, state (0 or 1). A segment of frames comes to its first and last run and the sums of those
    between; segments are put together in order, where runs that meet with one state become one. No task holds more of a
    series than a segment of its frames or the segments' own rows.
    """
    by = list(by)
    w = Window.partitionBy(*by, "_seg").orderBy("frame")
    rows = states.withColumn("_seg", F.floor(F.col("frame") / segments.SEGMENT))
    rows = rows.withColumn("_run", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("long"), F.lit(0))).withColumn("_run", F.sum("_run").over(w))
    local = rows.groupBy(*by, "_seg", "_run").agg(F.max("state").alias("state"), F.count("*").alias("n")).withColumn("_last", F.max("_run").over(Window.partitionBy(*by, "_seg")))
    inner = (F.col("_run") > 0) & (F.col("_run") < F.col("_last"))
    sums = [f.alias(f"{name}{s}") for s in (0, 1) for name, f in (("runs", F.count(F.when(inner & (F.col("state") == s), 1))), ("frames", F.coalesce(F.sum(F.when(inner & (F.col("state") == s), F.col("n"))), F.lit(0))))]
    edge = lambda k: F.max(F.when(F.col("_run") == k, F.struct("state", "n")))
    parts = local.groupBy(*by, "_seg").agg(edge(F.lit(0)).alias("first"), edge(F.when(F.col("_last") > 0, F.col("_last"))).alias("last"), *sums)
    inner_of = ("runs0", "frames0", "runs1", "frames1")
    piece = lambda k, x, whole: F.struct(F.lit(k).alias("k"), F.col(x)["state"].alias("state"), F.col(x)["n"].alias("n"), *((F.col(c) if whole else F.lit(0).cast("long")).alias(c) for c in inner_of))
    pieces = parts.select(*by, "_seg", F.explode(F.array_compact(F.array(piece(0, "first", True), F.when(F.col("last").isNotNull(), piece(1, "last", False))))).alias("x")).select(*by, "_seg", "x.*")
    along = Window.partitionBy(*by).orderBy("_seg", "k")
    begins = F.coalesce(((F.col("k") == 1) | (F.col("state") != F.lag("state").over(along))).cast("long"), F.lit(0))
    joined = pieces.withColumn("_begins", begins).withColumn("_id", F.sum("_begins").over(along)).groupBy(*by, "_id").agg(F.max("state").alias("state"), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in inner_of))
    joined = joined.withColumn("_end", F.max("_id").over(Window.partitionBy(*by)))
    within = (F.col("_id") > 0) & (F.col("_id") < F.col("_end"))
    both = []
    for s in (0, 1):
        mine = within & (F.col("state") == s)
        both += [(F.sum(f"runs{s}") + F.count(F.when(mine, 1))).alias(f"runs{s}"), (F.sum(f"frames{s}") + F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0))).alias(f"frames{s}")]
    up = F.coalesce(F.sum(F.when(F.col("state") == 1, F.col("n"))), F.lit(0)) + F.sum("frames1")
    return joined.groupBy(*by).agg((F.max("_end") + F.sum("runs0") + F.sum("runs1")).alias("transitions"), (F.sum("n") + F.sum("frames0") + F.sum("frames1")).alias("frames"), up.alias("up"), *both)


def summarize(series: DataFrame, threshold: float = 0.0, by: tuple[str, ...] = BY) -> DataFrame:
    """One row a series with the fourteen statistics; quantiles interpolate linearly, deviations have no correction."""
    up = (F.col("value") > F.lit(float(threshold))).cast("int")
    stats = series.groupBy(*by).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg(up).alias("exposure_frequency"))
    turns = runs(series.select(*by, "frame", up.alias("state")), by).select(*by, "transitions")
    q = quantiles(series, (0.5, 0.05, 0.25, 0.75, 0.95), by)
    mid = q.select(*by, F.col("q")[0].alias("median"))
    mad = quantiles(series.join(mid, list(by)).withColumn("value", F.abs(F.col("value") - F.col("median"))), (0.5,), by).select(*by, F.col("q")[0].alias("mad"))
    named = [F.col("q")[i].alias(n) for i, n in enumerate(("median", "q05", "q25", "q75", "q95"))]
    rows = stats.join(turns, list(by)).join(q, list(by), "left").join(mad, list(by), "left")
    return rows.select(*by, "mean", "variance", "std", "min", "max", *named, (F.col("q")[3] - F.col("q")[2]).alias("iqr"), "mad", "exposure_frequency", "transitions")


def states(series: DataFrame, threshold: float = 0.0, hysteresis: float = 0.0, by: tuple[str, ...] = BY) -> DataFrame:
    """by, frame, state of a two-level switch: up above threshold + hysteresis, down at or below threshold - hysteresis, else as before."""
    v, t, h = F.col("value"), float(threshold), float(hysteresis)
    event = F.when(v > t + h, 1).when(v <= t - h, 0)
    rows = running(series.select(*by, "frame", "value"), tuple(by), "frame", {"_event": ("max", F.when(event.isNotNull(), F.struct("frame", event.alias("to")))), "_first": ("min", F.struct("frame", "value"))})
    return rows.select(*by, "frame", F.coalesce(F.col("_event.to"), (F.col("_first.value") > t).cast("int")).alias("state"))


def kinetics(series: DataFrame, threshold: float = 0.0, hysteresis: float = 0.0, frame_interval: float = 1.0, by: tuple[str, ...] = BY) -> DataFrame:
    """Two-level switch with hysteresis: transitions, rate, mean dwell times of interior runs."""
    got = runs(states(series, threshold, hysteresis, by), by)
    rate = F.when(F.col("frames") > 1, F.col("transitions") / ((F.col("frames") - 1) * float(frame_interval)))
    dwell = [F.when(F.col(f"runs{s}") > 0, F.col(f"frames{s}") * float(frame_interval) / F.col(f"runs{s}")).alias(n) for s, n in ((1, "exposed_dwell"), (0, "buried_dwell"))]
    return got.select(*by, "transitions", rate.alias("rate"), (F.col("up") / F.col("frames")).alias("exposed_fraction"), *dwell)


def _placed(series: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """With ``i``, the place of a frame in its series, from 0."""
    return running(series, tuple(by), "frame", {"i": ("sum", F.lit(1).cast("long"))}).withColumn("i", F.col("i") - 1)


def block_error(series: DataFrame, block_size: int | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """Standard error from means of whole consecutive blocks (two at least); by default of about sqrt(n) frames (half to even)."""
    size = F.greatest(F.bround(F.sqrt(F.count("*")), 0).cast("int"), F.lit(1)) if block_size is None else F.lit(block_size)
    sizes = series.groupBy(*by).agg(size.alias("block_size"))
    pos = _placed(series, by).join(sizes, list(by))
    blocks = pos.groupBy(*by, "block_size", F.floor(F.col("i") / F.col("block_size")).alias("b")).agg(F.avg("value").alias("m"), F.count("*").alias("n")).where("n = block_size")
    return blocks.groupBy(*by, "block_size").agg(F.count("*").alias("blocks"), F.when(F.count("*") >= 2, F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("block_se"))


CHUNK = 1 << 16  # frames whose products are summed in one task


def autocorrelation(series: DataFrame, max_lag: int, by: tuple[str, ...] = BY) -> DataFrame:
    """rho(lag) of every series for lags 1..max_lag.

    A series is cut into chunks of consecutive frames; a chunk also gets the ``max_lag`` frames that follow it, sums its
    products for every lag at once, and the sums of all chunks are added up.
    """
    chunk = max(CHUNK, max_lag)
    stats = series.groupBy(*by).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.count("*").alias("n"))
    pos = _placed(series, by).join(stats, list(by)).withColumn("own", F.floor(F.col("i") / chunk))
    also = F.when((F.col("own") > 0) & (F.col("i") % chunk < max_lag), F.array("own", F.col("own") - 1)).otherwise(F.array("own"))
    rows = pos.select(*by, F.explode(also).alias("chunk"), F.col("i").cast("long").alias("i"), (F.col("value") - F.col("mean")).alias("d"))

    def products(t: pa.Table) -> pa.Table:
        i, d = t.column("i").to_numpy(), t.column("d").to_numpy()
        order = np.argsort(i)
        d, n = d[order], int((i < (t.column("chunk")[0].as_py() + 1) * chunk).sum())
        lags = np.arange(1, min(max_lag, len(d) - 1) + 1)
        s = np.array([d[: min(n, len(d) - k)] @ d[k : k + min(n, len(d) - k)] for k in lags])
        return pa.table({**{c: pa.repeat(t.column(c)[0], len(lags)) for c in by}, "lag": lags.astype(np.int32), "s": s.astype(np.float64)})

    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    sums = rows.groupBy(*by, "chunk").applyInArrow(products, ", ".join(f"{c} {kinds[c]}" for c in by) + ", lag int, s double")
    sums = sums.groupBy(*by, "lag").agg(F.sum("s").alias("s"))
    return sums.join(stats, list(by)).select(*by, "lag", F.when(F.col("var") > 0, F.col("s") / (F.col("n") * F.col("var"))).alias("rho"))


def uncertainty(series: DataFrame, max_lag: int = 1000, by: tuple[str, ...] = BY) -> DataFrame:
    """tau = 1 + 2 * sum of rho up to the first negative one; effective frames; standard error of the mean."""
    n = series.groupBy(*by).agg(F.count("*").alias("frames"), F.stddev_samp("value").alias("sd"))
    rho = autocorrelation(series, max_lag, by)
    stop = rho.where("rho < 0").groupBy(*by).agg(F.min("lag").alias("stop"))
    tau = rho.join(stop, list(by), "left").where("stop is null or lag < stop").groupBy(*by).agg((1 + 2 * F.sum("rho")).alias("tau"))
    out = n.join(tau, list(by), "left").withColumn("tau", F.when(F.col("frames") >= 8, F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.greatest(F.coalesce("tau", F.lit(1.0)), F.lit(1.0)))))
    return out.select(*by, "frames", "tau", (F.col("frames") / F.col("tau")).alias("effective_frames"), (F.col("sd") * F.sqrt(F.col("tau") / F.col("frames"))).alias("standard_error"))


def fingerprint(series: DataFrame, normalize: str | None = None, reference: DataFrame | None = None, by: tuple[str, ...] = BY) -> DataFrame:
    """Series with ``value`` normalised: zscore, minmax, relative (to ``reference`` by, value), or as it is."""
    if normalize in (None, "none"):
        return series
    floor = F.lit(1e-12)
    if normalize == "relative":
        if reference is None:
            raise ValueError("a reference is needed")
        ref = reference.select(*by, F.col("value").alias("ref"))
        return series.join(ref, list(by)).withColumn("value", F.col("value") / F.greatest("ref", floor)).drop("ref")
    a = {"zscore": (F.avg("value"), F.stddev_pop("value")), "minmax": (F.min("value"), F.max("value") - F.min("value"))}.get(normalize)
    if a is None:
        raise ValueError(f"unknown normalisation {normalize}")
    base = series.groupBy(*by).agg(a[0].alias("at"), a[1].alias("span"))
    return series.join(base, list(by)).withColumn("value", (F.col("value") - F.col("at")) / F.greatest("span", floor)).drop("at", "span")


def flatten(stats: DataFrame, prefix: str = "") -> DataFrame:
    """Long rows (name, value) of a summary; the index is part of the name where a feature has several."""
    many = stats.groupBy("feature").agg((F.count("*") > 1).alias("many"))
    long = stats.join(many, "feature").select("feature", "idx", "many", F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in SUMMARY_STATISTIC_NAMES])).alias("s"))
    name = F.concat(F.lit(prefix), F.col("feature"), F.lit("."), F.col("s.stat"), F.when(F.col("many"), F.concat(F.lit("."), F.col("idx").cast("string"))).otherwise(F.lit("")))
    return long.select(name.alias("name"), F.col("s.value").alias("value"))
