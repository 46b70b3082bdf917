"""Frames that arrive: the same kernels on a stream of files or of a growing trajectory, and exposure kinetics as keyed state."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.aggregate import totals
from ..operators.kernels import shrake_rupley
from ..schema import COORDS
from ..sources.structures import with_coordinates


def coordinate_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of (structure, frame, atom, x, y, z) as they arrive."""
    return spark.readStream.schema(COORDS).parquet(path)


def totals_per_batch(coords: DataFrame, atoms: DataFrame, path: str, checkpoint: str, probe: float = 1.4, n_points: int = 100):
    """Per-frame totals of each micro-batch, written once per batch id (a repeated batch overwrites its own folder).

    A frame has one total if all of it comes in one micro-batch, as a stream of a growing trajectory
    (:func:`rollprobe.sources.trajectories.stream_trajectory`) gives it; files that split a frame give a total for each part.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = with_coordinates(atoms.select(*(c for c in ("structure", "atom", "radius") if c in atoms.columns)), batch)
        totals(shrake_rupley(rows, probe, n_points)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return coords.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def advance(s: dict, v: np.ndarray, threshold: float, hysteresis: float) -> None:
    """Take the next values of a series into its state: level, length of the run, transitions, frames, interior runs."""
    event = np.where(v > threshold + hysteresis, 1, np.where(v <= threshold - hysteresis, 0, -1))
    if s["on"] < 0:
        event[0] = v[0] > threshold
    last = np.maximum.accumulate(np.where(event >= 0, np.arange(len(v)), -1))  # the last event at or before each frame
    now = np.where(last >= 0, event[np.maximum(last, 0)], s["on"])
    for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(now)) + 1).tolist(), len(now)]):
        on = int(now[a])
        if on == s["on"]:
            s["run"] += b - a
            continue
        if s["on"] >= 0:
            if s["transitions"]:  # not the first run: it lies between two transitions
                s[f"runs{s['on']}"] += 1
                s[f"frames{s['on']}"] += s["run"]
            s["transitions"] += 1
        s["on"], s["run"] = on, b - a
    s["frames"], s["up"] = s["frames"] + len(v), s["up"] + int(now.sum())


FIELDS = ("next", "on", "run", "transitions", "frames", "up", "runs0", "frames0", "runs1", "frames1", "waiting")
SUMMARY = "frames long, state int, transitions long, rate double, exposed_fraction double, exposed_dwell double, buried_dwell double, waiting long"


class Switch(StatefulProcessor):
    """State of one series: what :func:`advance` keeps, and frames that came before those they follow."""

    def __init__(self, keys: list[str], threshold: float, hysteresis: float, interval: float, first: int, step: int, patience: int | None) -> None:
        self.keys, self.threshold, self.hysteresis, self.interval, self.first, self.step, self.patience = keys, threshold, hysteresis, interval, first, step, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", ", ".join(f"{f} long" for f in FIELDS))
        self.early = handle.getMapState("early", "frame long", "value double")

    def held(self) -> dict:
        got = self.seen.get()
        return dict(zip(FIELDS, got, strict=True)) if got is not None else {f: 0 for f in FIELDS} | {"next": self.first, "on": -1}

    def take(self, s: dict, new: dict[int, float], all_: bool) -> None:
        """Values in order as far as they follow each other (``all_``: over gaps too); the others wait."""
        old = {k[0]: v[0] for k, v in self.early.iterator()} if s["waiting"] else {}
        every = old | {f: v for f, v in new.items() if f >= s["next"]}  # a frame that was counted already changes nothing
        order = sorted(every)
        n = len(order) if all_ else next((i for i, f in enumerate(order) if f != s["next"] + i * self.step), len(order))
        if n:
            advance(s, np.array([every[f] for f in order[:n]], float), self.threshold, self.hysteresis)
            s["next"] = order[n - 1] + self.step
        for f in order[:n]:
            if f in old:
                self.early.removeKey((f,))
        for f in order[n:]:
            if f not in old:
                self.early.updateValue((f,), (every[f],))
        s["waiting"] = len(order) - n
        self.seen.update(tuple(int(s[f]) for f in FIELDS))

    def row(self, key: tuple, s: dict) -> pd.DataFrame:
        mean = lambda on: s[f"frames{on}"] * self.interval / s[f"runs{on}"] if s[f"runs{on}"] else None
        rate = s["transitions"] / ((s["frames"] - 1) * self.interval) if s["frames"] > 1 else None
        values = (s["frames"], s["on"], s["transitions"], rate, s["up"] / s["frames"] if s["frames"] else None, mean(1), mean(0), s["waiting"])
        return pd.DataFrame([(*key, *values)], columns=[*self.keys, *(x.split()[0] for x in SUMMARY.split(", "))])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, new = self.held(), {}
        for pdf in rows:
            new |= dict(zip(pdf["frame"].tolist(), pdf["value"].tolist(), strict=True))
        self.take(s, new, False)
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if s["waiting"]:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self.row(key, s)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """What is missing has not come in time: frames that waited for it are taken in order."""
        s = self.held()
        self.take(s, {}, True)
        yield self.row(key, s)

    def close(self) -> None:
        """Nothing is held open."""


def streaming_kinetics(series: DataFrame, threshold: float, hysteresis: float = 0.0, frame_interval: float = 1.0, first: int = 0, step: int = 1, patience: int | None = None) -> DataFrame:
    """Running kinetics of every series (structure as far as there is one, feature, idx), as the batch form gives them.

    Frames (``first``, ``first + step``, ...) may arrive in any order: those whose predecessors are missing wait as state
    (``waiting`` counts them). After ``patience`` milliseconds without news of a series, where that is given, they are taken
    in their order without the missing ones. A frame that comes again changes nothing. State is held by RocksDB.
    """
    spark, store = series.sparkSession, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    keys = [c for c in ("structure", "feature", "idx") if c in series.columns]
    kinds = dict(series.dtypes)
    rows = series.select(*keys, F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value"))
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + SUMMARY
    return rows.groupBy(*keys).transformWithStateInPandas(Switch(keys, float(threshold), float(hysteresis), float(frame_interval), first, step, patience), schema, "Update", "None" if patience is None else "ProcessingTime")
