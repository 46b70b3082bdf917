import time

import numpy as np
import pytest

from rollprobe.api import from_arrays, sasa
from rollprobe.__main__ import run
from rollprobe.operators import timeseries as T
from rollprobe.sources.structures import dcd_bytes
from rollprobe.sources.trajectories import stream_trajectory
from rollprobe.streaming.frames import coordinate_stream, streaming_kinetics, totals_per_batch


def test_totals_of_a_stream(spark, tmp_path):
    atoms = from_arrays(spark, np.random.default_rng(0).uniform(0, 8, (3, 10, 3)), np.full(10, 1.5))
    atoms.selectExpr("'s' as structure", "frame", "atom", "x", "y", "z").write.parquet(str(tmp_path / "in"))
    top = atoms.where("frame = 0").select("atom", "radius")
    totals_per_batch(coordinate_stream(spark, str(tmp_path / "in")), top, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.frame: round(r.total_sasa, 6) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.frame: round(r.total_sasa, 6) for r in sasa(atoms).total.collect()}


def test_kinetics_of_a_stream(spark, tmp_path):
    """Frames that arrive in several files give the transitions of the whole series."""
    r = np.random.default_rng(5)
    values = {f: r.standard_normal(60).cumsum() for f in ("a", "b")}
    schema = "feature string, idx int, frame int, value double"
    for k in range(3):
        rows = [(f, 0, i, float(v[i])) for f, v in values.items() for i in range(20 * k, 20 * k + 20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming_kinetics(stream, 0.0, 0.5).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.parquet(str(tmp_path / f"out{n}"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for n in range(3):
        got |= {x.feature: (x.frames, x.transitions) for x in spark.read.parquet(str(tmp_path / f"out{n}")).collect()}
    whole = spark.createDataFrame([(f, 0, i, float(x)) for f, v in values.items() for i, x in enumerate(v)], schema)
    assert got == {x.feature: (60, x.transitions) for x in T.kinetics(whole, 0.0, 0.5).collect()}


@pytest.mark.parametrize("patience", [None, 20_000])
def test_kinetics_of_frames_in_any_order(spark, tmp_path, patience):
    """Shuffled over files, some twice: as the batch form, dwell times included; what waits for a frame that never comes is taken in time."""
    r = np.random.default_rng(7)
    values = {("s", "a", 0): r.standard_normal(50).cumsum(), ("s", "a", 1): np.tile([2.0, 2, -2], 15), ("t", "a", 0): np.full(20, 0.1), ("t", "b", 0): r.standard_normal(30)}
    schema = "structure string, feature string, idx int, frame int, value double"
    rows = [(*k, i, float(x)) for k, v in values.items() for i, x in enumerate(v)]
    whole = spark.createDataFrame(rows, schema)
    missing = [x for x in rows if not (x[:3] == ("t", "b", 0) and x[3] == 3)]
    order = r.permutation(len(missing))
    for k, part in enumerate(np.array_split(order, 4)):
        spark.createDataFrame([missing[i] for i in part] + [missing[order[0]]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = {}

    def keep(df, n):
        got.update({(x.structure, x.feature, x.idx): x for x in df.collect()})

    out = streaming_kinetics(stream, 0.0, 0.5, 0.5, patience=patience).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp"))
    if patience is None:
        out.trigger(availableNow=True).start().awaitTermination()
    else:
        q, began = out.start(), time.time()
        while time.time() - began < 150 and (len(got) < 4 or any(x.waiting for x in got.values()) or got["t", "b", 0].frames < 29):
            time.sleep(0.5)
        q.stop()
    for x in T.kinetics(whole, 0.0, 0.5, 0.5, by=("structure", "feature", "idx")).collect():
        y = got[x.structure, x.feature, x.idx]
        if (x.structure, x.feature) == ("t", "b"):
            assert (y.frames, y.waiting) == ((3, 26) if patience is None else (29, 0))
            continue
        assert (y.transitions, y.exposed_fraction, y.exposed_dwell, y.buried_dwell, y.rate, y.waiting) == (x.transitions, x.exposed_fraction, x.exposed_dwell, x.buried_dwell, x.rate, 0)


def test_totals_of_a_growing_trajectory(spark, tmp_path):
    """Frames that are appended between micro-batches have one total each."""
    atoms = from_arrays(spark, np.random.default_rng(0).uniform(0, 8, (6, 10, 3)), np.full(10, 1.5))
    xyz = np.array([r[0] for r in atoms.selectExpr("array(x, y, z)").collect()]).reshape(6, 10, 3)
    path = tmp_path / "t.dcd"
    top = atoms.where("frame = 0").select("atom", "radius")
    for n in (2, 5, 6):
        path.write_bytes(dcd_bytes(xyz[:n]))
        totals_per_batch(stream_trajectory(spark, str(path)), top, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.frame, r.total_sasa) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [f for f, _ in got] == list(range(6))
    assert [t for _, t in got] == pytest.approx([r.total_sasa for r in sasa(atoms).total.orderBy("frame").collect()], rel=1e-3)


def test_command_line(spark, tmp_path):
    psf = tmp_path / "x.psf"
    psf.write_text("PSF\n\n 2 !NATOM\n 1 AP 1 ALA CA CT1 0.07 12.011 0\n 2 AP 1 ALA CB CT1 0.09 12.011 0\n\n 0 !NBOND\n")
    (tmp_path / "t.dcd").write_bytes(dcd_bytes(np.array([[[0, 0, 0], [2, 0, 0]], [[0, 0, 0], [50, 0, 0]], [[0, 0, 0], [3, 0, 0]]], float)))
    out = str(tmp_path / "out")
    warned = run(spark, [str(psf), str(tmp_path / "t.dcd"), "--out", out, "--frames", "0:2", "--select", "beta, name CB+ZZ", "--format", "csv", "--format", "log", "--format", "points"])
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/trajectory").orderBy("frame").collect()
    assert [r.frame for r in rows] == [0, 1] and rows[1].total_sasa > rows[0].total_sasa and warned == ["beta: name ZZ matches no atom"]
    assert spark.read.text(f"{out}/log").count() > 5 and spark.read.option("header", True).csv(f"{out}/selection").count() == 2
