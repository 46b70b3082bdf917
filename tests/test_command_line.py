"""The command line on trajectories: topologies of every kind, counts, frames from the end, every table and format of points."""

import numpy as np
import pytest

from rollprobe.__main__ import arguments, run
from rollprobe.api import sasa
from rollprobe.sources.structures import assign_radii, read_pdb
from rollprobe.sources.trajectories import dcd_bytes, read_dcd, xtc_frame
from rollprobe.trajectory import TrajectoryAnalysis, open_trajectory

NAMES = ["N", "CA", "C", "O", "CB", "HA"]
XYZ = np.round(np.random.default_rng(2).uniform(0, 6, (6, 12, 3)), 2)


def pdb():
    rows = [f"{'HETATM' if i == 11 else 'ATOM':<6}{i + 1:5d}  {NAMES[i % 6]:<3} ALA A{i // 6 + 1:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00          {'H' if i % 6 == 5 and i != 11 else NAMES[i % 6][0] if i != 11 else 'O':>2}" for i, (x, y, z) in enumerate(XYZ[0])]
    return "\n".join(rows) + "\nEND\n"


def cif():
    tags = "group_PDB id type_symbol label_atom_id label_alt_id auth_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code auth_atom_id Cartn_x Cartn_y Cartn_z pdbx_PDB_model_num".split()
    rows = [f"{'HETATM' if i == 11 else 'ATOM'} {i + 1} {'H' if i % 6 == 5 and i != 11 else NAMES[i % 6][0] if i != 11 else 'O'} {NAMES[i % 6]} . ALA A {i // 6 + 1} ? {NAMES[i % 6]} {x} {y} {z} 1" for i, (x, y, z) in enumerate(XYZ[0])]
    return "data_x\nloop_\n" + "".join(f"_atom_site.{t}\n" for t in tags) + "\n".join(rows) + "\n#\n"


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "x.pdb").write_text(pdb())
    (d / "x.cif").write_text(cif())
    (d / "t.dcd").write_bytes(dcd_bytes(XYZ))
    (d / "t.xtc").write_bytes(b"".join(xtc_frame(x, k) for k, x in enumerate(XYZ)))
    (d / "short.dcd").write_bytes(dcd_bytes(XYZ[:, :11]))
    return d


def rows(spark, path):
    return spark.read.option("header", True).option("inferSchema", True).csv(str(path)).collect()


def test_every_topology_and_trajectory_agree(spark, at):
    want = None
    for top in ("x.pdb", "x.cif"):
        for traj in ("t.dcd", "t.xtc"):
            atoms = open_trajectory(spark, str(at / top), str(at / traj))
            got = {r.frame: r.total_sasa for r in sasa(atoms).total.collect()}
            assert sorted(got) == list(range(6)) and atoms.where("frame = 0").count() == 10  # no hydrogen, no hetero atom
            want = want or got
            assert got == pytest.approx(want, abs=0.2)  # an XTC file holds hundredths
    alone = sasa(assign_radii(read_pdb(spark, str(at / "x.pdb")), any_residue=False)).total.first().total_sasa
    assert want[0] == pytest.approx(alone, abs=0.2)


def test_counts_are_checked(spark, at):
    with pytest.raises(ValueError, match="11 atoms a frame, its topology 12"):
        open_trajectory(spark, str(at / "x.pdb"), str(at / "short.dcd"))
    assert open_trajectory(spark, str(at / "x.pdb"), str(at / "short.dcd"), check=False).count() == 60
    with pytest.raises(ValueError, match="11 atoms"):
        run(spark, [str(at / "x.cif"), str(at / "short.dcd"), "--out", str(at / "no")])


def test_tables_and_points(spark, at):
    out = at / "out"
    run(spark, [str(at / "x.cif"), str(at / "t.xtc"), "--out", str(out), "--frames=-2:", "--select", "beta, name CB", "--residue", "--classes", "--summary", "--surface-points", "xyz", "--surface-resolution", "30", "--hetatm"])
    assert [r.frame for r in sorted(rows(spark, out / "trajectory"))] == [4, 5] or sorted(r.frame for r in rows(spark, out / "trajectory")) == [4, 5]
    residue = rows(spark, out / "residue")
    assert len(residue) == 4 and sum(r.residue_sasa for r in residue if r.frame == 4) == pytest.approx(next(r.total_sasa for r in residue if r.frame == 4))
    assert len(rows(spark, out / "class")) == 6 and len(rows(spark, out / "class_selection")) == 6 and len(rows(spark, out / "selection")) == 2
    assert all(len(rows(spark, out / f"summary_{s}")) >= 1 for s in ("total", "selection", "class", "class_selection"))
    lines = [r.value for r in spark.read.text(str(out / "points")).collect()]
    assert sum(x.startswith("X ") for x in lines) == len(lines) - 4
    run(spark, [str(at / "x.pdb"), str(at / "t.dcd"), "--out", str(at / "one"), "--frames=-1", "--surface-points", "dcd"])
    assert read_dcd(spark, str(at / "one" / "points")).count() > 10
    assert [r.frame for r in rows(spark, at / "one" / "trajectory")] == [5]


def test_bad_options(spark, at):
    for bad in (["--resolution", "8x"], ["--resolution", "0"], ["--surface-points", "pdf"]):
        with pytest.raises(SystemExit):
            arguments().parse_args([str(at / "x.pdb"), "--out", "o", *bad])
    with pytest.raises(ValueError, match="32 selections"):
        run(spark, [str(at / "x.pdb"), "--out", str(at / "o"), *sum((["--select", f"s{k}, name CA"] for k in range(33)), [])])
    with pytest.raises(ValueError, match="out of range"):
        run(spark, [str(at / "x.pdb"), str(at / "t.dcd"), "--out", str(at / "o"), "--frames", "9"])


def test_analysis_of_chosen_frames(spark, at):
    a = TrajectoryAnalysis(open_trajectory(spark, str(at / "x.pdb"), str(at / "t.dcd")))
    every = {r.frame: r.total_sasa for r in a.run().total.collect()}
    for options, keep in (({"start": 1, "stop": 5, "step": 2}, [1, 3]), ({"start": -2}, [4, 5]), ({"stop": -4}, [0, 1]), ({"frames": [5, 0, -2]}, [0, 4, 5]), ({"step": 4}, [0, 4])):
        r = a.run(**options)
        assert {x.frame: x.total_sasa for x in r.total.collect()} == {k: every[k] for k in keep}
        mean = r.mean_total.first()
        assert mean.frames == len(keep) and mean.mean_total_sasa == pytest.approx(np.mean([every[k] for k in keep]))
    assert a.run().mean_residue.count() == 2
    for bad in ({"frames": [1], "start": 0}, {"step": 0}, {"frames": [-9]}):
        with pytest.raises(ValueError):
            a.run(**bad)
