import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollprobe.api import SasaEngine, from_arrays, lee_richards, sasa
from rollprobe.functions.chemistry import canonical_atom_name, element_from_mass, parse_radius_config, protor
from rollprobe.functions.points import sphere_points
from rollprobe.operators import timeseries as T
from rollprobe.operators.embedding import SasaFingerprintEmbedder
from rollprobe.operators.features import interface
from rollprobe.plans.selection import select, split_command
from rollprobe.sources.records import frame_numbers
from rollprobe.sources.sinks import SINKS, pdb_lines, write
from rollprobe.sources.structures import assign_radii, atom_site, dcd_bytes, radius_config, read_dcd, read_mmcif, read_pdb, read_psf, read_topology, with_coordinates, write_dcd


def brute(xyz, r, probe, n):
    p, er, out = np.array(sphere_points(n)), r + probe, []
    for i in range(len(xyz)):
        pts = xyz[i] + er[i] * p
        hid = np.zeros(n, bool)
        for j in range(len(xyz)):
            if i != j:
                hid |= ((pts - xyz[j]) ** 2).sum(axis=1) < er[j] ** 2
        out.append(n - hid.sum())
    return out


def test_random_packing_matches_brute_force(spark):
    r = np.random.default_rng(1)
    xyz, rad = r.uniform(0, 12, (60, 3)), r.uniform(1.2, 2.0, 60)
    got = sasa(from_arrays(spark, xyz, rad)).atom.orderBy("atom").toPandas()
    assert got.exposed.tolist() == brute(xyz, rad, 1.4, 100)
    lr = lee_richards(from_arrays(spark, xyz, rad), n_slices=200).total.first().total_sasa
    assert lr == pytest.approx(got.sasa.sum(), rel=0.03)


def test_isolated_and_buried(spark):
    a = from_arrays(spark, np.array([[0, 0, 0], [100, 0, 0], [0, 0, 0.1]]), np.array([1.0, 2.0, 5.0]))
    got = [x.sasa for x in sasa(a, probe_radius=0.0).atom.orderBy("atom").collect()]
    assert got == pytest.approx([0.0, 16 * math.pi, 100 * math.pi])
    lr = [x.sasa for x in lee_richards(a, probe_radius=0.0).atom.orderBy("atom").collect()]
    assert lr == pytest.approx([0.0, 16 * math.pi, 100 * math.pi])


def test_single_precision_boundary(spark):
    a = from_arrays(spark, np.array([[0, 0, 0], [1.5, 0, 0]]), np.array([1.0, 0.5000000001]))
    low = SasaEngine(spark, 0.0, 1, precision="fp32").sasa(a).total.first().total_sasa
    assert SasaEngine(spark, 0.0, 1).sasa(a).total.first().total_sasa == pytest.approx(math.pi)
    assert low == pytest.approx(5 * math.pi)


def test_input_is_checked(spark):
    with pytest.raises(ValueError):
        from_arrays(spark, np.array([[0, 0, np.nan]]), np.array([1.0]))
    with pytest.raises(ValueError):
        SasaEngine(spark, n_points=0)
    frames = spark.range(2).select(F.col("id").cast("int").alias("frame"))
    none = SasaEngine(spark).sasa(from_arrays(spark, np.zeros((2, 0, 3)), np.zeros(0)), frames=frames)
    assert [(r.frame, r.total_sasa) for r in none.total.orderBy("frame").collect()] == [(0, 0.0), (1, 0.0)] and none.residue.count() == 0
    odd = spark.createDataFrame([(0, 0.0, float("inf"), 0.0, 1.0)], "atom int, x double, y double, z double, radius double")
    with pytest.raises(ValueError):
        SasaEngine(spark).check(odd)


def test_bad_input_is_refused_in_the_run_that_uses_it(spark):
    atoms = from_arrays(spark, np.zeros((1, 3, 3)) + np.arange(3)[None, :, None], np.ones(3))
    bad = atoms.withColumn("x", F.when(F.col("atom") == 1, F.lit(float("nan"))).otherwise(F.col("x")))
    for run in (lambda e, a: e.sasa(a), lambda e, a: e.lee_richards(a)):
        result = run(SasaEngine(spark), bad)  # nothing has run yet
        with pytest.raises(Exception, match="at atom 1"):
            result.total.collect()
        plan = run(SasaEngine(spark), atoms).total._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") == run(SasaEngine(spark, check=False), atoms).total._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")  # no scan more
    with pytest.raises(Exception, match="at atom 2"):
        SasaEngine(spark).sasa(atoms.withColumn("radius", F.when(F.col("atom") == 2, -1.0).otherwise(1.0))).total.collect()


def test_interface_identities(spark):
    r = np.random.default_rng(2)
    atoms = from_arrays(spark, r.uniform(0, 6, (2, 12, 3)), np.full(12, 1.6))
    for a, b in ((F.col("atom") < 6, F.col("atom") < 3), (F.col("atom") > 99, F.col("atom") < 3)):
        with pytest.raises(ValueError):
            interface(atoms, a, b)
    for x in interface(atoms, F.col("atom") < 6, F.col("atom") >= 6, n_points=32).collect():
        assert x.buried == pytest.approx(x.a_free + x.b_free - x.complex)
        assert x.complex == pytest.approx(x.a_bound + x.b_bound)


PDB = """\
ATOM      1  N   ALA A   1       0.000   0.000   0.000  1.00  0.00           N
ATOM      2  CA AALA A   1       1.450   0.000   0.000  1.00  0.00           C
ATOM      3  CA BALA A   1       1.500   0.100   0.000  1.00  0.00           C
ATOM      4  H   ALA A   1      10.000   0.000   0.000  1.00  0.00           H
ATOM      5  C   GLY A   2A     20.000   0.000   0.000  1.00  0.00           C
HETATM    6  O   HOH A   3      30.000   0.000   0.000  1.00  0.00           O
END
"""


def test_pdb_policies(spark, tmp_path):
    p = tmp_path / "x.pdb"
    p.write_text(PDB)
    n = lambda **k: read_pdb(spark, str(p), **k).count()
    assert (n(), n(hydrogen=True), n(hetatm=True), n(hydrogen=True, hetatm=True), n(align=True)) == (3, 4, 4, 5, 6)
    atoms = assign_radii(read_pdb(spark, str(p)))
    rows = atoms.orderBy("atom").collect()
    assert [r.residue_id for r in rows] == [0, 0, 1] and rows[2].residue_label == "2A" and [r.radius for r in rows] == [1.64, 1.88, 1.61]
    area = sasa(atoms).atom
    for f in SINKS.values():
        assert f(area).count() > 0
    write(area, str(tmp_path / "out"), tuple(SINKS))
    lines = spark.read.text(str(tmp_path / "out" / "res")).collect()
    assert len(lines) == 20 and lines[0].value.startswith("RES ALA")
    again = pdb_lines(area, spark.createDataFrame([("x", i, v) for i, v in enumerate(PDB.splitlines())], "structure string, line int, value string")).orderBy("ord").collect()
    assert [r.value for r in again][-1] == "END" and again[0].value[54:60] == "  1.64" and again[0].value[:54] == PDB.splitlines()[0][:54]
    assert area.where(select("resi 2A").column).count() == 1 and area.where(select("resi 2").column).count() == 1


def test_mmcif_psf_dcd(spark, tmp_path):
    cif = tmp_path / "x.cif"
    cols = "group_PDB id type_symbol label_atom_id label_alt_id auth_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code auth_atom_id Cartn_x Cartn_y Cartn_z pdbx_PDB_model_num".split()
    cif.write_text("data_x\nloop_\n" + "\n".join("_atom_site." + c for c in cols) + "\nATOM 1 C CA A ALA A 1 ? CA 0 0 0 1\nATOM 2 C CA B ALA A 1 ? CA 1 0 0 1\nATOM 3 O \"O5'\" . ALA A 1 B \"O5'\" 2 0 0 1\nATOM 4 C CA . ALA A 1 ? CA 0 0 0 2\n#\n")
    rows = read_mmcif(spark, str(cif)).orderBy("atom").collect()
    assert [(r.atom_name, r.residue_label) for r in rows] == [("CA", "1"), ("O5'", "1B")]
    psf = tmp_path / "x.psf"
    psf.write_text("PSF\n\n 2 !NATOM\n 1 AP 1 ALA CA CT1 0.07 12.011 0\n 2 AP 1 ALA HA HB 0.09 3.024 0\n\n 0 !NBOND\n")
    assert [r.element for r in read_psf(spark, str(psf)).orderBy("atom").collect()] == ["C", "H"]
    xyz = np.arange(18, dtype=float).reshape(2, 3, 3)
    (tmp_path / "x.dcd").write_bytes(dcd_bytes(xyz))
    got = read_dcd(spark, str(tmp_path / "x.dcd")).orderBy("frame", "atom").toPandas()
    assert np.allclose(got[["x", "y", "z"]].to_numpy().reshape(2, 3, 3), xyz)
    two = got.assign(structure="y")
    both = spark.createDataFrame(got.assign(structure="x")).unionByName(spark.createDataFrame(two[two.frame == 0]))
    assert sorted(tuple(r) for r in write_dcd(both, str(tmp_path / "written")).collect()) == [("x", 2, 3), ("y", 1, 3)]
    back = read_dcd(spark, str(tmp_path / "written")).orderBy("structure", "frame", "atom").toPandas()
    assert np.allclose(back[back.structure == "x"][["x", "y", "z"]].to_numpy().reshape(2, 3, 3), xyz) and len(back) == 9
    cut = read_dcd(spark, str(tmp_path), range_bytes=1)  # a frame a task, all files of a folder
    assert cut.rdd.getNumPartitions() == 2 and cut.count() == 6


HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data")
MORE = os.environ.get("ROLLPROBE_STRUCTURES")  # a folder with more public PDB entries, where there is one
KNOWN = [("1ubq.pdb", False, 4834.716265), ("3bkr.pdb", True, 7265.254396354858), ("5dx9.pdb", True, 14264.580728034009), ("1EN2.cif", False, 4644.496800662938), ("7cma-assembly1.cif", True, 17862.263997408743)]


@pytest.mark.parametrize("at,name,hetatm,total", [(d, *k) for k in KNOWN for d in (HERE, MORE) if d and os.path.exists(os.path.join(d, k[0]))])
def test_known_totals(spark, at, name, hetatm, total):
    atoms = assign_radii(read_topology(spark, os.path.join(at, name), hetatm=hetatm))
    assert sasa(atoms).total.first().total_sasa == pytest.approx(total, abs=1e-6)
    if name == "1ubq.pdb":
        assert lee_richards(atoms).total.first().total_sasa == pytest.approx(4804.055641, abs=1e-5)


def test_several_files_stay_apart(spark, tmp_path):
    """The same structure in two files: each has the areas it has alone, at every level."""
    for n in ("a", "b"):
        (tmp_path / f"{n}.pdb").write_text(PDB)
    both, one = (assign_radii(read_pdb(spark, str(p))) for p in (tmp_path / "*.pdb", tmp_path / "a.pdb"))
    alone = sasa(one).total.first().total_sasa
    assert {(r.structure, r.total_sasa) for r in sasa(both).total.collect()} == {("a", alone), ("b", alone)}
    assert {r.total_sasa for r in lee_richards(both).total.collect()} == {lee_richards(one).total.first().total_sasa}
    coords = both.select("structure", "atom", "x", "y", "z").withColumn("frame", F.lit(3))
    assert with_coordinates(both, coords, check=True).count() == 6
    with pytest.raises(ValueError):
        with_coordinates(both, coords.where("atom > 0"), check=True)


def test_mmcif_rows_may_span_lines():
    text = "loop_\n_x.y\n1\n2\nloop_\n_atom_site.id\n_atom_site.name\n_atom_site.note\n1 \"O5'\" 'a b'\n2\nC\n;two\nlines\n;\n3 'O'' . # end\nloop_\n_z.z\n9\n"
    got = atom_site(text)
    assert got.values.tolist() == [["1", "O5'", "a b"], ["2", "C", "two\nlines"], ["3", "O'", "."]] and not len(atom_site("data_x\n"))
    with pytest.raises(ValueError):
        atom_site(text.replace(" . # end", ""))


def test_radius_sources(tmp_path, monkeypatch):
    p = tmp_path / "r.config"
    p.write_text("name: mine\ntypes:\nX 1.5\nX 1.7\natoms:\nALA CB X\n")
    assert radius_config().name == "ProtOr" and radius_config(str(p)).radius("ALA", "CB") == 1.7 and radius_config(str(p), first_wins=True).radius("ALA", "CB") == 1.5
    monkeypatch.setenv("ROLLPROBE_RADII", str(p))
    assert radius_config().name == "mine"
    assert len(protor(glycans=True).atoms) > len(protor().atoms) and protor().radius("DT", "C7") == 1.88 and protor(True).radius("NAG", "O7") == 1.42


def test_radius_rules():
    assert [element_from_mass(m, n) for m, n in ((1.008, ""), (3.024, ""), (12.011, ""), (22.98977, "SOD"), (0, ""), (7, ""), (11.991, "NZ"), (13.983, "OH"), (9.995, "CA"), (12.011, "CA"), (40.078, "CA"))] == ["H", "H", "C", "NA", None, None, "N", "O", "C", "C", "CA"]
    assert canonical_atom_name("ILE", "CD") == ("ILE", "CD1") and canonical_atom_name("HSD", "CY") == ("ACE", "C") and canonical_atom_name("THY", "C5M") == ("DT", "C7")
    cfg = parse_radius_config("name: t\ntypes:\nX 1.5 polar # c\natoms:\nala cb X\n")
    assert cfg.radius("ALA", "CB") == 1.5 and protor().radius("HIE", "CB") == 1.88
    with pytest.raises(KeyError):
        cfg.radius("ALA", "ZZ")


def test_selection_language():
    assert split_command(", name CA") == ("name_CA", "name CA") and split_command("a, b")[0] == "a"
    assert len(select("name ABCDE+CA+ZZZZZ").warnings) == 2
    with pytest.raises(ValueError):
        select("resi 10-")
    for bad in ("missing_comma", "name CA-CB", "name CA)", "", "(name CA"):
        with pytest.raises(ValueError):
            select(bad)


def test_frames():
    assert frame_numbers("1:9:2", 6) == (1, 6, 2) and frame_numbers("-1", 6) == (5, 6, 1) and frame_numbers(":", None) == (0, None, 1)
    for bad in ("9", "6:", "0:3:0"):
        with pytest.raises(ValueError):
            frame_numbers(bad, 6)


def series(spark, values):
    return spark.createDataFrame([("f", 0, i, float(v)) for i, v in enumerate(values)], "feature string, idx int, frame int, value double")


def test_series(spark):
    s = T.summarize(series(spark, [0, 2, 1, 3]), 1.5).first()
    assert (s["mean"], s.variance, s.exposure_frequency, s.transitions) == (1.5, 1.25, 0.5, 3)
    k = T.kinetics(series(spark, [2] * 3 + [-1] * 4 + [2] * 5 + [-1] * 2)).first()
    assert (k.buried_dwell, k.exposed_dwell, k.transitions) == (4, 5, 3)
    assert T.kinetics(series(spark, [2, 2, -1, -1])).first().exposed_dwell is None
    u = T.uncertainty(series(spark, [5.0] * 50), 10).first()
    assert u.tau == 1 and u.standard_error == 0
    assert T.uncertainty(series(spark, [1, 2, 3]), 10).first().tau is None


def test_embedding(spark):
    x = np.random.default_rng(3).standard_normal((40, 5))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    e = SasaFingerprintEmbedder(2).fit(df, 5)
    got = np.array([r.embedding for r in e.transform(df).collect()])
    c = x - x.mean(axis=0)
    assert np.allclose(np.sort(np.linalg.norm(got, axis=0))[::-1], np.linalg.svd(c)[1][:2])
    with pytest.raises(ValueError):
        SasaFingerprintEmbedder().transform(df)


def test_xyz_lines_compute_points_once(spark):
    """Counts, numbers and lines read the points from one table."""
    from rollprobe.sources import sinks

    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f, a, k, float(a), float(k), float(f)) for f in (0, 1) for a in range(5 + f) for k in range(3)]
    points = spark.createDataFrame(rows, "frame int, atom int, k int, px double, py double, pz double").mapInArrow(watch, "frame int, atom int, k int, px double, py double, pz double")
    got = sorted((r.frame, r.ord, r.value) for r in sinks.xyz_lines(points).collect())
    assert seen.value == len(rows)
    own = {f: [f"X {float(a):.3f} {float(k):.3f} {float(g):.3f}" for g, a, k, *_ in rows if g == f] for f in (0, 1)}
    own[0] += own[0][:1] * 3
    assert got == [(f, i - 2, v) for f in (0, 1) for i, v in enumerate(["18", f"frame {f}", *own[f]])]
