"""Files read in many blocks give the lines, atoms and loops of the whole file."""

import random

import pytest

from rollprobe import segments
from rollprobe.sources import texts
from rollprobe.sources.structures import read_mmcif, read_pdb, read_psf


@pytest.fixture
def blocks(spark):
    """Blocks of a few hundred bytes, so that a small file is read by many tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def pdb(i, model, r):
    return f"{'HETATM' if i % 9 == 0 else 'ATOM':<6}{i:5d}  {r.choice(['N', 'CA', 'C', 'O', 'H'])!s:<3}{' AB'[i % 3]}ALA A{i // 5:4d}    {r.uniform(-9, 9):8.3f}{model:8.3f}{i:8.3f}  1.00  0.00"


def test_lines(spark, tmp_path, blocks):
    r = random.Random(1)
    files = {f"f{k}": [f"line {i} " + "x" * r.randint(0, 200) for i in range(n)] for k, n in enumerate((0, 1, 40, 7, 100))}
    for name, lines in files.items():
        (tmp_path / f"{name}.txt").write_text("".join(x + "\n" for x in lines))
    got = texts.read_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    assert sorted((x.structure, x.line, x.value) for x in got.collect()) == sorted((f, i, v) for f, lines in files.items() for i, v in enumerate(lines))


def test_running(spark, monkeypatch):
    r = random.Random(2)
    rows = [(g, i, r.randint(-5, 5)) for g in "ab" for i in r.sample(range(300), 90)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    for size in (1, 7, 1000):
        got = {(x.g, x.i): (x.total, x.least) for x in segments.running(df, ("g",), "i", {"total": ("sum", df.v), "least": ("min", df.v)}, size).collect()}
        for g, i, _ in rows:
            before = [v for h, j, v in rows if h == g and j <= i]
            assert got[g, i] == (sum(before), min(before))


@pytest.mark.parametrize("segment", [8, 1 << 16])
def test_pdb_and_psf_in_blocks(spark, tmp_path, monkeypatch, segment, request):
    monkeypatch.setattr(segments, "SEGMENT", segment)
    r = random.Random(3)
    for name in ("one", "two"):
        lines = ["HEADER"]
        for model in (1, 2, 3):
            lines += [f"MODEL {model:8d}", *(pdb(i, model, r) for i in range(40)), "ENDMDL"]
        (tmp_path / f"{name}.pdb").write_text("\n".join(lines) + "\nEND\n")
    (tmp_path / "t.psf").write_text("PSF\n\n 2 !NTITLE\n a\n b\n\n 90 !NATOM\n" + "".join(f" {i + 1} S{i // 50} {i // 7} ALA CA CT1 0.0 12.011 0\n" for i in range(90)) + "\n 3 !NBOND\n 1 2 3 4\n")
    read = {"first": lambda: read_pdb(spark, str(tmp_path / "*.pdb"), hetatm=True), "joined": lambda: read_pdb(spark, str(tmp_path / "*.pdb"), join_models=True, hydrogen=True), "aligned": lambda: read_pdb(spark, str(tmp_path / "one.pdb"), align=True), "psf": lambda: read_psf(spark, str(tmp_path / "t.psf"))}
    whole = {k: sorted(map(str, f().collect())) for k, f in read.items()}
    request.getfixturevalue("blocks")
    assert spark.read.text(str(tmp_path / "one.pdb")).rdd.getNumPartitions() > 4
    assert {k: sorted(map(str, f().collect())) for k, f in read.items()} == whole
    assert len(whole["aligned"]) == 120 and len(whole["psf"]) == 90
    atoms = read["aligned"]().orderBy("line").collect()
    assert [x.atom for x in atoms] == list(range(120)) and [x.model for x in atoms] == [1 + i // 40 for i in range(120)] and [x.line for x in atoms] == [2 + i + 2 * (i // 40) for i in range(120)]
    assert [int(x.residue_label) for x in read["psf"]().orderBy("atom").collect()] == [i // 7 for i in range(90)]


CIF = "data_x\n_entry.id 'x y'\n_entry.text\n;loop_\n_atom_site.fake\n;\nloop_\n_first.a\n_first.b\n1 2\n3 4\n"


def cif(n, r, end):
    rows = []
    for i in range(n):
        cells = [str(i), r.choice(["'a b'", '"O5\'"', "CA", "?", "."]), f"{r.uniform(-9, 9):.3f}", r.choice(["x", "'_quoted'", "loop"])]
        if r.random() < 0.2:
            cells[3] = f"\n;text {i}\n_more loop_\n; "
        k = r.randint(1, 4)
        rows.append((" " + "\n" * (r.random() < 0.3)).join(cells) if not cells[3].startswith("\n") else " ".join(cells[:3]) + cells[3])
        if r.random() < 0.1:
            rows.append("# remark loop_ _x")
        if k == 1 and not cells[3].startswith("\n"):
            rows[-1] = rows[-1] + " # tail" if not rows[-1].startswith("#") else rows[-1]
    return CIF + "loop_\n_atom_site.id\n_atom_site.Name\n_atom_site.x\n_atom_site.note\n" + "\n".join(rows) + end


@pytest.mark.parametrize("segment", [8, 1 << 16])
def test_loops_in_blocks(spark, tmp_path, monkeypatch, blocks, segment):
    monkeypatch.setattr(segments, "SEGMENT", segment)
    r = random.Random(4)
    ends = ["\n", "\n#\nloop_\n_atom_site.id\n9\n", "\n_after.x 1\n", "\ndata_y\nloop_\n_z.z\n1\n", " stop_\n"]
    for k, end in enumerate(ends):
        (tmp_path / f"c{k}.cif").write_text(cif(60 + k, r, end))
    (tmp_path / "none.cif").write_text("data_x\n_entry.id y\nloop_\n_a.b\n1\n2\n")
    (tmp_path / "single.cif").write_text("data_x\n_atom_site.id 1\n_atom_site.x 2\n")
    got = texts.loop_rows(texts.read_lines(spark, str(tmp_path)), "_atom_site").collect()
    want = []
    for k in range(len(ends)):
        t = texts.atom_site((tmp_path / f"c{k}.cif").read_text())
        want += [(f"c{k}", i, list(t.columns), v) for i, v in enumerate(t.to_numpy().tolist())]
    assert len(want) == 310 and sorted((x.structure, x.row, list(x["heads"]), list(x["values"])) for x in got) == sorted(want)


@pytest.mark.parametrize("text,message", [("loop_\n_atom_site.a\n_atom_site.b\n1 2\n3\n", "3 values for 2 columns"), ("loop_\n_atom_site.a\n1\n;open\n", "does not end"), ("loop_\n_atom_site.a\n_atom_site.b\n1 2 3\nloop_\n_x.y\n1\n", "3 values")])
def test_broken_loops(spark, tmp_path, text, message):
    (tmp_path / "x.cif").write_text(text)
    with pytest.raises(Exception, match=message):
        texts.loop_rows(texts.read_lines(spark, str(tmp_path / "x.cif")), "_atom_site").collect()


def test_bad_coordinates(spark, tmp_path):
    head = "loop_\n" + "".join(f"_atom_site.{c}\n" for c in ("group_PDB", "auth_atom_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z"))
    (tmp_path / "x.cif").write_text(head + "ATOM CA ALA A 1 1.0 ? 2.0\n")
    with pytest.raises(Exception, match="bad Cartn_y"):
        read_mmcif(spark, str(tmp_path / "x.cif")).collect()
    (tmp_path / "y.cif").write_text(head + "ATOM CA ALA A 1 1.0 3 2.0\nATOM CB ALA A 1 1.5 3 2.0\n")
    rows = read_mmcif(spark, str(tmp_path / "y.cif")).orderBy("atom").collect()
    assert [(x.atom_name, x.x, x.element, x.model) for x in rows] == [("CA", 1.0, "C", 1), ("CB", 1.5, "C", 1)] or rows[0].element in ("CA", "C")
