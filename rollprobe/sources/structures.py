"""Structure files as DataFrames: PDB, mmCIF, PSF; radius tables; topologies joined with frames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import RadiusConfig, class_column, element_column, mass_element_column, parse_radius_config, protor, radius_column
from ..segments import running
from .records import altloc_filter, altloc_letter_filter, residue_runs
from .texts import atom_site, lines_of, loop_rows, read_lines  # noqa: F401
from .trajectories import dcd_bytes, read_dcd, read_xtc, write_dcd, write_xtc  # noqa: F401


def _number(c) -> F.Column:
    return F.expr(f"cast(trim(substring(value, {c[0]}, {c[1]})) as double)")


def read_pdb(spark: SparkSession, path: str, hetatm: bool = False, hydrogen: bool = False, join_models: bool = False, align: bool = False) -> DataFrame:
    """Atoms of PDB files, see :func:`pdb_atoms`."""
    return pdb_atoms(read_lines(spark, path), hetatm, hydrogen, join_models, align)


def pdb_atoms(rows: DataFrame, hetatm: bool = False, hydrogen: bool = False, join_models: bool = False, align: bool = False) -> DataFrame:
    """Atoms of the lines (structure, line, value) of PDB files, with the ``line`` they came from.

    ``align`` keeps every record (no model, location, hetero or hydrogen rule), so that rows match a trajectory's atoms;
    short lines and non-numeric coordinates raise on use.
    """
    begins = F.substring("value", 1, 5) == "MODEL"
    rows = rows.where(begins | F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    rows = running(rows, ("structure",), "line", {"model": ("sum", begins.cast("long"))}).where(~begins)
    if not join_models and not align:
        rows = rows.where("model <= 1")
    piece = lambda a, n: F.trim(F.substring("value", a, n))
    xyz = [F.coalesce(_number((31 + 8 * i, 8)), F.raise_error(F.concat(F.lit("bad coordinate in line "), F.col("line").cast("string"))).cast("double")).alias(c) for i, c in enumerate("xyz")]
    atoms = rows.select(
        "structure", "line", "model", piece(1, 6).alias("record"), piece(13, 4).alias("atom_name"), F.substring("value", 17, 1).alias("altloc"), piece(18, 3).alias("residue_name"), piece(22, 1).alias("chain"),
        (piece(23, 4) if align else piece(23, 5)).alias("residue_label"), piece(73, 4).alias("segment"), piece(77, 2).alias("el"), *xyz,
    )
    atoms = atoms.withColumn("element", element_column(F.col("el"), F.col("atom_name"))).withColumn("is_het", F.col("record") == "HETATM").withColumn("is_h", F.col("element").isin("H", "D")).withColumn("residue_number", _residue_number())
    if not align:
        if not hetatm:
            atoms = atoms.where(~F.col("is_het"))
        if not hydrogen:
            atoms = atoms.where(~F.col("is_h"))
        atoms = altloc_filter(atoms, ["structure", "model", "chain", "residue_label", "residue_name", "atom_name"])
    return _numbered(atoms, ["model", "chain", "residue_label", "residue_name"])


def _residue_number():
    """The number in a residue label; null where it has none."""
    digits = F.regexp_extract("residue_label", r"(-?\d+)", 1)
    return F.when(digits != "", digits).cast("int")


def _numbered(atoms: DataFrame, key: list[str]) -> DataFrame:
    return residue_runs(atoms, key, within=("structure",), order="line", number="atom").drop("el", "altloc")


def read_mmcif(spark: SparkSession, path: str, hetatm: bool = False, hydrogen: bool = False, join_models: bool = False, align: bool = False) -> DataFrame:
    """Atoms of the ``_atom_site`` loop of mmCIF files, by author names."""
    return _cif_atoms(loop_rows(read_lines(spark, path), "_atom_site"), hetatm, hydrogen, join_models, align)


def mmcif_atoms(text: DataFrame, hetatm: bool = False, hydrogen: bool = False, join_models: bool = False, align: bool = False) -> DataFrame:
    """Atoms of whole mmCIF texts (structure, value), or of their lines (structure, line, value)."""
    return _cif_atoms(loop_rows(text if "line" in text.columns else lines_of(text), "_atom_site"), hetatm, hydrogen, join_models, align)


def _cif_atoms(rows: DataFrame, hetatm: bool, hydrogen: bool, join_models: bool, align: bool) -> DataFrame:
    """``align`` keeps every row, so that they match a trajectory's atoms."""
    held = lambda c: F.get("values", F.array_position("heads", c).cast("int") - 1)
    plain = lambda c: F.when(~F.coalesce(held(c), F.lit("")).isin("?", "."), F.coalesce(held(c), F.lit(""))).otherwise("")
    either = lambda a, b: F.when(F.array_contains("heads", a), plain(a)).otherwise(plain(b))
    refuse = lambda c: F.raise_error(F.concat(F.lit(f"bad {c} in row "), F.col("row").cast("string"), F.lit(" of "), "structure"))
    atoms = rows.select(
        "structure", F.col("row").alias("line"), plain("pdbx_PDB_model_num").alias("model"), plain("group_PDB").alias("record"), either("auth_atom_id", "label_atom_id").alias("atom_name"), plain("label_alt_id").alias("altloc"),
        either("auth_comp_id", "label_comp_id").alias("residue_name"), either("auth_asym_id", "label_asym_id").alias("chain"), F.concat(either("auth_seq_id", "label_seq_id"), plain("pdbx_PDB_ins_code")).alias("residue_label"),
        F.lit("").alias("segment"), plain("type_symbol").alias("el"), *(held(f"Cartn_{c}").alias(c) for c in "xyz"), "row",
    )
    for c in "xyz":
        atoms = atoms.withColumn(c, F.coalesce(F.expr(f"try_cast({c} as double)"), refuse(f"Cartn_{c}").cast("double")))
    model = F.when(F.col("model") == "", 1).otherwise(F.coalesce(F.expr("try_cast(model as int)"), refuse("model").cast("int")))
    atoms = atoms.withColumn("model", model).withColumn("altloc", F.when(F.col("altloc") == "", " ").otherwise(F.col("altloc"))).drop("row")
    atoms = atoms.withColumn("element", element_column(F.col("el"), F.col("atom_name"))).withColumn("is_het", F.col("record") == "HETATM").withColumn("is_h", F.col("element").isin("H", "D")).withColumn("residue_number", _residue_number())
    if align:
        return _numbered(atoms, ["model", "chain", "residue_label", "residue_name"])
    if not join_models:
        first = atoms.groupBy("structure").agg(F.min_by("model", "line").alias("first"))
        atoms = atoms.join(first, "structure").where("model = first").drop("first")
    if not hetatm:
        atoms = atoms.where(~F.col("is_het"))
    if not hydrogen:
        atoms = atoms.where(~F.col("is_h"))
    atoms = altloc_letter_filter(atoms, ["structure", "model", "chain", "residue_label"], ["structure", "model", "chain", "residue_label", "residue_name", "atom_name"])
    return _numbered(atoms, ["model", "chain", "residue_label", "residue_name"])


def read_psf(spark: SparkSession, path: str, align: bool = True) -> DataFrame:
    """Topology rows of PSF files, see :func:`psf_atoms`; they always match a trajectory's atoms."""
    return psf_atoms(read_lines(spark, path))


def psf_atoms(rows: DataFrame) -> DataFrame:
    """Topology rows of the lines (structure, line, value) of PSF files (no coordinates); the element comes from the mass."""
    head = F.when(F.col("value").contains("!NATOM"), F.struct(F.col("line"), F.regexp_extract("value", r"(\d+)", 1).cast("int").alias("n")))
    rows = running(rows, ("structure",), "line", {"head": ("min", head)})
    body = rows.where("line > head.line and line <= head.line + head.n").withColumn("f", F.split(F.trim("value"), r"\s+"))
    atoms = body.select("structure", "line", F.get("f", F.lit(1)).alias("segment"), F.get("f", F.lit(2)).alias("residue_label"), F.get("f", F.lit(3)).alias("residue_name"), F.get("f", F.lit(4)).alias("atom_name"), F.get("f", F.lit(7)).cast("double").alias("mass"), F.lit("").alias("chain"), F.lit("").alias("el"), F.lit(" ").alias("altloc"))
    atoms = atoms.withColumn("element", F.coalesce(mass_element_column(F.col("mass"), F.col("atom_name")), element_column(F.lit(""), F.col("atom_name"))))
    atoms = atoms.withColumn("residue_number", _residue_number()).withColumn("is_h", F.col("element").isin("H", "D")).withColumn("is_het", F.lit(False))
    return _numbered(atoms, ["segment", "residue_label", "residue_name"])


def assign_radii(atoms: DataFrame, config: RadiusConfig | None = None, any_residue: bool = True, unknown: str = "guess", fallback: float = 0.0) -> DataFrame:
    """radius and atom_class; ``unknown`` says what happens to atoms that nothing gives a radius: guess, skip or halt."""
    config = protor() if config is None else config
    args = F.col("residue_name"), F.col("atom_name"), F.col("element")
    out = atoms.withColumn("radius", radius_column(config, *args, any_residue=any_residue)).withColumn("atom_class", class_column(config, *args))
    if unknown == "skip":
        return out.where("radius is not null")
    if unknown == "halt":
        return out.withColumn("radius", F.coalesce("radius", F.raise_error(F.concat(F.lit("no radius for "), "residue_name", F.lit(" "), "atom_name")).cast("double")))
    return out.withColumn("radius", F.coalesce("radius", F.lit(float(fallback))))


def load_radius_config(path: str, first_wins: bool = False) -> RadiusConfig:
    with open(path, encoding="utf-8") as f:
        return parse_radius_config(f.read(), first_wins)


READERS = {"psf": read_psf, "cif": read_mmcif, "mmcif": read_mmcif, "pdb": read_pdb}


def read_topology(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by suffix; PDB where it says nothing else."""
    return READERS.get(path.rsplit(".", 1)[-1].lower(), read_pdb)(spark, path, **options)


def with_coordinates(atoms: DataFrame, coords: DataFrame, check: bool = False) -> DataFrame:
    """Topology rows at every frame, joined by structure (where both have it) and atom number.

    ``check`` refuses, in one pass over each table, frames with another number of atoms than the topology.
    """
    by = [c for c in ("structure", "atom") if c in atoms.columns and c in coords.columns]
    if check:
        own = [c for c in by if c != "atom"]
        frames = coords.groupBy(*own, "frame").agg(F.count("*").alias("n"))
        there = atoms.groupBy(*own).agg(F.count("*").alias("m"))
        bad = (frames.join(there, own, "left") if own else frames.crossJoin(there)).where("n <> coalesce(m, 0)").first()
        if bad is not None:
            raise ValueError(f"frame {bad.frame} has {bad.n} atoms, the topology {bad.m}")
    return coords.select(*by, "frame", "x", "y", "z").join(atoms.drop("x", "y", "z", "frame"), by)


def radius_config(path: str | None = None, first_wins: bool = False) -> RadiusConfig:
    """The table given, else the one named by ROLLPROBE_RADII, else the built-in one."""
    path = path or os.environ.get("ROLLPROBE_RADII")
    return load_radius_config(path, first_wins) if path else protor()
