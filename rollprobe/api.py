"""Front door: one engine object, one-shot functions, and a result holder of lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chemistry import RadiusConfig, backbone_column, canonical_atom_name, canonical_residue_name, element_from_mass
from .functions.points import sphere_points as fibonacci_sphere_points
from .operators import aggregate as A
from .operators.embedding import SasaFingerprintEmbedder
from .operators.features import interface, interface_residues, relative, relative_summary, shielding
from .operators.kernels import lee_richards as _lr
from .operators.kernels import shrake_rupley as _sr
from .operators.kernels import surface_points
from .operators.neighbors import keys_of
from .operators.timeseries import SUMMARY_STATISTIC_NAMES, flatten, kinetics, summarize, uncertainty
from .plans.selection import select_all
from .scratch import written
from .sources.structures import assign_radii, load_radius_config, read_topology

__version__ = "0.1.0"
__all__ = ["A", "RadiusConfig", "SUMMARY_STATISTIC_NAMES", "SasaEngine", "SasaFingerprintEmbedder", "SasaResult", "assign_radii", "canonical_atom_name", "canonical_residue_name", "element_from_mass", "extract_features", "feature_metadata", "fibonacci_sphere_points", "flatten", "from_arrays", "interface", "interface_residues", "kinetics", "lee_richards", "load_radius_config", "read_topology", "sasa", "shielding", "summarize", "surface_points", "uncertainty"]


def from_arrays(spark: SparkSession, positions: np.ndarray, radii: np.ndarray, residue_ids: np.ndarray | None = None) -> DataFrame:
    """Atoms from arrays (atoms x 3 or frames x atoms x 3); refuses bad shapes, non-finite values, negative radii."""
    import pandas as pd

    xyz, r = np.asarray(positions, np.float64), np.asarray(radii, np.float64)
    if xyz.ndim == 2:
        xyz = xyz[None]
    if xyz.ndim != 3 or xyz.shape[2] != 3 or r.shape != (xyz.shape[1],):
        raise ValueError("positions must be (frames, atoms, 3) and radii (atoms,)")
    if not np.isfinite(xyz).all() or not np.isfinite(r).all() or (r < 0).any():
        raise ValueError("positions must be finite and radii finite and not negative")
    f, n, _ = xyz.shape
    ids = np.zeros(n, int) if residue_ids is None else np.asarray(residue_ids)
    pdf = pd.DataFrame({"frame": np.repeat(np.arange(f), n), "atom": np.tile(np.arange(n), f), "x": xyz[..., 0].ravel(), "y": xyz[..., 1].ravel(), "z": xyz[..., 2].ravel(), "radius": np.tile(r, f), "residue_id": np.tile(ids, f)})
    return spark.createDataFrame(pdf, "frame int, atom int, x double, y double, z double, radius double, residue_id int")


@dataclass
class SasaResult:
    """Lazy tables of one calculation; ``frames`` are those asked for, with or without atoms."""

    atom: DataFrame
    names: tuple[str, ...] = ()
    masks: dict[str, Column] | None = None
    frames: DataFrame | None = None

    @property
    def total(self) -> DataFrame:
        return A.totals(self.atom, spine=self.frames)

    @property
    def residue(self) -> DataFrame:
        return A.residue_sums(self.atom)

    @property
    def selection(self) -> DataFrame:
        sums = A.mask_sums(self.atom, self.masks or {})
        return sums if self.frames is None else A.with_spine(sums, self.frames, keys_of(self.frames), tuple(self.masks or {}))


class SasaEngine:
    """Holds the parameters; every call returns lazy DataFrames.

    ``check`` refuses coordinates that are null or not finite and radii below zero in the run that uses them, with no pass of
    its own.
    """

    def __init__(self, spark: SparkSession, probe_radius: float = 1.4, n_points: int = 100, n_slices: int = 20, precision: str = "fp64", check: bool = True) -> None:
        if precision not in ("fp64", "fp32"):
            raise ValueError("precision is fp64 or fp32")
        if probe_radius < 0 or n_points < 1 or n_slices < 1:
            raise ValueError("probe, points and slices must be positive")
        self.spark, self.probe, self.n_points, self.n_slices, self.single = spark, probe_radius, n_points, n_slices, precision == "fp32"
        self.checked = check

    def __enter__(self) -> SasaEngine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open."""

    def framed(self, atoms: DataFrame) -> DataFrame:
        return _framed(atoms)

    def check(self, atoms: DataFrame) -> None:
        """Refuse coordinates that are null or not finite and radii that are below zero; one pass over the atoms."""
        n = atoms.where(_odd()).count()
        if n:
            raise ValueError(f"{n} atoms have coordinates that are not finite or radii below zero")

    def _ready(self, atoms: DataFrame) -> DataFrame:
        if not self.checked:
            return _framed(atoms)
        refuse = F.raise_error(F.concat(F.lit("coordinates that are not finite or a radius below zero at atom "), F.coalesce(F.col("atom").cast("string"), F.lit("without a number"))))
        return _framed(atoms).withColumn("radius", F.when(_odd(), refuse.cast("double")).otherwise(F.col("radius")))

    def _masks(self, atoms: DataFrame, select: list[str] | None) -> dict[str, Column]:
        return {s.name: s.column for s in select_all(select or [], atoms)}

    def sasa(self, atoms: DataFrame, select: list[str] | None = None, centers: Column | None = None, frames: DataFrame | None = None) -> SasaResult:
        """Shrake-Rupley areas; ``frames`` (the keys) gives frames a total of 0 where they have no atoms."""
        masks = self._masks(atoms, select)
        return SasaResult(_sr(self._ready(atoms), self.probe, self.n_points, centers, single=self.single), tuple(masks), masks, frames)

    def lee_richards(self, atoms: DataFrame, select: list[str] | None = None, centers: Column | None = None, frames: DataFrame | None = None) -> SasaResult:
        masks = self._masks(atoms, select)
        return SasaResult(_lr(self._ready(atoms), self.probe, self.n_slices, centers), tuple(masks), masks, frames)


def _odd() -> Column:
    """Whether a coordinate or the radius is null or not finite, or the radius below zero."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return odd("x") | odd("y") | odd("z") | odd("radius") | (F.col("radius") < 0)


def _framed(atoms: DataFrame) -> DataFrame:
    return atoms if "frame" in atoms.columns else atoms.withColumn("frame", F.lit(0))


def sasa(atoms: DataFrame, **kw) -> SasaResult:
    return SasaEngine(atoms.sparkSession, **kw).sasa(atoms)


def lee_richards(atoms: DataFrame, **kw) -> SasaResult:
    return SasaEngine(atoms.sparkSession, **kw).lee_richards(atoms)


def extract_features(atoms: DataFrame, masks: dict[str, Column] | None = None, probe: float = 1.4, n_points: int = 100, interface_of: tuple[Column, Column] | None = None, shielded: tuple[Column, Column] | None = None, cutoff: float = 0.25) -> DataFrame:
    """Long rows (structure, feature, idx, frame, value) of every frame.

    Totals, residue areas, relative areas and their summary, backbone and side chains where the atoms have names, the
    masks; with ``interface_of`` (two groups) and ``shielded`` (target, shield) those areas too.
    """
    atoms = _framed(atoms)
    keys = keys_of(atoms)
    area = written(_sr(atoms, probe, n_points))
    own = [k for k in keys if k != "frame"]
    row = lambda df, feature, value, idx=F.lit(0): df.select(*own, F.lit(feature).alias("feature"), idx.cast("int").alias("idx"), "frame", F.col(value).cast("double").alias("value"))
    res = A.residue_sums(area)
    parts = [row(A.totals(area), "total_sasa", "total_sasa"), row(res, "residue_sasa", "residue_sasa", F.col("residue_id"))]
    if "residue_name" in atoms.columns:
        rsa = relative(res, area.where("residue_id >= 0").groupBy(*own, "residue_id").agg(F.min("residue_name").alias("residue_name")))
        parts.append(row(rsa.where("rsa is not null"), "rsa", "rsa", F.col("residue_id")))
        short = relative_summary(rsa, cutoff)
        parts += [row(short, c, c) for c in ("mean_rsa", "exposed_fraction", "buried_fraction")]
    chosen = dict(masks or {})
    if "atom_name" in atoms.columns:
        bone = backbone_column(F.col("atom_name"))
        chosen = {"backbone_sasa": bone, "sidechain_sasa": ~bone} | chosen
    if chosen:
        sums = A.mask_sums(area, chosen)
        parts += [row(sums, n, n) for n in chosen]
    if interface_of is not None:
        both = interface(atoms, *interface_of, probe, n_points)
        parts += [row(both, c, c) for c in both.columns if c not in keys]
    if shielded is not None:
        both = shielding(atoms, *shielded, probe, n_points)
        parts += [row(both, f"glycan_{c}", c) for c in both.columns if c not in keys]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def feature_metadata(probe: float = 1.4, n_points: int = 100, cutoff: float = 0.25, threshold: float = 0.0) -> dict[str, object]:
    """What the numbers of :func:`extract_features` mean."""
    return {"units": "square angstroms", "algorithm": "Shrake-Rupley", "probe_radius": probe, "n_points": n_points, "rsa_cutoff": cutoff, "exposure_threshold": threshold, "max_asa": "extended residues, ProtOr radii", "fractions": "areas are divided by at least 1e-12"}
