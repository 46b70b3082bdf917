"""Topologies with their frames: opened together, checked against each other, and analysed over chosen frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chemistry import RadiusConfig
from .operators import aggregate as A
from .operators.kernels import shrake_rupley
from .operators.neighbors import keys_of
from .sources.records import frame_slice
from .sources.structures import assign_radii, radius_config, read_topology
from .sources.trajectories import atoms_of, frame_count, read_trajectory


def open_trajectory(spark: SparkSession, topology: str, coordinates: str, frames: str = ":", config: RadiusConfig | None = None, unknown: str = "guess", hetatm: bool = False, hydrogen: bool = False, check: bool = True) -> DataFrame:
    """Atoms of a topology (PDB, mmCIF or PSF) at the chosen frames of a DCD or XTC file or folder.

    A topology file holds for all trajectories; of several, each holds for the trajectory of its name. ``check`` compares
    the number of its atoms with the trajectories' headers and refuses others: without it atoms that one side lacks are
    left out. Hetero atoms and hydrogens are dropped, unless asked for, after atoms and coordinates have met.
    """
    config = radius_config(first_wins=True) if config is None else config
    top = read_topology(spark, topology, align=True)
    counts = {r.structure: r.n for r in top.groupBy("structure").agg(F.count("*").alias("n")).collect()}  # one row a topology file
    if check:
        for name, n in atoms_of(coordinates).items():
            own = next(iter(counts.values())) if len(counts) == 1 else counts.get(name)
            if own != n:
                raise ValueError(f"{name} has {n} atoms a frame, its topology {own or 0}")
    single = coordinates.rsplit(".", 1)[-1].lower() in ("dcd", "xtc")
    coords = frame_slice(read_trajectory(spark, coordinates), frames, frame_count(coordinates) if single else None)
    atoms = assign_radii(top, config, any_residue=False, unknown=unknown).drop("x", "y", "z", "frame", "line", "model")
    by = ["atom"] if len(counts) == 1 else ["structure", "atom"]
    out = coords.join(atoms.drop("structure") if len(counts) == 1 else atoms, by)
    for c, keep in (("is_het", hetatm), ("is_h", hydrogen)):
        out = out if keep else out.where(f"not {c}")
    return out


@dataclass
class TrajectoryResult:
    """Lazy tables: areas by frame, and their means over the frames."""

    atom: DataFrame

    @property
    def total(self) -> DataFrame:
        return A.totals(self.atom)

    @property
    def residue(self) -> DataFrame:
        return A.residue_sums(self.atom)

    @property
    def mean_total(self) -> DataFrame:
        """One row a structure: frames, mean_total_sasa."""
        own = [k for k in keys_of(self.atom) if k != "frame"]
        return self.total.groupBy(*own).agg(F.count("*").alias("frames"), F.avg("total_sasa").alias("mean_total_sasa"))

    @property
    def mean_residue(self) -> DataFrame:
        own = [k for k in keys_of(self.atom) if k != "frame"]
        return self.residue.groupBy(*own, "residue_id").agg(F.avg("residue_sasa").alias("mean_residue_sasa"))


class TrajectoryAnalysis:
    """Areas over a trajectory (atoms with radii and a frame column); ``select`` leaves other atoms out altogether."""

    def __init__(self, atoms: DataFrame, select: Column | None = None, probe: float = 1.4, n_points: int = 100) -> None:
        self.atoms, self.probe, self.n_points = atoms if select is None else atoms.where(select), probe, n_points

    def run(self, start: int | None = None, stop: int | None = None, step: int | None = None, frames: Sequence[int] | None = None) -> TrajectoryResult:
        """Frames by a slice (negative numbers count from the end, a negative step is refused) or by number, not both."""
        if frames is not None and any(v is not None for v in (start, stop, step)):
            raise ValueError("pass either frames or start, stop and step")
        numbers = [start, stop] if frames is None else list(frames)
        n = (self.atoms.agg(F.max("frame")).first()[0] or -1) + 1 if any(v is not None and v < 0 for v in numbers) else None
        if frames is not None:
            chosen = [v + n if v < 0 else v for v in map(int, frames)]
            if any(v < 0 for v in chosen):
                raise ValueError("a frame is out of range")
            return TrajectoryResult(shrake_rupley(self.atoms.where(F.col("frame").isin(chosen)), self.probe, self.n_points))
        step = 1 if step is None else step
        if step <= 0:
            raise ValueError("the step must be positive")
        low = 0 if start is None else max(0, start + n) if start < 0 else start
        keep = (F.col("frame") >= low) & ((F.col("frame") - low) % step == 0)
        if stop is not None:
            keep = keep & (F.col("frame") < (stop + n if stop < 0 else stop))
        return TrajectoryResult(shrake_rupley(self.atoms.where(keep), self.probe, self.n_points))

