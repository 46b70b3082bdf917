"""Command line: ``python -m rollprobe [options] topology [coordinates.dcd] --out folder``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import SasaEngine
from .operators.aggregate import totals
from .plans.selection import select, select_all, unmatched_items
from .sources.sinks import SINKS, point_lines, summary_row, trajectory_rows, write, xyz_lines, padded_points
from .sources.structures import assign_radii, radius_config, read_topology
from .sources.trajectories import write_dcd
from .trajectory import open_trajectory


def whole(text: str) -> int:
    """A positive whole number, and nothing behind it."""
    n = int(text)
    if n < 1:
        raise ValueError
    return n


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rollprobe", description="Solvent-accessible surface area of structures and trajectories.")
    p.add_argument("topology", help="PDB, mmCIF or PSF file, folder or pattern")
    p.add_argument("coordinates", nargs="?", help="DCD or XTC file or folder; frames of the topology's atoms")
    p.add_argument("--out", required=True, help="folder of the reports")
    p.add_argument("--algorithm", choices=("sr", "lr"), default="sr")
    p.add_argument("--probe", type=float, default=1.4)
    p.add_argument("--resolution", type=whole, help="points (sr, 100) or slices (lr, 20)")
    p.add_argument("--precision", choices=("fp64", "fp32"), default="fp64")
    p.add_argument("--hetatm", action="store_true")
    p.add_argument("--hydrogen", action="store_true")
    p.add_argument("--join-models", action="store_true")
    p.add_argument("--select", action="append", default=[], help="name, expression; measured on the result")
    p.add_argument("--filter", help="expression; other atoms take no part at all")
    p.add_argument("--frames", default=":", help="n, a:b or a:b:step; numbers below zero count from the end of a file")
    p.add_argument("--config-file", help="radius table")
    p.add_argument("--unknown", choices=("guess", "skip", "halt"), default="guess")
    p.add_argument("--format", action="append", choices=(*SINKS, "points"), help="may be given several times; log if absent")
    p.add_argument("--residue", action="store_true", help="areas of residues, frame by frame")
    p.add_argument("--classes", action="store_true", help="areas of polar, apolar and unknown atoms, of each selection too")
    p.add_argument("--summary", action="store_true", help="one row over all frames for each table asked for")
    p.add_argument("--surface-points", choices=("txt", "xyz", "dcd"), help="the exposed points, in one of these formats")
    p.add_argument("--surface-resolution", type=whole, help="points of a sphere for --surface-points; as --resolution if absent")
    p.add_argument("--no-check", action="store_true", help="let topology and frames differ in their atoms")
    return p


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """Write the reports asked for; returns warnings."""
    a = arguments().parse_args(argv)
    config = radius_config(a.config_file, first_wins=a.coordinates is not None)
    if len(a.select) > 32:
        raise ValueError("at most 32 selections")
    if a.coordinates:
        atoms = open_trajectory(spark, a.topology, a.coordinates, a.frames, config, a.unknown, a.hetatm, a.hydrogen, not a.no_check)
    else:
        options = {} if a.topology.lower().endswith(".psf") else {"hetatm": a.hetatm, "hydrogen": a.hydrogen, "join_models": a.join_models}
        atoms = assign_radii(read_topology(spark, a.topology, **options), config, unknown=a.unknown)
    warnings = [w for s in select_all(a.select, atoms) for w in s.warnings] + [f"{r.selection}: {r.item} matches no atom" for r in unmatched_items(atoms, a.select).collect()]
    if a.filter:
        atoms = atoms.where(select(a.filter, atoms).column)
    engine = SasaEngine(spark, a.probe, a.resolution or 100 if a.algorithm == "sr" else 100, a.resolution or 20 if a.algorithm == "lr" else 20, a.precision)
    result = (engine.sasa if a.algorithm == "sr" else engine.lee_richards)(atoms, a.select)
    formats = tuple(a.format or ["log"])
    write(result.atom, a.out, tuple(f for f in formats if f != "points"))
    kind = a.surface_points or ("txt" if "points" in formats else None)
    if kind:
        from .operators.kernels import surface_points

        points = surface_points(engine.framed(atoms), a.probe, a.surface_resolution or engine.n_points)
        if kind == "dcd":
            write_dcd(padded_points(points).select(*(c for c in ("structure",) if c in points.columns), "frame", "nth", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z")), f"{a.out}/points", "nth")
        else:
            (point_lines if kind == "txt" else xyz_lines)(points).sort(*(c for c in ("structure", "frame", "ord") if c in points.columns or c == "ord" and kind == "xyz")).select("value").write.mode("overwrite").text(f"{a.out}/points")
    table = lambda df, name: df.write.mode("overwrite").option("header", True).csv(f"{a.out}/{name}")
    shapes = [*(["residue"] if a.residue else []), *(["class"] if a.classes else []), *(["class_selection"] if a.classes and a.select else [])]
    for shape in shapes:
        table(trajectory_rows(result.atom, shape, result.masks), shape)
    if a.summary:
        for shape in ("total", *(["selection"] if a.select else []), *(s for s in shapes if s != "residue")):
            table(summary_row(result.atom, shape, result.masks, config), f"summary_{shape}")
    if a.select:
        trajectory_rows(result.atom, "selection", result.masks).write.mode("overwrite").option("header", True).csv(f"{a.out}/selection")
    if a.coordinates:
        totals(result.atom).write.mode("overwrite").option("header", True).csv(f"{a.out}/trajectory")
        summary_row(result.atom, config=config).write.mode("overwrite").option("header", True).csv(f"{a.out}/frames")
    return warnings


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("rollprobe").getOrCreate()
    for w in run(spark, sys.argv[1:]):
        print(f"warning: {w}", file=sys.stderr)
    spark.stop()


if __name__ == "__main__":
    main()
