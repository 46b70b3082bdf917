"""Neighbour search: a distance join on tiles of space, which hold all neighbours of their atoms.

Tiles are cubes of a few cells of edge 2 * max(radius + probe) that also hold every atom whose sphere can reach into them, two
to four rows an atom; a kernel, or the search for pairs, solves them one by one. Within a tile a centre is held against the
27 cells around its own, so work grows with atoms, not with pairs of atoms. A few very
large spheres do not make all tiles large: tiles follow the usual radius, large spheres reach into many of them, and as
centres they have (large) tiles of their own. Where space is dense, tiles are cut to fewer cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

KEYS = ("structure", "frame")
CENTRES = 1024  # atoms whose neighbours are looked up at once
TILE = 4  # cells along the edge of a tile, at most
LEAST = 1e-3  # radius that tiles go by where all are smaller
MOST = 20_000  # atoms of a tile on average; above it, tiles have fewer cells


def keys_of(df: DataFrame, *more: str) -> tuple[str, ...]:
    """What keeps atoms apart: structure and frame, as far as the table has them."""
    return *(k for k in KEYS if k in df.columns), *more


def expanded(atoms: DataFrame, probe: float) -> DataFrame:
    return atoms.withColumn("er", F.col("radius") + F.lit(float(probe)))


def tile_sizes(atoms: DataFrame, keys: tuple[str, ...], edge: float | None) -> DataFrame:
    """With what tiles of a key go by: ``cut`` (no larger radius is usual), ``top`` (the largest), ``cells`` along a tile's edge.

    A radius above twice that of nine in ten atoms is not usual. Where ``edge`` gives a bound of the radii, all are usual
    and tiles have ``TILE`` cells, which saves the pass that measures.
    """
    if edge is not None:
        return atoms.withColumns({"cut": F.lit(edge / 2.0), "top": F.lit(edge / 2.0), "cells": F.lit(TILE)})
    span = lambda c: F.max(c) - F.min(c)
    one = atoms.groupBy(*keys).agg(F.max("er").alias("top"), F.percentile_approx("er", 0.9, 1000).alias("usual"), F.count("*").alias("n"), *(span(c).alias(f"span_{c}") for c in "xyz"))
    one = one.withColumn("top", F.greatest("top", F.lit(LEAST))).withColumn("cut", F.least("top", F.greatest(2.0 * F.col("usual"), F.lit(LEAST))))
    volume = F.lit(1.0)
    for c in "xyz":
        volume = volume * (F.col(f"span_{c}") + 2.0 * F.col("cut"))
    fewer = F.lit(1)
    for k in [k for k in (2, TILE) if k > 1]:  # the most cells that keep a tile small enough, by the mean density
        fewer = F.when(F.col("n") * F.pow(2.0 * k * F.col("cut"), F.lit(3.0)) <= MOST * volume, k).otherwise(fewer)
    return atoms.join(one.select(*keys, "cut", "top", fewer.alias("cells")), list(keys))


def tiled(atoms: DataFrame, centers, keys: tuple[str, ...], edge: float | None, also: tuple[str, ...] = ()) -> DataFrame:
    """Atoms of every tile and those that reach into it: keys, large, tx, ty, tz, er, x, y, z, edge, own, and ``also``.

    ``own`` holds all columns of a centre atom in its own tile and is null in copies, so that a copy is a short row.
    ``large`` tells the tiles of large centres from those of usual ones; ``edge`` is twice the largest centre's radius.
    """
    rows = tile_sizes(atoms.withColumn("own", F.when(F.lit(True) if centers is None else centers, F.struct(*[F.col(c) for c in atoms.columns]))), keys, edge)
    kinds = F.when(F.col("top") > F.col("cut"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.withColumn("large", F.explode(kinds)).withColumn("reach", F.when(F.col("large"), F.col("top")).otherwise(F.col("cut"))) if edge is None else rows.withColumns({"large": F.lit(False), "reach": F.col("cut")})
    rows = rows.withColumn("own", F.when(F.col("large") == (F.col("er") > F.col("cut")), F.col("own"))) if edge is None else rows
    rows = rows.withColumn("size", F.col("reach") * 2.0 * F.when(F.col("large"), 1).otherwise(F.col("cells")))
    out, home = rows.select(*keys, "large", "x", "y", "z", "er", (F.col("reach") * 2.0).alias("edge"), "own", "size", (F.col("er") + F.col("reach")).alias("rim"), *also), F.lit(True)
    for c in "xyz":
        out = out.withColumn(f"t{c}", F.explode(F.sequence(F.floor((F.col(c) - F.col("rim")) / F.col("size")), F.floor((F.col(c) + F.col("rim")) / F.col("size")))))
        home = home & (F.col(f"t{c}") == F.floor(F.col(c) / F.col("size")))
    return out.withColumn("own", F.when(home, F.col("own"))).drop("size", "rim")


def near(xyz: np.ndarray, er: np.ndarray, edge: float, own: np.ndarray, centres: int = CENTRES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (centre, other) of rows whose expanded spheres meet, sorted by centre, in runs of whole centres.

    Spheres of a radius up to half an edge are found by cells; the few larger ones are held against every centre.
    """
    large = np.flatnonzero(er > edge / 2 * (1 + 1e-12))
    usual = np.flatnonzero(er <= edge / 2 * (1 + 1e-12))
    cell = np.floor((xyz - xyz.min(axis=0)) / edge).astype(np.int64) + 1
    span = cell.max(axis=0) + 2
    number = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = usual[np.argsort(number[usual], kind="stable")]
    held = number[order]
    shifts = np.array([(i * span[1] + j) * span[2] - 1 for i in (-1, 0, 1) for j in (-1, 0, 1)])  # three cells in a row along z
    for at in range(0, len(own), centres):
        mine = own[at : at + centres]
        want = number[mine][:, None] + shifts
        lo, hi = np.searchsorted(held, want), np.searchsorted(held, want + 3)
        many = (hi - lo).ravel()
        a = np.repeat(np.repeat(mine, len(shifts)), many)
        b = order[np.repeat(lo.ravel() - np.cumsum(many) + many, many) + np.arange(many.sum())]
        if len(large):
            place = np.empty(len(er), np.int64)
            place[mine] = np.arange(len(mine))
            a, b = np.concatenate([a, np.repeat(mine, len(large))]), np.concatenate([b, np.tile(large, len(mine))])
            by = np.argsort(place[a], kind="stable")
            a, b = a[by], b[by]
        d2 = ((xyz[a] - xyz[b]) ** 2).sum(axis=1)
        ok = (d2 < (er[a] + er[b]) ** 2) & (a != b)
        yield a[ok], b[ok]


def neighbor_pairs(atoms: DataFrame, centers=None, keys: tuple[str, ...] | None = None, edge: float | None = None) -> DataFrame:
    """Ordered pairs with squared distance below (er + other's er) squared: keys, atom, x, y, z, er, other, ox, oy, oz, oer, d2.

    ``centers`` (a condition) restricts the atoms that pairs are looked up for; all atoms still serve as neighbours.
    ``edge`` bounds the cell edge where a bound of the radii is known, else it is measured per key. A tile's pairs leave
    its task in runs of ``CENTRES`` centres.
    """
    keys = keys or keys_of(atoms)
    mine = F.lit(True) if centers is None else centers
    rows = atoms.select(*keys, "atom", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "er")), F.when(mine, F.lit(True)).alias("mine"))
    kind = rows.select(*keys, "atom", "x", "y", "z", "er", F.col("atom").alias("other"), *(F.col(c).alias(f"o{c}") for c in ("x", "y", "z", "er"))).schema
    schema = to_arrow_schema(kind)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        own = np.flatnonzero(t.column("own").is_valid().to_numpy())
        if not len(own):
            return
        xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
        for a, b in near(xyz, t.column("er").to_numpy(), t.column("edge")[0].as_py(), own):
            left, right = t.select([*keys, "atom", "x", "y", "z", "er"]).take(pa.array(a)), t.select(["atom", "x", "y", "z", "er"]).take(pa.array(b))
            yield from pa.Table.from_arrays([*left.columns, *right.columns], schema=schema).combine_chunks().to_batches()

    parts = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as for kernels: not merged by size
    tiles = tiled(rows, F.col("mine"), keys, edge, ("atom",)).repartition(parts, *keys, "large", "tx", "ty", "tz")
    d2 = F.expr("(x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz)")
    pairs = tiles.groupBy(*keys, "large", "tx", "ty", "tz").applyInArrow(tile, kind)
    return pairs.where("atom <> other").withColumn("d2", d2).where("d2 < (er + oer) * (er + oer)")
