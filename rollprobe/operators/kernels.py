"""Surface kernels, tile by tile: Shrake-Rupley (or covered-point bit masks of given pairs), Lee-Richards by slices and arc unions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.points import sphere_points
from .neighbors import CENTRES, expanded, keys_of, near, tiled

WORD = 60  # points a bit mask of one LONG holds
TESTS = 1 << 20  # point tests done at once


def point_rows(n: int):
    """Array literal of the test points: word, bit, ux, uy, uz."""
    return F.array(*[F.struct(F.lit(k // WORD).alias("w"), F.lit(1 << (k % WORD)).cast("long").alias("bit"), F.lit(a).alias("ux"), F.lit(b).alias("uy"), F.lit(c).alias("uz")) for k, (a, b, c) in enumerate(sphere_points(n))])


def _points(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df.sparkSession.range(1).select(F.explode(point_rows(n)).alias("p")).select("p.*"))  # n rows


def covered(pairs: DataFrame, n_points: int, keys: tuple[str, ...], single: bool = False) -> DataFrame:
    """Bit masks of covered points: keys, atom, w, mask."""
    of = (lambda c: f"cast({c} as float)") if single else (lambda c: c)
    d = [f"({of(c)} + {of('er')} * {of('u' + c)} - {of('o' + c)})" for c in "xyz"]
    inside = F.expr(f"({d[0]} * {d[0]} + {d[1]} * {d[1]} + {d[2]} * {d[2]}) < {of('oer')} * {of('oer')}")
    return pairs.crossJoin(_points(pairs, n_points)).where(inside).groupBy(*keys, "atom", "w").agg(F.expr("bit_or(bit)").alias("mask"))


def exposed_points(xyz: np.ndarray, er: np.ndarray, edge: float, own: np.ndarray, unit: np.ndarray, single: bool = False) -> np.ndarray:
    """For each centre row in ``own`` and each test point whether no other expanded sphere covers it."""
    free = np.ones((len(own), len(unit)), bool)
    kind = np.float32 if single else np.float64
    place = np.full(len(er), -1)
    place[own] = np.arange(len(own))
    c, r, u = xyz.astype(kind), er.astype(kind), unit.astype(kind)
    for a, b in near(xyz, er, edge, own):
        step = max(1, TESTS // len(unit))
        for k in range(0, len(a), step):
            i, j = a[k : k + step], b[k : k + step]
            total = 0
            for axis in range(3):
                d = (c[i, axis, None] + r[i, None] * u[:, axis]) - c[j, axis, None]
                total = total + d * d
            inside = total < (r[j] * r[j])[:, None]
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            free[place[i[first]]] &= ~np.logical_or.reduceat(inside, first, axis=0)
    return free


def _counts(unit: np.ndarray, single: bool):
    return lambda xyz, er, edge, own: pa.array(exposed_points(xyz, er, edge, own, unit, single).sum(axis=1), pa.int32())


def _numbers(unit: np.ndarray):
    def found(xyz: np.ndarray, er: np.ndarray, edge: float, own: np.ndarray) -> pa.Array:
        row, k = np.nonzero(exposed_points(xyz, er, edge, own, unit))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(own) + 1)), pa.int32()), pa.array(k, pa.int32()))

    return found


def covered_arcs(xyz: np.ndarray, er: np.ndarray, edge: float, own: np.ndarray, n_slices: int) -> np.ndarray:
    """For each centre row in ``own`` the angle that neighbours cover, summed over its mid-plane circles."""
    lost, two_pi = np.zeros(len(own)), 2.0 * np.pi
    place = np.full(len(er), -1)
    place[own] = np.arange(len(own))
    for a, b in near(xyz, er, edge, own, max(1, CENTRES * 5 // n_slices)):
        r, (dx, dy) = er[a][:, None], (xyz[b] - xyz[a])[:, :2].T
        h = xyz[a, 2][:, None] - r + (np.arange(n_slices) + 0.5) * (2.0 * r / n_slices)
        ri, rj2 = np.sqrt(np.maximum(r * r - (h - xyz[a, 2][:, None]) ** 2, 0.0)), (er[b] ** 2)[:, None] - (h - xyz[b, 2][:, None]) ** 2
        d = np.sqrt(dx * dx + dy * dy)[:, None]
        rj = np.sqrt(np.maximum(rj2, 0.0))
        i, s = np.nonzero((rj2 > 0) & (d < ri + rj) & ~(d + rj < ri))
        ri, rj, d = ri[i, s], rj[i, s], d[i, 0]
        whole = (d + ri < rj) | (d < 1e-14)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(whole, np.pi, np.arccos(np.clip((ri * ri + d * d - rj * rj) / (2.0 * ri * d), -1.0, 1.0)))
        low = np.where(whole, 0.0, np.mod(np.arctan2(dy[i], dx[i]) - alpha, two_pi))
        high = np.where(whole, two_pi, low + 2.0 * alpha)
        over = np.flatnonzero(high > two_pi)  # cut where the circle closes
        circle = place[a[i]] * n_slices + s
        circle, low, high = np.concatenate([circle, circle[over]]), np.concatenate([low, np.zeros(len(over))]), np.concatenate([np.minimum(high, two_pi), high[over] - two_pi])
        order = np.lexsort((high, low, circle))
        circle, low, high = circle[order], low[order], high[order]
        first = np.concatenate([[True], circle[1:] != circle[:-1]]) if len(circle) else np.zeros(0, bool)
        # the furthest end so far on the same circle: circles are set 8 apart, further than any angle
        lift = 8.0 * np.cumsum(first)
        reach = np.maximum.accumulate(high + lift) - lift if len(circle) else high
        before = np.where(first, 0.0, np.concatenate([[0.0], reach[:-1] + lift[:-1]])[: len(circle)] - lift)
        lost += np.bincount(circle // n_slices, np.maximum(high - np.maximum(low, before), 0.0), minlength=len(own))
    return lost


def _swept(atoms: DataFrame, centers, keys: tuple[str, ...], edge: float | None, name: str, type_, find) -> DataFrame:
    """Rows of the centre atoms with a column that ``find`` (xyz, er, edge, centre rows) gives; tile by tile."""
    kind = StructType([*atoms.schema.fields, StructField(name, type_)])
    schema = to_arrow_schema(kind)

    def tile(t: pa.Table) -> pa.Table:
        own = np.flatnonzero(t.column("own").is_valid().to_numpy())
        if not len(own):
            return schema.empty_table()
        xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
        out = find(xyz, t.column("er").to_numpy(), t.column("edge")[0].as_py(), own)
        rows = t.column("own").combine_chunks().take(pa.array(own))
        return pa.table([*(x.cast(f.type) for x, f in zip(rows.flatten(), schema, strict=False)), out], names=schema.names)

    # dealt by number: a tile is much work for few bytes, so partitions must not be merged by their size
    parts = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tiled(atoms, centers, keys, edge).repartition(parts, *keys, "large", "tx", "ty", "tz")
    return rows.groupBy(*keys, "large", "tx", "ty", "tz").applyInArrow(tile, kind)


def shrake_rupley(atoms: DataFrame, probe: float = 1.4, n_points: int = 100, centers=None, keys: tuple[str, ...] | None = None, single: bool = False, edge: float | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """All columns of the centre atoms, with er, exposed (points) and sasa = 4 pi er er exposed / n_points.

    Space is cut into tiles; a tile's atoms and those of a rim as wide as the largest reach meet in one task, which tests
    all points of a centre against its neighbours at once. ``pairs`` supplies neighbour pairs instead of the search;
    ``single`` tests points in single precision.
    """
    keys, atoms = keys or keys_of(atoms), expanded(atoms.drop("exposed", "sasa"), probe)
    if pairs is None:
        out = _swept(atoms, centers, keys, edge, "exposed", IntegerType(), _counts(np.array(sphere_points(n_points)), single))
    else:
        hidden = covered(pairs, n_points, keys, single).groupBy(*keys, "atom").agg(F.sum(F.bit_count("mask")).alias("hidden"))
        mine = atoms if centers is None else atoms.where(centers)
        out = mine.join(hidden, [*keys, "atom"], "left").withColumn("exposed", (F.lit(n_points) - F.coalesce("hidden", F.lit(0))).cast("int")).drop("hidden")
    return out.withColumn("sasa", F.lit(4.0 * math.pi) * F.col("er") * F.col("er") * F.col("exposed") / F.lit(float(n_points)))


def surface_points(atoms: DataFrame, probe: float = 1.4, n_points: int = 100, keys: tuple[str, ...] | None = None, edge: float | None = None) -> DataFrame:
    """The exposed points themselves: keys, atom, k, px, py, pz."""
    keys, atoms = keys or keys_of(atoms), expanded(atoms, probe)
    free = _swept(atoms.select(*keys, "atom", "x", "y", "z", "er"), None, keys, edge, "exposed", ArrayType(IntegerType()), _numbers(np.array(sphere_points(n_points)))).withColumn("k", F.explode("exposed"))
    at = lambda i: F.element_at(F.array(*[F.lit(u[i]) for u in sphere_points(n_points)]), F.col("k") + 1)
    return free.select(*keys, "atom", "k", *((F.col(c) + F.col("er") * at(i)).alias(f"p{c}") for i, c in enumerate("xyz")))


def lee_richards(atoms: DataFrame, probe: float = 1.4, n_slices: int = 20, centers=None, keys: tuple[str, ...] | None = None, edge: float | None = None) -> DataFrame:
    """All columns of the centre atoms, with er and sasa: exposed arc length of ``n_slices`` mid-plane circles.

    Tiles as for Shrake-Rupley; arcs covered by neighbours are cut at 2 pi, sorted, and united with a running maximum.
    """
    keys, atoms = keys or keys_of(atoms), expanded(atoms.drop("sasa", "lost"), probe)
    find = lambda xyz, er, width, own: pa.array(covered_arcs(xyz, er, width, own, n_slices))
    out = _swept(atoms, centers, keys, edge, "lost", DoubleType(), find)
    return out.withColumn("sasa", F.expr(f"(2.0 * er / {n_slices}) * er * ({n_slices} * {2.0 * math.pi!r}D - lost)")).drop("lost")
