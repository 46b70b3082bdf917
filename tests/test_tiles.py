"""Tiles that follow the usual radius, large spheres, dense space: areas equal brute force whatever the tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollprobe.api import from_arrays
from rollprobe.functions.points import sphere_points
from rollprobe.operators import neighbors
from rollprobe.operators.kernels import lee_richards, shrake_rupley


def brute(xyz, r, probe, n):
    p, er = np.array(sphere_points(n)), r + probe
    hid = np.zeros((len(r), n), bool)
    for i in range(len(r)):
        pts = xyz[i] + er[i] * p
        for j in range(len(r)):
            if i != j:
                hid[i] |= ((pts - xyz[j]) ** 2).sum(axis=1) < er[j] ** 2
    return (~hid).sum(axis=1)


def tiles(atoms, probe=1.4):
    rows = neighbors.tiled(neighbors.expanded(atoms, probe), None, ("frame",), None)
    return rows.groupBy("large", "tx", "ty", "tz").agg(F.count("own").alias("own"), F.count("*").alias("all")).collect()


@pytest.mark.parametrize("most", [20_000, 30])
@pytest.mark.parametrize("large", [0, 3])
def test_areas(spark, monkeypatch, most, large):
    monkeypatch.setattr(neighbors, "MOST", most)
    r = np.random.default_rng(5)
    xyz, radii = r.uniform(0, 100, (700, 3)), r.uniform(1.2, 1.9, 700)
    radii[:large] = [40.0, 9.0, 15.0][:large]
    xyz[:large] = xyz[:large] % 20 + 40
    atoms = from_arrays(spark, xyz, radii)
    got = {x.atom: x.exposed for x in shrake_rupley(atoms, n_points=40).collect()}
    assert [got[i] for i in range(700)] == brute(xyz, radii, 1.4, 40).tolist()
    some = {x.atom: x.exposed for x in shrake_rupley(atoms, n_points=40, centers=F.col("atom") % 3 == 0).collect()}
    assert some == {i: n for i, n in got.items() if i % 3 == 0}
    found = tiles(atoms)
    assert sum(t.own for t in found) == 700 and sum(t.own for t in found if t.large) == large
    usual = [t for t in found if not t.large]
    assert len([t for t in usual if t.own]) > 7  # a large sphere leaves the tiles of the others as they are
    if most == 30:
        assert max(t.own for t in usual) < 40
    lr = {x.atom: x.sasa for x in lee_richards(atoms, n_slices=8).collect()}
    monkeypatch.setattr(neighbors, "MOST", 10**9)
    whole = {x.atom: x.sasa for x in lee_richards(atoms, n_slices=8, edge=2 * (radii.max() + 1.4) + 1e-9).collect()}
    assert lr.keys() == whole.keys() and all(lr[i] == pytest.approx(whole[i], abs=1e-8) for i in lr)


def test_equal_places_and_one_atom(spark):
    xyz = np.zeros((50, 3))
    got = sorted(x.exposed for x in shrake_rupley(from_arrays(spark, xyz, np.full(50, 1.5)), n_points=20).collect())
    assert got == sorted(brute(xyz, np.full(50, 1.5), 1.4, 20).tolist())
    assert shrake_rupley(from_arrays(spark, xyz[:1], np.array([1.5])), n_points=20).first().exposed == 20
    assert shrake_rupley(from_arrays(spark, xyz[:2], np.array([0.0, 0.0])), probe=0.0, n_points=20).count() == 2


@pytest.mark.parametrize("large", [0, 3])
def test_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(neighbors, "CENTRES", 50, raising=False)
    r = np.random.default_rng(6)
    xyz, radii = r.uniform(0, 60, (500, 3)), r.uniform(1.2, 1.9, 500)
    radii[:large] = [20.0, 9.0, 5.0][:large]
    atoms = neighbors.expanded(from_arrays(spark, xyz, radii), 1.4)
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    meet = (d2 < (radii[:, None] + radii[None] + 2.8) ** 2) & ~np.eye(500, dtype=bool)
    for centers, edge in ((None, None), (F.col("atom") % 3 == 0, None), (None, 2 * (radii.max() + 1.4) + 1e-9)):
        got = neighbors.neighbor_pairs(atoms, centers, edge=edge)
        rows = got.collect()
        assert sorted((x.atom, x.other) for x in rows) == [(i, j) for i, j in np.argwhere(meet).tolist() if centers is None or i % 3 == 0]
        assert all(x.d2 == pytest.approx(d2[x.atom, x.other]) and (x.ox, x.oer) == (xyz[x.other, 0], radii[x.other] + 1.4) for x in rows)
    tiles_ = neighbors.tiled(atoms.select("frame", "atom", "x", "y", "z", "er"), None, ("frame",), 2 * (1.9 + 1.4))
    assert large or tiles_.count() < 6 * 500  # a shuffle of a few rows an atom: no join with the 27 cells around each
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
