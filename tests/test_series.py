"""Series by segments and range partitions against plain loops over whole series."""

import numpy as np
import pytest

from rollprobe import segments
from rollprobe.operators import timeseries as T


def plain_kinetics(v, t, h, dt):
    state, out = None, []
    for x in v:
        state = int(x > t) if state is None and not (x > t + h or x <= t - h) else 1 if x > t + h else 0 if x <= t - h else state
        out.append(state)
    edges = [0, *(i for i in range(1, len(out)) if out[i] != out[i - 1]), len(out)]
    spans = [(out[a], b - a) for a, b in zip(edges[:-1], edges[1:])]
    dwell = lambda s: (lambda x: float(np.mean(x)) * dt if x else None)([n for k, n in spans[1:-1] if k == s])
    return len(spans) - 1, (len(spans) - 1) / ((len(v) - 1) * dt) if len(v) > 1 else None, float(np.mean(out)), dwell(1), dwell(0)


def series():
    r = np.random.default_rng(1)
    out = {("walk", k): np.round(np.cumsum(r.standard_normal(n)), 3) for k, n in enumerate((1, 2, 40, 333))}
    out |= {("flat", 0): np.zeros(50), ("up", 0): np.ones(30), ("swing", 0): np.tile([2.0, 2, -2, -2, -2], 20), ("hold", 0): np.full(25, 0.2), ("late", 0): np.array([0.1] * 20 + [3.0] * 5 + [0.1] * 20 + [-3.0] + [0.3] * 7)}
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f, i, 3 * k + 5, float(x)) for (f, i), v in series().items() for k, x in enumerate(v)]
    np.random.default_rng(2).shuffle(rows)
    return spark.createDataFrame([(str(a), int(b), int(c), float(d)) for a, b, c, d in rows], "feature string, idx int, frame long, value double")


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_kinetics_by_segments(table, monkeypatch, size):
    monkeypatch.setattr(segments, "SEGMENT", size)
    for h in (0.0, 0.5):
        got = {(r.feature, r.idx): tuple(r)[2:] for r in T.kinetics(table, 0.0, h, 0.25).collect()}
        assert got.keys() == series().keys()
        for k, v in series().items():
            assert got[k] == pytest.approx(plain_kinetics(v.tolist(), 0.0, h, 0.25)), (k, h)
        if size != 7:
            break


@pytest.mark.parametrize("size,parts", [(5, 9), (1 << 16, 1)])
def test_summaries(table, spark, monkeypatch, size, parts):
    monkeypatch.setattr(segments, "SEGMENT", size)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r.feature, r.idx): r for r in T.summarize(table, 0.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.keys() == series().keys()
    for k, v in series().items():
        q = np.quantile(v, [0.5, 0.05, 0.25, 0.75, 0.95])
        up = v > 0
        want = (v.mean(), v.var(), v.std(), v.min(), v.max(), *q, q[3] - q[2], np.median(np.abs(v - q[0])), up.mean(), int((up[1:] != up[:-1]).sum()))
        assert tuple(got[k])[2:] == pytest.approx(want, abs=1e-9), k


def test_quantiles_leave_nulls_out_and_spread_one_series(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.standard_normal(3000), np.zeros(1500)])  # a third are one value
    rows = [("a", float(x)) for x in v] + [("b", None), ("b", 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {x.g: x.q for x in T.quantiles(df, (0.0, 0.01, 0.3, 0.5, 0.999, 1.0), ("g",), parts=13).collect()}
    assert got["a"] == pytest.approx(np.quantile(v, (0.0, 0.01, 0.3, 0.5, 0.999, 1.0)).tolist()) and got["b"] == [4.0] * 6 and set(got) == {"a", "b"}


def test_no_task_holds_a_whole_series(table):
    """Windows go by segments, stretches or one row a segment; ``percentile``, which holds all values of a series, is gone."""
    plan = T.summarize(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    plan = T.kinetics(table)._jdf.queryExecution().optimizedPlan().toString()
    whole = [x for x in plan.splitlines() if "Window" in x and "_seg" not in x and "_segment" not in x]
    assert all("_end" in x or "_begins" in x or "_before" in x or "_id" in x for x in whole), whole
