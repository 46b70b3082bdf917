"""Thin singular values of tall, wide and small matrices against NumPy."""

import numpy as np
import pytest

from rollprobe.operators import embedding
from rollprobe.operators.embedding import SasaFingerprintEmbedder, column_stats


def table(spark, x):
    return spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(5)


@pytest.mark.parametrize("shape,wide", [((60, 12), 512), ((60, 12), 4), ((9, 40), 4), ((9, 700), 512)])
@pytest.mark.parametrize("center,scale", [(True, True), (False, False)])
def test_directions(spark, monkeypatch, shape, wide, center, scale):
    monkeypatch.setattr(embedding, "WIDE", wide)
    monkeypatch.setattr(embedding, "STACK", 2)
    monkeypatch.setattr(embedding, "BLOCK", 16)
    x = np.random.default_rng(1).standard_normal(shape) * np.linspace(1, 3, shape[1]) + 1000
    e = SasaFingerprintEmbedder(3, center, scale).fit(table(spark, x), shape[1])
    y = (x - (x.mean(axis=0) if center else 0)) / (x.std(axis=0) if scale else 1)
    _, s, vt = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(e.singular_values_, s[:3], rtol=1e-6) and np.allclose(e.explained_variance_ratio_, s[:3] ** 2 / (s**2).sum(), rtol=1e-6)
    assert np.allclose(np.abs((e.components_ * vt[:3]).sum(axis=1)), 1, atol=1e-6)


def test_stats(spark):
    x = np.random.default_rng(2).standard_normal((50, 7)) + 1e8
    mean, sd, n = column_stats(table(spark, x), 7)
    assert n == 50 and np.allclose(mean, x.mean(axis=0), rtol=1e-14) and np.allclose(sd, x.std(axis=0), rtol=1e-6)
    mean, sd, n = column_stats(table(spark, x).limit(0), 7)
    assert n == 0 and not mean.any() and not sd.any()
