"""Ids that stand for several rows: every text and vector counts, nothing is found twice."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollprobe.llm import ann, jaccard_join


def texts():
    r = random.Random(4)
    a, b, c = (" ".join(f"{x}{r.randint(0, 500)}" for _ in range(60)) for x in "abc")
    return a, b, c


@pytest.mark.parametrize("light", [0, 100_000])
def test_one_id_with_two_texts(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    a, b, c = texts()
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (5, c), (4, c + " z"), (5, "alone in the world of texts"), (6, c + " w")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, node string").coalesce(2)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == [(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (4, 57, 4), (5, 2, 5), (5, 56, 4), (6, 57, 4)]
    kept = jaccard_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, a), (1, b), (4, c + " z"), (5, "alone in the world of texts")])


def test_repeated_rows_stay_once(spark):
    a, b, _ = texts()
    rows = [(1, a), (1, a), (2, b), (2, None), (2, None), (None, "x"), (None, "x"), (None, "y"), (7, ""), (7, "")]
    kept = jaccard_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(kept, key=str) == sorted(set(rows), key=str)


def test_repeated_query_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(4).tolist()) for i in range(60)]
    rows += [rows[10], rows[10], rows[16], (20, r.standard_normal(4).tolist()), (17, r.standard_normal(4).tolist()), (None, rows[0][1])]
    got = {}
    for x in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    by = {}
    for i, v in rows:
        if i is not None:
            by.setdefault(i, []).append(v)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    assert sorted(got) == [0, 10, 20, 30, 40, 50]
    for q, found in got.items():
        v = min(by[q])
        want = sorted((-max(cos(v, w) for w in ws), i) for i, ws in by.items() if i != q)[:5]
        assert [(n, i) for n, i, _ in sorted(found)] == [(k + 1, i) for k, (_, i) in enumerate(want)]
        assert [s for _, _, s in sorted(found)] == pytest.approx([-s for s, _ in want])


def test_sample_is_bounded_before_it_meets_one_task(spark):
    """Hashes choose the sample; a partition is cut again where it is larger than the limit."""
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, r.standard_normal(4).tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    routers = ann.routers_of(ann.usable(rows), 4, 4, 5, 400, 0.97)
    assert list(routers) == [1] and routers[1].w1.any() and routers[1].w2.shape[1] == 4
