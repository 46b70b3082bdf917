"""PCA of fingerprints: thin singular values by a tree of QR steps, or a Gram matrix where rows are few numbers long.

A matrix of N rows and D columns has at most min(N, D) directions. Where D is at most ``WIDE`` the D x D Gram matrix is a
Spark aggregate. Where it is larger, tasks take the QR factors of blocks of rows and pairs of factors are stacked and
factored again (a tall matrix), or, if there are fewer rows than columns, the Gram matrix of the rows is summed over
blocks of columns (a wide one), so neither holds D x D numbers anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


WIDE = 512  # columns whose Gram matrix is summed as it is
BLOCK = 256  # columns of a block of a wide matrix
STACK = 64  # factors that one task stacks


def column_stats(rows: DataFrame, width: int, col: str = "v") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and population deviation of every coordinate, and the number of rows: one partial row of sums a task.

    Deviations are merged from means and sums of squared distances, so that large means do not cancel.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(width), np.zeros(width)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if len(x):
                n, mean, m2 = _merge(n, mean, m2, len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([m2.tolist()])], names=["n", "mean", "m2"])

    n, mean, m2 = 0, np.zeros(width), np.zeros(width)
    for r in _vectors(rows, width, col).mapInArrow(partial, "n long, mean array<double>, m2 array<double>").toLocalIterator():  # a row a task, one at a time
        if r.n:
            n, mean, m2 = _merge(n, mean, m2, r.n, np.array(r["mean"]), np.array(r.m2))
    return mean, np.sqrt(m2 / max(n, 1)), n


def _merge(n: int, mean: np.ndarray, m2: np.ndarray, k: int, other: np.ndarray, more: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    apart, total = other - mean, n + k
    return total, mean + apart * k / total, m2 + more + apart**2 * (n * k / total)


def _vectors(rows: DataFrame, width: int, col: str) -> DataFrame:
    return rows.select(F.col(col).cast("array<double>").alias("v")).where(F.size("v") == width)


def gram(rows: DataFrame, width: int, col: str = "v", scale: np.ndarray | None = None, center: bool = True) -> DataFrame:
    """(i, j, dot) for i <= j of the centred coordinates: one partial matrix a task, width * (width + 1) / 2 rows out."""
    mean = column_stats(rows, width, col)[0] if center else np.zeros(width)
    scale = np.ones(width) if scale is None else scale
    i, j = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = (b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean) / scale
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "dot"])

    return _vectors(rows, width, col).mapInArrow(partial, "i int, j int, dot double").groupBy("i", "j").agg(F.sum("dot").alias("dot"))


def tall_factor(rows: DataFrame, width: int, col: str, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """R of the QR factors of the scaled rows: factors of blocks, stacked ``STACK`` at a time until one is left."""

    def factor(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, width))
        for x in blocks:
            r = np.linalg.qr(np.concatenate([r, x]), mode="r")
        return r

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = factor((b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean) / scale for b in batches)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def stacked(t: pa.Table) -> pa.Table:
        r = factor(np.frombuffer(x, np.float64).reshape(-1, width) for x in t.column("r").to_pylist())
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // STACK], pa.int64()), "r": [r.tobytes()]})

    vectors, depth = _vectors(rows, width, col), 1
    parts = vectors.rdd.getNumPartitions()
    factors = vectors.mapInArrow(local, "part long, r binary")
    while depth < parts:
        factors, depth = factors.groupBy(F.floor(F.col("part") / STACK).cast("long").alias("next")).applyInArrow(lambda t: stacked(t), "part long, r binary"), depth * STACK
    found = factors.collect()  # one row
    return np.frombuffer(found[0].r, np.float64).reshape(-1, width) if found else np.zeros((0, width))


def wide_gram(rows: DataFrame, width: int, n: int, col: str, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """(n x n products of the rows, the rows numbered): blocks of columns are dealt over tasks, each sums its products."""
    numbered = written(_vectors(rows, width, col).withColumn("id", F.monotonically_increasing_id()).withColumn("nth", F.row_number().over(Window.orderBy("id")) - 1).select("nth", "v"))  # n is the shorter side
    starts = list(range(0, width, BLOCK))
    pieces = numbered.select("nth", F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.slice("v", k + 1, min(BLOCK, width - k)).alias("x")) for k in starts))).alias("p")).select("nth", "p.*")

    def products(t: pa.Table) -> pa.Table:
        at = t.column("block")[0].as_py()
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        x = (x - mean[at : at + x.shape[1]]) / scale[at : at + x.shape[1]]
        order = np.argsort(t.column("nth").to_numpy())
        m = x[order] @ x[order].T
        return pa.table({"row": np.arange(n, dtype=np.int32), "dots": pa.array(list(m), pa.list_(pa.float64()))})

    sums = pieces.groupBy("block").applyInArrow(products, "row int, dots array<double>").select("row", F.posexplode("dots").alias("k", "dot")).groupBy("row", "k").agg(F.sum("dot").alias("dot"))
    out = np.zeros((n, n))
    for r in sums.toLocalIterator():  # n x n rows, n the shorter side
        out[r.row, r.k] = r.dot
    return out, numbered


def directions(rows: DataFrame, width: int, n: int, k: int, col: str, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(k x width directions, their squared singular values, the sum of all squared singular values) of the scaled rows."""
    if width <= WIDE:
        m = np.zeros((width, width))
        for r in gram(rows, width, col, scale, bool(mean.any())).collect():  # width * (width + 1) / 2 rows
            m[r.i, r.j] = m[r.j, r.i] = r.dot
        values, vectors = np.linalg.eigh(m)
        order = np.argsort(values)[::-1][:k]
        return vectors[:, order].T, np.maximum(values[order], 0), float(values.clip(0).sum())
    if n >= width:
        _, s, vt = np.linalg.svd(tall_factor(rows, width, col, mean, scale), full_matrices=False)
        return vt[:k], s[:k] ** 2, float((s**2).sum())
    m, numbered = wide_gram(rows, width, n, col, mean, scale)
    values, u = np.linalg.eigh(m)
    order = np.argsort(values)[::-1][:k]
    weights = u[:, order]  # a direction is the rows' sum by these weights

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(order), width))
        for b in batches:
            x = (b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean) / scale
            total += weights[b.column("nth").to_numpy()].T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(order), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "d"])

    out = np.zeros((len(order), width))
    for r in numbered.mapInArrow(mixed, "k int, d array<double>").toLocalIterator():  # k rows a task
        out[r.k] += np.array(r.d)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300), np.maximum(values[order], 0), float(values.clip(0).sum())


@dataclass
class SasaFingerprintEmbedder:
    """fit/transform of a principal-component projection; signs make each component's largest weight positive."""

    n_components: int = 2
    center: bool = True
    scale: bool = False
    names: list[str] | None = None
    mean_: np.ndarray | None = None
    scale_: np.ndarray | None = None
    components_: np.ndarray | None = None
    explained_variance_ratio_: np.ndarray | None = None
    singular_values_: np.ndarray | None = None

    def fit(self, rows: DataFrame, width: int, col: str = "v", names: list[str] | None = None) -> SasaFingerprintEmbedder:
        mean, sd, n = column_stats(rows, width, col)
        self.names = names
        self.mean_ = mean if self.center else np.zeros(width)
        self.scale_ = np.maximum(sd, 1e-12) if self.scale else np.ones(width)
        vectors, squares, total = directions(rows, width, n, min(self.n_components, width, max(n, 1)), col, self.mean_, self.scale_)
        self.components_ = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
        self.singular_values_ = np.sqrt(squares)
        self.explained_variance_ratio_ = squares / max(total, 1e-300)
        return self

    def transform(self, rows: DataFrame, col: str = "v", names: list[str] | None = None) -> DataFrame:
        """``rows`` with an array column ``embedding``."""
        if self.components_ is None:
            raise ValueError("fit comes first")
        if names is not None and self.names is not None and list(names) != list(self.names):
            raise ValueError("another feature layout than at fit")
        parts = []
        for w in self.components_:
            scaled = w / self.scale_
            weights = F.array(*map(F.lit, scaled.tolist()))
            parts.append(F.aggregate(F.zip_with(F.col(col), weights, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) - F.lit(float(self.mean_ @ scaled)))
        return rows.withColumn("embedding", F.array(*parts))
