"""Toxicity by weak supervision.

1. Voters. From at most ``train_docs`` labelled documents (smallest hash of the id) Spark counts words and word stems
   (prefixes of 4, 5 and 6 bytes) by label; those that stand almost only in toxic documents, in several families of
   copies, become lexicon voters (the ``most_terms`` with the most documents, a bound of the model's size). Pattern voters
   look at hits together (two or more, dense hits, none) and, apart from any lexicon, at shouting (words in capitals)
   and at repeated marks.
2. Label model. Votes of the sample are explained by a hidden label: expectation-maximisation estimates how often each
   voter fires for either label. Correlations left between voters once the label is known are measured, and voters
   that move together share one voice (weights 1 / size of the group), after which the accuracies are estimated anew.
3. Classifier. A linear model with logistic output is trained on the posterior labels and scores all documents.

Labels serve to find words, never as a target. Null and empty texts have no votes and get a low score. Repeated rows
get equal scores; labels other than 0 and 1 and null ids are not used; without labelled rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, U64, Words, drop, map_arrow, mix, shared_dir, shingles, stored
from .quality import filter_rows, sample

STEMS = (4, 5, 6)
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """(row, term) of every word and stem."""
    w = Words(col, NOT_LETTER, FOLDED)
    rows, found = [w.row], [mix(w.hash, 1)]
    for n in STEMS:
        ok = w.end - w.start >= n
        rows.append(w.row[ok])
        found.append(mix(w.span(w.start[ok], w.start[ok] + n), 1 + n))
    return np.concatenate(rows), np.concatenate(found), w


@dataclass
class Model:
    lexicon: np.ndarray  # sorted terms
    weights: np.ndarray
    bias: float
    accuracy: np.ndarray  # rate of firing by hidden label, of each voter
    groups: np.ndarray  # voters with the same number are correlated


PATTERNS = 6
MARKS = np.zeros(256, bool)
MARKS[[ord("!"), ord("?")]] = True


def _counts(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the words of three letters or more in capitals, and the pairs of marks side by side."""
    upper = np.concatenate([[0], np.cumsum((w.data >= 65) & (w.data <= 90))])
    loud = (upper[w.end] - upper[w.start] == w.end - w.start) & (w.end - w.start >= 3)
    pair = np.flatnonzero(MARKS[w.data[:-1]] & MARKS[w.data[1:]])
    row = np.searchsorted(w.at, pair, side="right") - 1
    inside = pair + 1 < w.at[row + 1]
    return np.bincount(w.row[loud], minlength=n), np.bincount(row[inside], minlength=n)


def votes(col: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """Rows x (lexicon voters, then pattern voters), 0 or 1."""
    row, term, w = terms(col)
    out = np.zeros((len(col), len(lexicon) + PATTERNS), np.float32)
    if len(term) and len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, term), len(lexicon) - 1)
        hit = lexicon[at] == term
        out[row[hit], at[hit]] = 1
        hits = np.bincount(row[hit], minlength=len(col))
    else:
        hits = np.zeros(len(col))
    n_words = np.bincount(w.row, minlength=len(col))
    loud, marks = _counts(w, len(col))
    out[:, -6] = loud > 0.3 * np.maximum(n_words, 1)
    out[:, -5] = marks > 0
    out[:, -4] = hits >= 2
    out[:, -3] = hits >= 6
    out[:, -2] = hits > 0.004 * np.maximum(n_words, 1)
    out[:, -1] = hits == 0
    return out


def label_model(x: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of label 1, firing rates voters x 2, group of each voter)."""
    post, weight = start.astype(np.float64), np.ones(x.shape[1])
    groups = np.arange(x.shape[1])
    for stage in range(2):
        for _ in range(rounds):
            n1, n0 = post.sum(), (1 - post).sum()
            r1 = (post @ x + 0.5) / (n1 + 2)
            r0 = ((1 - post) @ x + 0.05) / (n0 + 2)
            prior = np.clip(n1 / len(post), 0.01, 0.99)
            lift = (np.log(r1 / r0) * weight, np.log((1 - r1) / (1 - r0)) * weight)
            logit = np.log(prior / (1 - prior)) + x @ lift[0] + (1 - x) @ lift[1]
            post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if stage == 0:
            rest = x - (post[:, None] * r1 + (1 - post)[:, None] * r0)
            sd = np.sqrt(np.maximum((rest**2).mean(axis=0), 1e-9))
            corr = np.abs(rest.T @ rest / len(x)) / np.outer(sd, sd)
            for i in range(len(groups)):  # voters linked by a strong correlation form a group
                for j in np.flatnonzero(corr[i] > 0.5):
                    groups[groups == groups[j]] = groups[i]
            weight = 1 / np.bincount(groups, minlength=len(groups))[groups]
    return post, np.stack([r0, r1], axis=1), groups


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-5, rounds: int = 800, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on soft labels."""
    w, b, mw, mb = np.zeros(x.shape[1]), -2.0, np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        mw, mb = 0.9 * mw - rate * (x.T @ d + l2 * w), 0.9 * mb - rate * d.sum()
        w, b = w + mw, b + mb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_docs: int = 6000, min_families: int = 4, precision: float = 0.9, most_terms: int = 2048) -> Model | None:
    at = f"{shared_dir(docs.sparkSession)}/toxic-sample"
    some = stored(sample(docs, labels, label, train_docs), at)

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        row, term, _ = terms(batch.column("text"))
        sh, first = shingles(Words(batch.column("text")))
        family = np.array([sh[a:b].min() if b > a else U64(0) for a, b in zip(first, first[1:])], U64).view(np.int64)
        pair = np.unique(np.stack([row.astype(np.int64), term.view(np.int64)], axis=1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
        y = batch.column("y").to_numpy()
        yield {"term": pair[:, 1], "y": y[pair[:, 0]], "family": family[pair[:, 0]]}

    counted = map_arrow(some, fn, "term long, y int, family long").groupBy("term", "family", "y").agg(F.lit(1).alias("one")).groupBy("term").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    good = counted.where((F.col("bad") >= min_families) & (F.col("bad") >= precision * F.col("n"))).orderBy(F.desc("bad"), "term").limit(most_terms).toPandas()
    lexicon = np.sort(good["term"].to_numpy(np.int64).view(U64))

    def vote(batch: pa.RecordBatch) -> Iterator[dict]:
        v = votes(batch.column("text"), lexicon).astype(np.uint8)
        yield {"doc_id": batch.column("doc_id"), "v": [r.tobytes() for r in v]}

    got = map_arrow(some, vote, "doc_id long, v binary").toPandas().sort_values("doc_id")  # train_docs rows at most
    drop(docs.sparkSession, at)
    if not len(got):
        return None
    x = np.stack([np.frombuffer(v, np.uint8) for v in got["v"]]).astype(np.float64)
    post, accuracy, groups = label_model(x, np.where(x[:, -1] == 1, 0.02, np.where(x[:, -4] == 1, 0.98, 0.8)))
    w, b = logistic(x, post)
    return Model(lexicon, w, b, accuracy, groups)


def predict(col: pa.Array, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-(votes(col, model.lexicon) @ model.weights + model.bias)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (probability of label 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # most_terms + PATTERNS weights

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        m = shared.value
        yield {"doc_id": batch.column("doc_id"), "score": np.zeros(batch.num_rows) if m is None else predict(batch.column("text"), m)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, score double", 1 << 18)


def keep_clean(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """Rows of ``docs`` with all columns that score below the threshold (without a model: all)."""
    return filter_rows(docs, model, lambda texts, m: predict(texts, m) < threshold)
