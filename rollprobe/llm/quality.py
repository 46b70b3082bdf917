"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage becomes shares of neighbouring byte classes, word
repetition and length figures; a learned encoder (one tanh layer) maps it to a vector, gated attention
(tanh branch times sigmoid branch) learns from document labels alone how much each passage says, and a linear layer
scores the attention-weighted mean. Training runs on every passage of at most ``train_docs`` labelled documents and
``train_bytes`` of their text (those with the smallest hash of their id; none of more than a sixteenth of the bytes);
every other step covers all rows and whole texts; weights reach tasks in a broadcast of fixed size.

Null and empty texts are one empty passage and get a score; a text of any length is scored from all its passages. An
empty table gives no row. Labels other than 0 and 1 and null ids are not learned from;
without any labelled row the score is the prior 0.5. Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, empty_caches, give_back, map_arrow, slices

PASSAGE = 512
CLASSES = 16


def _classes() -> np.ndarray:
    c = np.full(256, 15)
    c[128:] = 0
    c[ord("a") : ord("z") + 1] = 1
    c[ord("A") : ord("Z") + 1] = 2
    c[ord("0") : ord("9") + 1] = 3
    for k, chars in enumerate((" ", "\n\r\t\v\f", ".", ",;:", "!?", "$", "*", "%&", "#", "|<>", "\"'()-"), 4):
        for x in chars:
            c[ord(x)] = k
    return c


CLASS = _classes()
WIDTH = CLASSES * CLASSES + 5


def passages(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, first passage of each row and the total)."""
    words = Words(col)
    data, at = words.data, words.at
    size = np.diff(at)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    row = np.repeat(np.arange(len(size)), size)
    of = first[row] + (np.arange(len(data)) - at[row]) // PASSAGE
    kind = CLASS[data]
    pair = kind[:-1] * CLASSES + kind[1:]
    same = of[1:] == of[:-1]
    hist = np.bincount(of[:-1][same] * (CLASSES * CLASSES) + pair[same], minlength=total * CLASSES * CLASSES).reshape(total, -1).astype(np.float32)
    n_bytes = np.bincount(of, minlength=total)
    x = np.zeros((total, WIDTH), np.float32)
    x[:, : CLASSES * CLASSES] = np.sqrt(hist / np.maximum(n_bytes - 1, 1)[:, None])
    if len(words.hash):
        w_of = of[words.start]
        n_words = np.bincount(w_of, minlength=total)
        key = np.unique(words.hash ^ (w_of.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
        x[:, -5] = np.bincount(w_of[key], minlength=total) / np.maximum(n_words, 1)
        again = (words.hash[1:] == words.hash[:-1]) & (w_of[1:] == w_of[:-1])
        x[:, -4] = np.bincount(w_of[1:][again], minlength=total) / np.maximum(n_words, 1)
        x[:, -3] = np.bincount(w_of, words.end - words.start, minlength=total) / np.maximum(n_words, 1) / 10
        x[:, -2] = n_words / 100
    x[:, -1] = n_bytes / PASSAGE
    return x, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class AttentionBag:
    """Encoder, gated attention and output layer, with gradients by hand."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": g(width, hidden), "b": np.zeros(hidden, np.float32), "V": g(hidden, gate), "U": g(hidden, gate), "w": g(gate), "c": g(hidden), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw = (t * s) @ p["w"]
        seg, start = np.repeat(np.arange(len(first) - 1), np.diff(first)), first[:-1]
        e = np.exp(raw - np.maximum.reduceat(raw, start)[seg])
        a = e / np.add.reduceat(e, start)[seg]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "seg": seg, "start": start, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict, y: np.ndarray) -> dict:
        p, out = self.p, (f["y"] - y) / len(y)
        dz = out[:, None] * p["c"]
        dh = f["a"][:, None] * dz[f["seg"]]
        da = (f["h"] * dz[f["seg"]]).sum(axis=1)
        draw = f["a"] * (da - np.add.reduceat(f["a"] * da, f["start"])[f["seg"]])
        dg = draw[:, None] * p["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ draw, "c": f["z"].T @ out, "d": np.array([out.sum()])}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.004) -> AttentionBag:
        self.mean = x.mean(axis=0)
        self.scale = (1 / np.maximum(x.std(axis=0), 0.02)).astype(np.float32)
        r, m, v, n = np.random.default_rng(1), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                docs = order[i : i + batch]
                rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in docs])
                cut = np.concatenate([[0], np.cumsum(first[docs + 1] - first[docs])])
                g = self.gradients(self.forward(x[rows], cut), y[docs])
                n += 1
                for k, value in g.items():
                    value = value + 1e-4 * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * value
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * value**2
                    step = m[k] / (1 - 0.9**n) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-7)
                    self.p[k] = (self.p[k] - rate * (1 - epoch / (epochs + 1)) * step).astype(np.float32)
        return self


def sample(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """(doc_id, text, y) of at most ``n`` labelled documents, those with the smallest hash of their id."""
    of = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    some = of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # n rows at most are broadcast; of repeated ids one text is learned, whatever order the rows are in
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = 3000, train_bytes: int = 64 << 20) -> AttentionBag | None:
    """Train on all passages of at most ``train_docs`` documents with at most ``train_bytes`` of text."""

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        x, first = passages(batch.column("text"))
        yield {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "n": np.diff(first), "x": [x[a:b].astype(np.float16).tobytes() for a, b in zip(first, first[1:])]}

    some = sample(docs, labels, label, train_docs).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).where(F.col("size") <= train_bytes // 16)
    until = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # of train_docs rows, ids and sizes alone
    chosen = some.select("doc_id", "size").withColumn("until", until).where(f"until <= {train_bytes}").select("doc_id")
    got = map_arrow(some.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"), fn, "doc_id long, y int, n int, x binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values("doc_id")
    x = np.concatenate([np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in got["x"]]).astype(np.float32)
    return AttentionBag(WIDTH).fit(x, np.concatenate([[0], np.cumsum(got["n"])]), got["y"].to_numpy(np.float32))


def score(docs: DataFrame, model: AttentionBag | None) -> DataFrame:
    """doc_id, score (probability of label 1) and the weight of the passage that counts most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        n = batch.num_rows
        if shared.value is None:
            yield {"doc_id": batch.column("doc_id"), "score": [0.5] * n, "top_weight": [None] * n}
            return
        x, first = passages(batch.column("text"))
        f = shared.value.forward(x, first)
        yield {"doc_id": batch.column("doc_id"), "score": f["y"].astype(np.float64), "top_weight": np.maximum.reduceat(f["a"], first[:-1]).astype(np.float64)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, score double, top_weight double", 1 << 18)


def held_out(modulus: int, rest: int):
    """Whether a row is held out, by the crc32 of its doc_id; rows without an id are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def keep_good(docs: DataFrame, model: AttentionBag | None, threshold: float) -> DataFrame:
    """Rows of ``docs`` with all columns whose score reaches the threshold (without a model: all)."""
    return filter_rows(docs, model, lambda texts, m: m.forward(*passages(texts))["y"] >= threshold)


def filter_rows(docs: DataFrame, model, keep) -> DataFrame:
    """Rows for whose texts ``keep(texts, model)`` holds; no shuffle, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_caches()
        for batch in batches:
            for part in slices(batch, 1 << 18):
                yield part if shared.value is None else part.filter(pa.array(np.asarray(keep(part.column("text"), shared.value))))
        give_back()

    return docs.mapInArrow(run, docs.schema)
