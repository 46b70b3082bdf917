"""Token counts of whole texts by rank-synchronous array merging.

Texts are pre-tokenized (byte-level BPE's word pattern); every distinct word of a batch that the worker has not met
becomes one row of a ragged array of symbols, held flat with row offsets. A round finds in every open row the
lowest-ranked adjacent pair, merges all its occurrences in that row, left to right, for all rows at once, and rows
without a ranked pair are closed with their number of surviving symbols. Merging all occurrences of the lowest pair at
once is what the sequential rule does, since a merge can only create pairs that rank later.

Counts are those of the tokenizers library without added special tokens; special strings inside a text count as one
token, as is the library's default. Null texts have 0 bytes and 0 tokens; rows with a null ``doc_id`` and repeated rows
are counted like others, an empty table gives no row, all other columns are ignored. A text may be of any length, and a
word too, though the rounds of a batch are as many as the merges of its longest word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_tokens import RUNS
from .common import map_arrow

# Fixed value: the published word pattern of byte-level BPE vocabularies.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LIMIT = 500_000  # words held in each of two generations of the cache
LONG = 64  # characters of the longest word held


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next code from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.wide = 1 + max(vocab.values())
        # open addressing: a power-of-two table of pair keys, so that a lookup is a few gathers
        self.bits = 18
        while len(pairs) * 4 > 1 << self.bits:
            self.bits += 1
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int32)
        self.into = np.zeros(1 << self.bits, np.int32)
        key, rank = left * self.wide + right, np.arange(len(pairs))
        at = self._at(key)
        while len(key):
            free = self.key[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.key[slot], self.rank[slot], self.into[slot] = key[take], rank[take], made[rank[take]]
            rest = np.setdiff1d(np.arange(len(key)), take)
            key, rank, at = key[rest], rank[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
        self.byte = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _at(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Table slot of each pair; -1 where the pair has no rank."""
        at = self._at(key)
        out, open_ = np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(open_):
            have = self.key[at]
            hit = have == key
            out[open_[hit]] = at[hit]
            go = ~hit & (have != -1)
            open_, key, at = open_[go], key[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts = size.copy()
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        row = np.repeat(np.arange(len(words)), size)
        none = np.iinfo(np.int32).max
        while len(sym) > 1:
            same = row[1:] == row[:-1]
            slot = np.full(len(sym) - 1, -1, np.int64)
            at = np.flatnonzero(same)
            slot[at] = self.find(sym[at] * self.wide + sym[at + 1])
            rank = np.where(slot >= 0, self.rank[np.maximum(slot, 0)], none)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            best = np.minimum.reduceat(np.append(rank, none), first)  # a row's last symbol pairs with none of its own
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sym))))
            hit = (rank != none) & (rank == best[of[:-1]])
            # of overlapping occurrences (aaa) every other one counts, from the left
            runs = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            if len(runs):
                nth = np.arange(len(hit)) - runs[np.maximum(np.searchsorted(runs, np.arange(len(hit)), side="right") - 1, 0)]
                hit &= nth % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.into[slot[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            np.subtract.at(counts, row[where], 1)
            keep &= (best != none)[of]  # rows without a ranked pair are done
            sym, row = sym[keep], row[keep]
        return counts

    def words(self, text: str) -> list[str]:
        """Pieces whose counts add up to the text's: at spaces, or by the pattern where white space runs on."""
        if RUNS.search(text):
            return WORDS.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def count_texts(self, texts: list[str]) -> list[int]:
        pieces: list[str] = []
        ends, extra = [], []
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            extra.append(len(parts) - 1)
            for part in parts:
                if part:
                    pieces += self.words(part)
            ends.append(len(pieces))
        got = list(map(self.young.get, pieces))
        if None in got:
            missing = list(dict.fromkeys(p for p, g in zip(pieces, got, strict=True) if g is None))
            new = []
            for p in missing:
                if (known := self.old.get(p)) is None:
                    new.append(p)
                else:
                    self.young[p] = known
            if new:
                split = [[w.encode() for w in WORDS.findall(p)] for p in new]
                flat = [w for ws in split for w in ws]
                n = self.count(flat) if flat else np.zeros(0, np.int64)
                sums = np.concatenate([[0], np.cumsum(n)])
                cut = np.concatenate([[0], np.cumsum([len(ws) for ws in split])])
                self.young.update(zip(new, (sums[cut[1:]] - sums[cut[:-1]]).tolist(), strict=True))
            got = list(map(self.young.get, pieces))
            for p in new:
                if len(p) > LONG:
                    del self.young[p]
            if len(self.young) > LIMIT:
                self.old, self.young = self.young, {}
        sums = np.concatenate([[0], np.cumsum(np.array(got, np.int64))]) if got else np.zeros(1, np.int64)
        return (np.diff(sums[[0, *ends]]) + np.array(extra)).tolist() if texts else []


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``; rows stay where they are (no shuffle)."""

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column("text").fill_null("").to_pylist()
        yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": (n := merger(vocabulary).count_texts(texts)), "over_limit": [x > limit for x in n]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", 1 << 20)
