"""Whole-text tokenization with the tokenizers library, each distinct word encoded once per worker.

The pre-tokenizers in use never join text across a space that follows a non-space, so a text without runs of
white space is cut at its white space. Words are found and hashed in the byte buffer of a whole Arrow column; a table of
hashes leads to the ids of words met before, and only new words become Python strings and are encoded. Texts with
white-space runs or with special strings go to the library whole. The result is the library's, id for id; ``tests/llm``
compares them.

The table holds two generations of at most ``LIMIT`` words each, so memory is bounded whatever the texts are. Words are
told apart by 64-bit hashes and their length.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .common import CACHES, LETTER, U64, Words, mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

RUNS = re.compile(r"\s(?:\s|$)|^\s")
TAIL = ",.;:!?"  # marks that may follow a word
LATIN = "\u017f"  # last letter of the words that need none
DOTTED = "\u0130"  # the one letter up to it whose lower case is more than a letter
ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+")  # pre-tokens of printable ASCII
LOWER = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^\sa-z0-9]+")  # the same for the lower-case vocabulary
LETTERS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # how the lower-case vocabulary's pre-tokenizer splits
LIMIT = 1 << 18  # words held in each of two generations of the cache
POOL = 1 << 22  # ids held in each
LONG = 64  # characters of the longest ASCII word that goes to the model at once
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14), *range(28, 32)]] = True
MARKS, PLAIN = np.zeros(256, bool), np.zeros(256, bool)
MARKS[[ord(c) for c in TAIL]] = True
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
BREAKS = np.zeros(256, bool)
BREAKS[[32, 10]] = True


class Held:
    """Open-addressing table from 64-bit keys to runs of ids in one array."""

    def __init__(self, kind: np.dtype) -> None:
        self.keys = np.zeros(4 * LIMIT, U64)  # 0: free
        self.start, self.count = np.zeros(4 * LIMIT, np.int32), np.zeros(4 * LIMIT, np.int32)
        self.pool, self.used, self.words = np.zeros(1 << 20, kind), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is absent."""
        slot, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        at = (keys & U64(len(self.keys) - 1)).astype(np.int64)
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            slot[open_[hit]] = at[hit]
            more = ~hit & (there != 0)
            open_, at = open_[more], (at[more] + 1) & (len(self.keys) - 1)
        return slot

    def put(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Add distinct keys that are absent; ``ids`` are the runs of all, one after another."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(count) - count
        self.used, self.words = self.used + len(ids), self.words + len(keys)
        open_, at = np.arange(len(keys)), (keys & U64(len(self.keys) - 1)).astype(np.int64)
        while len(open_):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[open_[free]]  # of several that want one slot one gets it
            won = self.keys[at] == keys[open_]
            self.start[at[won]], self.count[at[won]] = start[open_[won]], count[open_[won]]
            open_, at = open_[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def full(self) -> bool:
        return self.words > LIMIT or self.used > POOL


def gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of a pool, one after another."""
    total = int(count.sum())
    return pool[np.repeat(start - np.cumsum(count) + count, count) + np.arange(total)]


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as little-endian unsigned bytes, two or four a token by the size of the vocabulary."""

    spaced = True  # white space is part of the pieces

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        split = json.loads(self.lib.pre_tokenizer.__getstate__()) if self.lib.pre_tokenizer else {}
        fold = json.loads(self.lib.normalizer.__getstate__()) if self.lib.normalizer else {}
        steps = [x.get("type") for x in split.get("pretokenizers", [])], [x.get("type") for x in fold.get("normalizers", [])]
        #: Pre-tokens of printable ASCII; none where the vocabulary's pre-tokenizer is not known here.
        self.ascii = None
        if not fold and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
            self.ascii, self.lower = ASCII, False
        elif steps == (["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"]) and LETTERS in split["pretokenizers"][0]["pattern"].get("Regex", ""):
            self.ascii, self.lower = LOWER, True
        self.model = self.lib.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.space = chr(self.shown[32])
        self.young, self.old = Held(self.type), Held(self.type)
        self.blank: dict[int, bytes] = {}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bool:
        """Whether spaces of this text may not be cut points."""
        return RUNS.search(text) is not None

    def odd(self, data: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Rows that go to the library whole: those with special strings, or where white space is no cut point."""
        n = len(at) - 1
        out = np.zeros(n, bool)
        row_of = lambda i: np.searchsorted(at, i, side="right") - 1
        if self.special:
            lead = np.flatnonzero(data == ord(self.special[0][0]))
            for s in self.special:
                word = np.frombuffer(s.encode(), np.uint8)
                hit = lead[lead + len(word) <= len(data)]
                for k in range(1, len(word)):
                    hit = hit[data[hit + k] == word[k]]
                out[row_of(hit)] = True
        if self.spaced and len(data):
            white = WHITE[data]
            i = np.flatnonzero(white[:-1] & white[1:])
            rows = row_of(i)
            out[rows[i + 1 < at[rows + 1]]] = True
            full = np.flatnonzero(at[:-1] < at[1:])
            out[full] |= white[at[full]] | white[at[full + 1] - 1]
            # white space beyond ASCII: U+0085 U+00A0 U+1680 U+2000.. U+3000; a text that may have some is looked at
            lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
            lead = lead[lead + 1 < len(data)]
            second = data[lead + 1]
            some = (data[lead] == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (data[lead] == 0xE1) & (second == 0x9A) | (data[lead] == 0xE2) & ((second == 0x80) | (second == 0x81)) | (data[lead] == 0xE3) & (second == 0x80)
            for r in np.unique(row_of(lead[some])).tolist():
                out[r] = out[r] or self.whole(texts[r].as_py())
        return out

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a string column (null: empty), one row after another, and how many each row has."""
        if col.null_count:
            col = pa.array(col.fill_null(""))
        w = Words(col, WHITE if self.spaced else BREAKS, LETTER)
        n, odd = len(col), self.odd(w.data, w.at, col)
        mine = ~odd[w.row]
        start, end, row = w.start[mine], w.end[mine], w.row[mine]
        before = np.where(start > w.at[row], w.data[np.maximum(start - 1, 0)], 0).astype(np.int64) if self.spaced and len(start) else np.zeros(len(start), np.int64)
        # marks at the end of a word are a piece of their own where a letter or digit stands before them
        stem = end.copy()
        for _ in range(3):
            stem -= MARKS[w.data[stem - 1]] & (stem - 1 > start)
        cut = np.flatnonzero((stem < end) & PLAIN[w.data[stem - 1]])
        start, row, before, end = np.insert(start, cut + 1, stem[cut]), np.insert(row, cut + 1, row[cut]), np.insert(before, cut + 1, 0), np.insert(end, cut, stem[cut])
        keys = mix(w.span(start, end) + (before << 32 | (end - start)).astype(U64), 5) | U64(1)
        slot = self.slots(keys, start, end, before, w.data)
        count = self.young.count[slot].astype(np.int64)
        ids = gather(self.young.pool, self.young.start[slot].astype(np.int64), count)
        per = np.bincount(row, count, minlength=n).astype(np.int64)
        if odd.any():
            rows = np.flatnonzero(odd)
            cut, out, last = np.concatenate([[0], np.cumsum(per)]), [], 0
            for r, raw in zip(rows.tolist(), self.raw([col[r].as_py() for r in rows.tolist()]), strict=True):
                own = np.frombuffer(raw, self.type)
                out += [ids[cut[last] : cut[r]], own]
                per[r], last = len(own), r
            ids = np.concatenate([*out, ids[cut[last] :]])
        return ids, per

    def slots(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Slot of every word in the young table, in which words not met before are put first."""
        if self.young.full():
            self.old, self.young = self.young, Held(self.type)
        slot = self.young.find(keys)
        gone = np.flatnonzero(slot < 0)
        if len(gone):
            new, first = np.unique(keys[gone], return_index=True)
            first = gone[first]
            known = self.old.find(new)
            have = known >= 0
            if have.any():
                count = self.old.count[known[have]].astype(np.int64)
                self.young.put(new[have], gather(self.old.pool, self.old.start[known[have]].astype(np.int64), count), count)
            first = first[~have]
            if len(first):
                text = data.tobytes()
                got = self.words([text[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], (before[first] == 32).tolist())
                got = [x if c in (0, 32) else self.white(c) + x for c, x in zip(before[first].tolist(), got, strict=True)]
                self.young.put(new[~have], np.frombuffer(b"".join(got), self.type), np.array([len(x) for x in got], np.int64) // self.type.itemsize)
            slot[gone] = self.young.find(keys[gone])
        return slot

    def white(self, byte: int) -> bytes:
        """Ids of a single white-space character that is not the space: it is a piece of its own."""
        if byte not in self.blank:
            self.blank[byte] = self.raw([chr(byte)])[0]
        return self.blank[byte]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as :meth:`raw` gives them."""
        ids, per = self.column(pa.array(texts, pa.string()))
        cut = np.concatenate([[0], np.cumsum(per)]) * self.type.itemsize
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]

    def words(self, words: list[str], spaced: list[bool]) -> list[bytes]:
        """Ids of words, with a space before them or not; those whose pre-tokens are plain to see go to the model at once, the rest to the library."""
        out: list[bytes | None] = [None] * len(words)
        ids: list[int] = []
        at, ends, tokenize, space = [], [], self.model.tokenize, self.space
        for i, (p, sp) in enumerate(zip(words, spaced, strict=True) if self.ascii else ()):
            word = p.lower() if self.lower else p
            if word.isalpha():
                if word.isascii():
                    ids += [t.id for t in tokenize(space + word if sp else word)]
                elif max(word) <= LATIN and DOTTED not in p:
                    word = word.encode().decode("latin-1").translate(self.shown)
                    ids += [t.id for t in tokenize(space + word if sp else word)]
                else:
                    continue
            elif word.isascii() and word.isprintable() and len(word) <= LONG:
                for x in self.ascii.findall(" " + word if sp else word):
                    ids += [t.id for t in tokenize(space + x[1:] if x[:1] == " " else x)]
            else:
                continue
            at.append(i)
            ends.append(len(ids))
        data, start = np.array(ids, self.type).tobytes(), 0
        for i, end in zip(at, (e * self.type.itemsize for e in ends), strict=True):
            out[i], start = data[start:end], end
        rest = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(rest), 64):
            for i, x in zip(rest[k : k + 64], self.apart([" " + words[i] if spaced[i] else words[i] for i in rest[k : k + 64]]), strict=True):
                out[i] = x
        return out

    def apart(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without special strings by one call: a special string between them splits the ids again."""
        if not self.special:
            return self.raw(pieces)
        ids = np.array(self.lib.encode_batch_fast([self.special[0].join(pieces)], add_special_tokens=False)[0].ids, self.type)
        cut = np.flatnonzero(ids == self.lib.token_to_id(self.special[0])) * self.type.itemsize
        data, ends = ids.tobytes(), [*cut.tolist(), len(ids) * self.type.itemsize]
        starts = [0, *(cut + self.type.itemsize).tolist()]
        return [data[a:b] for a, b in zip(starts, ends, strict=True)]


class SpacelessEncoder(Encoder):
    """For vocabularies whose pre-tokenizer drops white space: pieces carry none, spaces and line feeds are cuts."""

    spaced = False


_encoders: dict[tuple[str, bool], Encoder] = {}
CACHES.append(_encoders)


def encoder(path: str, spaceless: bool = False) -> Encoder:
    """One encoder a worker process; its cache serves all batches."""
    if (path, spaceless) not in _encoders:
        _encoders.clear()
        _encoders[path, spaceless] = (SpacelessEncoder if spaceless else Encoder)(path)
    return _encoders[path, spaceless]
