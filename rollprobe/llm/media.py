"""Media columns: AVI motion-JPEG.

``write_avi`` stores bytes losslessly as quantised DCT coefficients of baseline JPEG frames: a block of 8 x 8 pixels
holds 64 payload bytes, each as the 8 value bits of a coefficient of size category 8 (256 values, sign included). The
frame's own Huffman tables give category 8 a one-bit code, every block follows a restart marker (so DC prediction starts
at 0) and is 72 bytes long before byte stuffing; both directions are whole-array operations.

``read_avi`` parses the RIFF chunks (``hdrl`` headers, ``idx1`` index, ``movi`` frames), decodes every intra frame to
coefficients, and ``pixels`` carries them through dequantisation and the inverse DCT. ``shots`` compares histograms of
neighbouring frames: a cut is where the difference exceeds mean + ``k`` deviations of the differences in a window
around it and an absolute floor. ``clips`` yields one timed row a shot.

Null texts are stored as 64 zero bytes; equal texts give equal files and features; a text of any length is one file of
as many frames as it needs. Repeated rows are handled alike, extra columns are ignored, an empty table gives no row. Of a
null or damaged file ``digests`` returns a row with the length and digest of what is there and nulls for the rest, and
``clip_rows`` no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

UNIT = 64  # payload bytes a block
FPS = 24

# Zig-zag order of the JPEG standard.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    one = bytes([1, *[0] * 15])  # one code of one bit
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, b"\x00" + one + b"\x08" + b"\x10" + one + b"\x08")
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def encode_frames(payload: bytes, per_frame: int) -> list[bytes]:
    """JPEG frames of ``per_frame`` blocks; the last is filled up with zero bytes."""
    raw = np.frombuffer(payload, np.uint8)
    frames = -(-len(raw) // (UNIT * per_frame))
    full = np.zeros(frames * per_frame * UNIT, np.uint8)
    full[: len(raw)] = raw
    bits = np.zeros((frames * per_frame, UNIT, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(full).reshape(-1, UNIT, 8)
    scan = np.packbits(bits.reshape(len(bits), -1), axis=1)  # 72 bytes a block
    head = _head(8 * per_frame, 8)
    out = []
    marks = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
    for f in range(frames):
        own = scan[f * per_frame : (f + 1) * per_frame]
        if (own == 0xFF).any():
            data = b"".join(row.tobytes().replace(b"\xff", b"\xff\0") + marks[i % 8] for i, row in enumerate(own))[:-2]
        else:
            tail = np.frombuffer(b"".join(marks[i % 8] for i in range(per_frame)), np.uint8).reshape(-1, 2)
            data = np.concatenate([own, tail], axis=1).tobytes()[:-2]
        out.append(head + data + b"\xff\xd9")
    return out


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes, per_frame: int = 16) -> bytes:
    """An AVI file with one MJPG stream; the payload's length is kept in the stream's ``strd`` chunk."""
    per_frame = max(1, min(per_frame, len(payload) // UNIT))
    frames = encode_frames(payload, per_frame)
    width, most = 8 * per_frame, max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, 8, 1, 8, b"MJPG", width * 8, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload))))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    width: int
    height: int
    fps: float
    frames: list[bytes]
    payload_bytes: int | None


def read_riff(data: bytes) -> Avi:
    """Headers and frames of an AVI file, frames as the ``idx1`` index lists them (without one: in file order)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    avi, movi, order, plain = Avi(0, 0, 0.0, [], None), 0, [], []

    def walk(at: int, end: int) -> None:
        nonlocal movi
        while at + 8 <= end:
            tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if tag == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                walk(body + 4, body + size)
            elif tag == b"avih":
                us, *_ = struct.unpack_from("<I", data, body)
                avi.fps = 1e6 / us if us else 0.0
                avi.width, avi.height = struct.unpack_from("<II", data, body + 32)
            elif tag == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                avi.fps = rate / scale if scale else avi.fps
            elif tag == b"strd" and size == 8:
                avi.payload_bytes = struct.unpack_from("<Q", data, body)[0]
            elif tag == b"idx1":
                order.extend(struct.unpack_from("<4sIII", data, body + k) for k in range(0, size - 15, 16))
            elif tag[2:] in (b"dc", b"db"):
                plain.append(data[body : body + size])
            at = body + size + size % 2

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if order:
        first = min(x[2] for x in order)
        base = movi if first < movi else 0  # offsets count from the movi list, in some files from the start
        avi.frames = [data[base + off + 8 : base + off + 8 + size] for tag, _, off, size in order if tag[2:] in (b"dc", b"db")]
    else:
        avi.frames = plain
    return avi


def _split(frame: bytes) -> tuple[dict, bytes]:
    """Tables and scan data of a baseline JPEG frame."""
    at, info = 2, {"dht": {}, "dqt": {}, "ri": 0}
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = 128 if body[0] >> 4 else 64
                info["dqt"][body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if wide == 128 else np.uint8).astype(np.int64)
                body = body[1 + wide :]
        elif marker == 0xC0:
            info["height"], info["width"], n = struct.unpack_from(">HHB", body, 1)
            info["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2):
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                info["dht"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            info["ri"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            info["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = frame.rfind(b"\xff\xd9")
            return info, frame[at + 2 + size : end if end > 0 else len(frame)]
        at += 2 + size
    raise ValueError("no scan in frame")


_ONE = (bytes([1, *[0] * 15]), b"\x08")


def decode_frame(frame: bytes) -> tuple[np.ndarray, dict]:
    """Quantised coefficients (blocks x 64, zig-zag order, DC as stored differences resolved) of the first component."""
    info, scan = _split(frame)
    if info["ri"] == 1 and len(info["parts"]) == 1 and all(info["dht"].get(k) == _ONE for k in (0, 16)):
        raw = np.frombuffer(scan, np.uint8)
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        keep = np.ones(len(raw), bool)
        keep[ff + 1] = False  # stuffed zeros, and the second byte of restart markers
        keep[ff[raw[ff + 1] != 0]] = False
        bits = np.unpackbits(raw[keep].reshape(-1, 72), axis=1).reshape(-1, UNIT, 9)
        if bits[:, :, 0].any():
            raise ValueError("damaged frame")
        v = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int16)
        return np.where(v >= 128, v, v - 255), info
    return _huffman(info, scan), info


def _huffman(info: dict, scan: bytes) -> np.ndarray:
    """Any baseline scan, bit by bit; blocks of the first component."""
    books = {}
    for k, (counts, symbols) in info["dht"].items():
        code, i, book = 0, 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                book[length, code] = symbols[i]
                code, i = code + 1, i + 1
            code <<= 1
        books[k] = book
    parts = {c: (h, v) for c, h, v, _ in info["parts"]}
    hmax, vmax = max(h for h, _ in parts.values()), max(v for _, v in parts.values())
    single = len(info["parts"]) == 1
    mcus = -(-info["width"] // (8 if single else 8 * hmax)) * -(-info["height"] // (8 if single else 8 * vmax))
    import re

    pieces = re.split(rb"\xff[\xd0-\xd7]", scan) if info["ri"] else [scan]
    out, left = [], mcus
    for piece in pieces:
        bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
        at, dc = 0, dict.fromkeys(parts, 0)

        def symbol(book: dict) -> int:
            nonlocal at
            code = 0
            for length in range(1, 17):
                code, at = code << 1 | bits[at], at + 1
                if (length, code) in book:
                    return book[length, code]
            raise ValueError("damaged frame")

        def value(size: int) -> int:
            nonlocal at
            v = 0
            for _ in range(size):
                v, at = v << 1 | bits[at], at + 1
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(left, info["ri"] or left)):
            for c, td, ta in info["scan"]:
                for _ in range(1 if single else parts[c][0] * parts[c][1]):
                    block = [0] * 64
                    dc[c] += value(symbol(books[td]))
                    block[0], k = dc[c], 1
                    while k < 64:
                        rs = symbol(books[16 + ta])
                        if rs & 15 == 0 and rs != 0xF0:
                            break
                        k += rs >> 4
                        if rs & 15:
                            block[k] = value(rs & 15)
                        k += 1
                    if c == info["scan"][0][0]:
                        out.append(block)
        left -= info["ri"] or left
    return np.array(out, np.int16).reshape(-1, 64)


_k = np.arange(8)
DCT = np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _k[None] + 1) * _k[:, None] * np.pi / 16))


def pixels(coefficients: np.ndarray, info: dict) -> np.ndarray:
    """8 x 8 pixel blocks (0-255) from quantised coefficients."""
    table = info["dqt"].get(info["parts"][0][3], np.ones(64, np.int64))
    flat = np.zeros(coefficients.shape, np.float32)
    flat[:, ZIGZAG] = coefficients * table
    blocks = flat.reshape(-1, 8, 8)
    return np.clip(np.rint(DCT.T.astype(np.float32) @ blocks @ DCT.astype(np.float32)) + 128, 0, 255).astype(np.uint8)


def read_avi(data: bytes) -> tuple[bytes, Avi, np.ndarray]:
    """(payload, container, histogram of each frame's luma in 16 bins)."""
    avi = read_riff(data)
    payload, bins = [], []
    for frame in avi.frames:
        coef, info = decode_frame(frame)
        payload.append(np.where(coef > 0, coef, coef + 255).astype(np.uint8).tobytes())
        bins.append(np.bincount(pixels(coef, info).ravel() >> 4, minlength=16))
    whole = b"".join(payload)
    return whole[: avi.payload_bytes], avi, np.array(bins).reshape(-1, 16)


def shots(bins: np.ndarray, window: int = 12, k: float = 2.0, floor: float = 0.1) -> list[int]:
    """First frame of every shot."""
    if len(bins) < 2:
        return [0] if len(bins) else []
    share = bins / np.maximum(bins.sum(axis=1, keepdims=True), 1)
    diff = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, d in enumerate(diff):
        near = diff[max(0, i - window) : i + window + 1]
        if d > floor and d > near.mean() + k * near.std():
            cuts.append(i + 1)
    return cuts


def clips(bins: np.ndarray, fps: float) -> list[tuple[int, float, float, int]]:
    """(clip, start s, end s, frames) of every shot."""
    cuts = [*shots(bins), len(bins)] if len(bins) else []
    return [(i, a / fps, b / fps, b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def pad(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as an AVI file."""

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        padded = [pad(t) for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "n_bytes": [n for _, n in padded], "media": [write_avi(p) for p, _ in padded]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fn, "doc_id long, n_bytes long, media binary")


def whole_avi(data: bytes | None) -> tuple[bytes, Avi, np.ndarray] | None:
    """:func:`read_avi`, or None for a null or a file that is cut or damaged."""
    if data is None:
        return None
    try:
        got = read_avi(data)
    except (ValueError, IndexError, KeyError, struct.error):
        return None
    payload, avi, _ = got
    return got if avi.frames and avi.payload_bytes in (None, len(payload)) else None


def digests(media: DataFrame) -> DataFrame:
    """What is read back from each file: payload and media digests and the shots as a feature string."""

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in batch.column("media").to_pylist():
            got = whole_avi(data)
            if got is None:
                for k in out:
                    out[k].append(None)
                if data is not None:
                    out["media_bytes"][-1], out["media_sha256"][-1] = len(data), hashlib.sha256(data).hexdigest()
                continue
            payload, avi, bins = got
            found = clips(bins, avi.fps or FPS)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["feature"].append(f"frames={len(avi.frames)};size={avi.width}x{avi.height};shots=" + ",".join(f"{a:.3f}-{b:.3f}" for _, a, b, _ in found))
        yield {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), **out}

    return map_arrow(media, fn, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, frames: one row a shot of every file in column ``media``; null media give none."""

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = []
        for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            if (got := whole_avi(data)) is not None:
                _, avi, bins = got
                rows += [(doc, *c) for c in clips(bins, avi.fps or FPS)]
        if rows:
            yield dict(zip(("doc_id", "clip", "start_s", "end_s", "frames"), map(list, zip(*rows, strict=True)), strict=True))

    return map_arrow(media.select("doc_id", "media"), fn, "doc_id long, clip int, start_s double, end_s double, frames int")
