"""Trajectory files as data sources: DCD and XTC, read by ranges of frames, streamed while they grow, written in parts.

``spark.read.format("dcd" | "xtc")`` plans one task for each range of frames of about ``range_bytes``. Conditions on
``frame``, ``atom`` and ``structure`` go down to the source: only ranges that hold wanted frames are planned, and of a
frame only wanted atoms leave the task. ``spark.readStream`` on one file gives the frames that were complete when a
micro-batch began. ``df.write`` takes rows sorted by structure, frame and atom order; tasks write frames into parts, and
the commit strings the parts of the attempts that count together; an abort leaves nothing behind.

A last frame that the file's end cuts off is left out, as an interrupted run leaves one.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import COORDS

RANGE_BYTES = 64 << 20
WINDOW = 1 << 14  # atoms of a frame that are Python numbers, or rows of a batch, at once


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


# ---------------------------------------------------------------- DCD
def dcd_layout(data: bytes) -> tuple[str, int, int, int, bool]:
    """(byte order, frames, atoms, offset of the first frame, unit cell)."""
    order = "<" if struct.unpack_from("<i", data, 0)[0] == 84 else ">"
    if struct.unpack_from(order + "i", data, 0)[0] != 84 or data[4:8] != b"CORD":
        raise ValueError("not a DCD file")
    frames, cell = struct.unpack_from(order + "i", data, 8)[0], struct.unpack_from(order + "i", data, 8 + 40)[0] == 1
    at = 92
    at += 8 + struct.unpack_from(order + "i", data, at)[0]
    n_atoms = struct.unpack_from(order + "i", data, at + 4)[0]
    return order, frames, n_atoms, at + 12, cell


def _record(b: bytes) -> bytes:
    return struct.pack("<i", len(b)) + b + struct.pack("<i", len(b))


def dcd_head(frames: int, atoms: int) -> bytes:
    return _record(b"CORD" + struct.pack("<20i", frames, 0, 1, *[0] * 16, 24)) + _record(struct.pack("<i", 1) + b" " * 80) + _record(struct.pack("<i", atoms))


def dcd_frame(xyz: np.ndarray) -> bytes:
    return b"".join(_record(xyz[:, i].astype("<f4").tobytes()) for i in range(3))


def dcd_bytes(xyz: np.ndarray) -> bytes:
    """A DCD file of float32 frames (frames x atoms x 3)."""
    return dcd_head(len(xyz), xyz.shape[1]) + b"".join(map(dcd_frame, xyz))


class Dcd:
    """Frames of one stride. ``bare`` trusts the file's size alone, since a growing file's header may be behind."""

    suffix = ".dcd"

    def __init__(self, path: str, bare: bool = False) -> None:
        fs, p = file_system(path)
        self.fs, self.path = fs, p
        with fs.open_input_file(p) as f:
            size = f.size()
            self.order, frames, self.n, self.at, cell = dcd_layout(f.read(min(size, 1 << 16)))
        self.skip = 56 if cell else 0
        self.step = 3 * (4 * self.n + 8) + self.skip
        there = (size - self.at) // self.step
        self.frames = there if bare else min(frames, there)

    def ranges(self, low: int, high: int, each: int) -> list[tuple[int, int, int]]:
        """(first, stop, offset) of ranges of frames of about ``each`` bytes that meet ``low`` <= frame < ``high``."""
        high, many = min(high, self.frames), max(1, each // max(self.step, 1))
        return [(k, min(high, k + many), self.at + k * self.step) for k in range(max(low, 0), high, many)]

    def read(self, first: int, stop: int, offset: int, want) -> Iterator[tuple[int, np.ndarray]]:
        with self.fs.open_input_file(self.path) as f:
            for k in range(first, stop):
                if want(k):
                    f.seek(offset + (k - first) * self.step + self.skip)
                    data = f.read(3 * (4 * self.n + 8))
                    yield k, np.stack([np.frombuffer(data, self.order + "f4", self.n, i * (4 * self.n + 8) + 4).astype(np.float64) for i in range(3)], axis=1)


# ---------------------------------------------------------------- XTC
# Fixed values of the format: how many values a coordinate difference takes at each small index (0 to 8 are unused).
MAGIC = [0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216]
XTC_MAGIC, XTC_HEAD, XTC_BLOCK = 1995, 56, 36
FIRST, LAST = 9, 64  # small indices that a frame may begin with
WIDE = 0xFFFFFF  # above it, the three coordinates have bits of their own


class Corrupt(ValueError):
    """A frame that cannot be decoded."""


def _fields(pairs: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits that begin at the bits ``at``: bytes from the lowest up, each from its highest bit down."""
    out = np.zeros(len(at), np.int64 if width <= 62 else object)
    for low in range(0, width, 8):
        bits = min(8, width - low)
        q = at + low
        part = (pairs[q >> 3].astype(np.int64) >> (16 - bits - (q & 7))) & ((1 << bits) - 1)
        out = out + (part.astype(out.dtype) << low if out.dtype != object else part.astype(object) * (1 << low))
    return out


def _triples(pairs: np.ndarray, at: np.ndarray, width: int, sizes: list[int]) -> np.ndarray:
    """Three coordinates held in one number of ``width`` bits."""
    v = _fields(pairs, at, width)
    return np.stack([v // (sizes[1] * sizes[2]), v // sizes[2] % sizes[1], v % sizes[2]], axis=1).astype(np.int64)


def _plain(pairs: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits, from the highest down."""
    out = np.zeros(len(at), np.int64)
    for done in range(0, width, 8):
        bits = min(8, width - done)
        q = at + done
        out = out << bits | (pairs[q >> 3].astype(np.int64) >> (16 - bits - (q & 7))) & ((1 << bits) - 1)
    return out


def xtc_coordinates(data: bytes, n: int, low: tuple[int, ...], high: tuple[int, ...], small: int) -> np.ndarray:
    """Integer coordinates (n x 3) of a compressed block.

    The block is a row of groups: one atom in full, a bit that says whether five bits follow with the number of atoms of
    the run and a step of the small index, and that many atoms as differences. Where a group begins depends on all before
    it, so a loop over groups finds their places; everything in them is then taken out with array operations.
    """
    sizes = [h - x + 1 for x, h in zip(low, high, strict=True)]
    if min(sizes) < 1:
        raise Corrupt("bounds of coordinates are the wrong way round")
    apart = max(sizes) > WIDE
    each = [s.bit_length() for s in sizes]
    width = sum(each) if apart else (sizes[0] * sizes[1] * sizes[2]).bit_length()
    look, end = data + b"\0\0\0", 8 * len(data)
    raw = np.frombuffer(look, np.uint8)
    pairs = raw[:-1].astype(np.uint16) << 8 | raw[1:]
    starts, runs, kinds, inner = (array("q") for _ in range(4))  # eight bytes a number, where a list takes forty
    p = done = run = 0
    while done < n:
        q = p + width
        if q >= end or not FIRST <= small < len(MAGIC):
            raise Corrupt(f"the block ends after {done} of {n} atoms" if q >= end else f"small index {small}")
        code = (look[q >> 3] << 8 | look[(q >> 3) + 1]) >> (10 - (q & 7)) & 63
        step = 0
        if code & 32:
            step, run, q = code % 32 % 3 - 1, code % 32 // 3, q + 6
        else:
            q += 1
        starts.append(p)
        runs.append(run)
        kinds.append(small)
        inner.append(q)
        p, done, small = q + run * small, done + 1 + run, small + step
    if done != n or p > end:
        raise Corrupt(f"{done} atoms in the block, {n} in the frame" if done != n else "the block is cut off")
    starts, runs, kinds, inner = (np.array(x, np.int64) for x in (starts, runs, kinds, inner))
    if apart:
        at = np.concatenate([[0], np.cumsum(each)])
        full = np.stack([_plain(pairs, starts + at[i], each[i]) for i in range(3)], axis=1)
    else:
        full = _triples(pairs, starts, width, sizes)
    full = full + np.array(low, np.int64)
    first = np.cumsum(runs + 1) - runs - 1  # place of each group
    out = np.zeros((n, 3), np.int64)
    out[first + (runs > 0)] = full  # a run's first atom changes places with the full one
    group = np.repeat(np.arange(len(runs)), runs)
    if len(group):
        begin = np.cumsum(runs) - runs
        nth = np.arange(len(group)) - begin[group]
        diff = np.zeros((len(group), 3), np.int64)
        for kind in np.unique(kinds[group]).tolist():
            rows = np.flatnonzero(kinds[group] == kind)
            diff[rows] = _triples(pairs, inner[group[rows]] + nth[rows] * kind, kind, [MAGIC[kind]] * 3) - MAGIC[kind] // 2
        total = np.cumsum(diff, axis=0)
        before = np.concatenate([np.zeros((1, 3), np.int64), total])[begin[group]]
        out[first[group] + nth + (nth > 0)] = full[group] + total - before
    return out


def xtc_size(head: bytes, n: int | None) -> tuple[int, int]:
    """(atoms, bytes of the frame) from the first ``XTC_HEAD + XTC_BLOCK`` bytes of a frame; refuses what cannot be decoded."""
    magic, atoms = struct.unpack_from(">2i", head, 0)
    if magic != XTC_MAGIC or atoms <= 0 or (n is not None and atoms != n):
        raise Corrupt(f"not a frame of {n} atoms" if n is not None else "not an XTC file")
    if atoms <= 9:
        return atoms, XTC_HEAD + 12 * atoms
    if len(head) < XTC_HEAD + XTC_BLOCK:
        return atoms, len(head) + 1
    small, size = struct.unpack_from(">2i", head, XTC_HEAD + 28)
    if not FIRST <= small <= LAST or not 0 <= size <= 4 * max(int(3 * atoms * 1.2) - 3, 0):
        raise Corrupt(f"small index {small}, {size} bytes for {atoms} atoms")
    return atoms, XTC_HEAD + XTC_BLOCK + -(-size // 4) * 4


def xtc_decode(frame: bytes) -> np.ndarray:
    """Coordinates of one frame in angstroms."""
    n = struct.unpack_from(">i", frame, XTC_HEAD - 4)[0]
    if n != struct.unpack_from(">i", frame, 4)[0]:
        raise Corrupt("two numbers of atoms")
    if n <= 9:
        nm = np.frombuffer(frame, ">f4", 3 * n, XTC_HEAD).astype(np.float32).reshape(n, 3)
    else:
        precision, *bounds, small, size = struct.unpack_from(">f8i", frame, XTC_HEAD)
        at = XTC_HEAD + XTC_BLOCK
        if not precision > 0:
            raise Corrupt(f"precision {precision}")
        whole = xtc_coordinates(frame[at : at + size], n, tuple(bounds[:3]), tuple(bounds[3:]), small)
        nm = whole.astype(np.float32) * np.float32(1.0 / precision)
    return (nm * np.float32(10)).astype(np.float64)


class _Bits:
    def __init__(self) -> None:
        self.out, self.held, self.n = bytearray(), 0, 0

    def put(self, value: int, width: int) -> None:
        self.held, self.n = self.held << width | value, self.n + width
        whole = self.n // 8
        if whole:
            self.n -= 8 * whole
            self.out += (self.held >> self.n).to_bytes(whole, "big")
            self.held &= (1 << self.n) - 1

    def put_bytes(self, value: int, width: int) -> None:
        """Lowest byte first."""
        while width > 8:
            self.put(value & 255, 8)
            value, width = value >> 8, width - 8
        self.put(value, width)

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.held << (8 - self.n)]) if self.n else b"")


class _Rows:
    """Rows of an array as lists, a window of ``WINDOW`` at a time, which moves on with the row asked for."""

    def __init__(self, whole: np.ndarray) -> None:
        self.whole, self.at, self.held = whole, 0, []

    def __getitem__(self, i: int) -> list[int]:
        k = i - self.at
        if not 0 <= k < len(self.held):
            self.at = max(0, i - 16)  # a run looks back over less
            self.held = self.whole[self.at : self.at + WINDOW].tolist()
            k = i - self.at
        return self.held[k]


def xtc_block(whole: np.ndarray, small: int | None = None) -> tuple[list[int], list[int], int, bytes]:
    """(lowest, highest, small index, bytes) of integer coordinates (n x 3); the small index follows the differences met."""
    low, high = whole.min(axis=0).tolist(), whole.max(axis=0).tolist()
    sizes = [h - x + 1 for x, h in zip(low, high, strict=True)]
    apart = max(sizes) > WIDE
    each = [s.bit_length() for s in sizes]
    width = (sizes[0] * sizes[1] * sizes[2]).bit_length()
    atoms, n, bits = _Rows(whole), len(whole), _Bits()
    if small is None:
        usual = int(np.median(np.abs(np.diff(whole, axis=0)).max(axis=1))) if n > 1 else 0
        small = next((k for k in range(FIRST, LAST) if MAGIC[k] // 2 > usual), LAST)
    begin, i, now = small, 0, -1
    fits = lambda a, b, k: all(0 <= x - y + MAGIC[k] // 2 < MAGIC[k] for x, y in zip(a, b, strict=True))
    while i < n:
        chain = []  # differences of the run: first to second atom, third to first, fourth to third ...
        if i + 1 < n and fits(atoms[i], atoms[i + 1], small):
            chain, last = [(atoms[i], atoms[i + 1])], atoms[i]
            while len(chain) < 8 and i + 1 + len(chain) < n and fits(atoms[i + 1 + len(chain)], last, small):
                chain.append((atoms[i + 1 + len(chain)], last))
                last = atoms[i + 1 + len(chain) - 1]
        full = [x - y for x, y in zip(atoms[i + 1] if chain else atoms[i], low, strict=True)]
        if apart:
            for x, w in zip(full, each, strict=True):
                bits.put(x, w)
        else:
            bits.put_bytes((full[0] * sizes[1] + full[1]) * sizes[2] + full[2], width)
        step = 1 if not chain and small < LAST else -1 if len(chain) == 8 and small > FIRST and all(fits(a, b, small - 1) for a, b in chain) else 0
        if len(chain) == now and not step:
            bits.put(0, 1)
        else:
            bits.put(32 | 3 * len(chain) + step + 1, 6)
            now = len(chain)
        for a, b in chain:
            d = [x - y + MAGIC[small] // 2 for x, y in zip(a, b, strict=True)]
            bits.put_bytes((d[0] * MAGIC[small] + d[1]) * MAGIC[small] + d[2], small)
        i, small = i + 1 + len(chain), small + step
    return low, high, begin, bits.done()


def xtc_frame(xyz: np.ndarray, step: int = 0, precision: float = 1000.0) -> bytes:
    """One frame of coordinates in angstroms (n x 3)."""
    n = len(xyz)
    head = struct.pack(">3if9fi", XTC_MAGIC, n, step, float(step), *[0.0] * 9, n)
    if n <= 9:
        return head + (np.asarray(xyz) / 10).astype(">f4").tobytes()
    low, high, small, data = xtc_block(np.rint(np.asarray(xyz, np.float64) / 10 * precision).astype(np.int64))
    return head + struct.pack(">f8i", precision, *low, *high, small, len(data)) + data + b"\0" * (-len(data) % 4)


class Xtc:
    """Frames of any size: an index from headers alone holds one offset a range of frames, and tasks go on from there."""

    suffix = ".xtc"

    def __init__(self, path: str, bare: bool = False) -> None:
        self.fs, self.path = file_system(path)
        self.n, self.frames = None, 0

    def walk(self, f, size: int, at: int = 0) -> Iterator[tuple[int, int]]:
        """(offset, bytes) of every whole frame from the offset ``at``."""
        while at + XTC_HEAD <= size:
            f.seek(at)
            self.n, step = xtc_size(f.read(min(XTC_HEAD + XTC_BLOCK, size - at)), self.n)
            if at + step > size:
                return
            yield at, step
            at += step

    def ranges(self, low: int, high: int, each: int) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        with self.fs.open_input_file(self.path) as f:
            held = 0
            for k, (at, step) in enumerate(self.walk(f, f.size())):
                if low <= k < high:
                    if not out or held + step > each:
                        out.append((k, k, at))
                        held = 0
                    out[-1], held = (out[-1][0], k + 1, out[-1][2]), held + step
                self.frames = k + 1
                if self.frames >= high:
                    break
        return out

    def read(self, first: int, stop: int, offset: int, want) -> Iterator[tuple[int, np.ndarray]]:
        with self.fs.open_input_file(self.path) as f:
            size = f.size()
            for k, (at, step) in zip(range(first, stop), self.walk(f, size, offset), strict=False):
                if want(k):
                    f.seek(at)
                    try:
                        yield k, xtc_decode(f.read(step))
                    except Corrupt as e:
                        raise Corrupt(f"{self.path}, frame {k}: {e}") from None


KINDS = {"dcd": Dcd, "xtc": Xtc}


# ---------------------------------------------------------------- reading
@dataclass
class Wanted:
    """Whole numbers that conditions leave: a range and, where there is one, a list."""

    low: int = 0
    high: int = 1 << 62
    some: frozenset | None = None

    def take(self, f: Filter) -> bool:
        """Narrow by a condition; False where its kind is not known."""
        v = getattr(f, "value", None)
        if isinstance(f, In):
            self.some = frozenset(f.value) if self.some is None else self.some & frozenset(f.value)
            whole = [x for x in self.some if x is not None]
            self.low, self.high = max(self.low, min(whole, default=1 << 62)), min(self.high, max(whole, default=-1) + 1)
        elif isinstance(v, bool) or not isinstance(v, int):
            return False
        elif isinstance(f, EqualTo):
            self.low, self.high = max(self.low, v), min(self.high, v + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.low = max(self.low, v)
        elif isinstance(f, GreaterThan):
            self.low = max(self.low, v + 1)
        elif isinstance(f, LessThanOrEqual):
            self.high = min(self.high, v + 1)
        elif isinstance(f, LessThan):
            self.high = min(self.high, v)
        else:
            return False
        return True

    def __contains__(self, k: int) -> bool:
        return self.low <= k < self.high and (self.some is None or k in self.some)


@dataclass
class Frames(InputPartition):
    path: str
    first: int
    stop: int
    offset: int


def structure_of(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])


@dataclass
class _Scan:
    """What batch and stream readers share."""

    kind: str
    path: str
    each: int = RANGE_BYTES
    frame: Wanted = field(default_factory=Wanted)
    atom: Wanted = field(default_factory=Wanted)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Frames):  # Spark plans one empty task where nothing is wanted
            return
        file, name = KINDS[self.kind](partition.path), structure_of(partition.path)
        for k, xyz in file.read(partition.first, partition.stop, partition.offset, lambda k: k in self.frame):
            rows = np.arange(max(0, self.atom.low), max(0, self.atom.low, min(len(xyz), self.atom.high)), dtype=np.int32)
            if self.atom.some is not None:
                rows = rows[np.isin(rows, [x for x in self.atom.some if x is not None])]
            for at in range(0, max(1, len(rows)), WINDOW):
                some = rows[at : at + WINDOW]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(np.full(len(some), k, np.int32)), pa.array(some), *(pa.array(xyz[some, i]) for i in range(3))], names=["structure", "frame", "atom", "x", "y", "z"])


class _Reader(_Scan, DataSourceReader):
    def __init__(self, kind: str, options: dict) -> None:
        _Scan.__init__(self, kind, options["path"], int(options.get("range_bytes", RANGE_BYTES)))
        self.structures: frozenset | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("structure",) and isinstance(f, EqualTo | In):
                names = frozenset([f.value]) if isinstance(f, EqualTo) else frozenset(f.value)
                self.structures = names if self.structures is None else self.structures & names
            elif column not in (("frame",), ("atom",)) or not (self.frame if column == ("frame",) else self.atom).take(f):
                yield f

    def files(self) -> list[str]:
        fs, p = file_system(self.path)
        if fs.get_file_info(p).type != pa.fs.FileType.Directory:
            return [self.path]
        head = self.path[: len(self.path) - len(p)] if self.path.endswith(p) else ""
        return sorted(head + x.path for x in fs.get_file_info(pa.fs.FileSelector(p)) if x.path.lower().endswith(KINDS[self.kind].suffix))

    def partitions(self) -> list[InputPartition]:
        if self.atom.low >= self.atom.high or self.frame.low >= self.frame.high:
            return []
        files = [x for x in self.files() if self.structures is None or structure_of(x) in self.structures]
        of = lambda x: [Frames(x, *r) for r in KINDS[self.kind](x).ranges(self.frame.low, self.frame.high, self.each) if any(k in self.frame for k in range(r[0], r[1]))]
        with ThreadPoolExecutor(16) as pool:  # headers of many files at once
            return [p for found in pool.map(of, files) for p in found]


class _Stream(_Scan, DataSourceStreamReader):
    """Offsets are frames of one file that grows; a frame is read when all of it is there."""

    def __init__(self, kind: str, options: dict) -> None:
        _Scan.__init__(self, kind, options["path"], int(options.get("range_bytes", RANGE_BYTES)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, p = file_system(self.path)
        info = fs.get_file_info(p)
        if info.type == pa.fs.FileType.NotFound or info.size < XTC_HEAD:
            return {"frame": 0}
        return {"frame": max((stop for _, stop, _ in KINDS[self.kind](self.path, bare=True).ranges(0, 1 << 62, self.each)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["frame"] >= end["frame"]:
            return []
        return [Frames(self.path, *r) for r in KINDS[self.kind](self.path, bare=True).ranges(start["frame"], end["frame"], self.each)]

    def commit(self, end: dict) -> None:
        """Nothing is held."""


# ---------------------------------------------------------------- writing
@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[str, int, int, int, int, str]]  # structure, first and last frame, frames, atoms, file


class _Writer(DataSourceArrowWriter):
    """Tasks write whole frames; a frame's rows are in one task, and a task's rows are sorted by structure and frame."""

    def __init__(self, kind: str, path: str) -> None:
        self.kind, self.path, self.staging = kind, path.rstrip("/"), f"{path.rstrip('/')}/_part-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = file_system(self.staging)
        fs.create_dir(base, recursive=True)
        parts, out, now, held = [], None, None, []

        def flush() -> None:
            nonlocal out
            xyz = np.concatenate(held)
            if not np.isfinite(xyz).all():
                raise ValueError(f"{now[0]}, frame {now[1]}: a coordinate is not finite")
            if out is None or parts[-1][0] != now[0] or parts[-1][4] != len(xyz):
                if out is not None:
                    out.close()
                name = f"{base}/{uuid.uuid4().hex}"  # an attempt's own
                out = fs.open_output_stream(name)
                parts.append((now[0], now[1], now[1], 0, len(xyz), name))
            s, first, _, n, atoms, name = parts[-1]
            out.write(dcd_frame(xyz) if self.kind == "dcd" else xtc_frame(xyz, now[1]))
            parts[-1] = (s, first, now[1], n + 1, atoms, name)

        for batch in iterator:
            names, frames = batch.column("structure").to_pylist(), batch.column("frame").to_numpy()
            xyz = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "xyz"], axis=1)
            edges = [0, *(i for i in range(1, len(names)) if frames[i] != frames[i - 1] or names[i] != names[i - 1]), len(names)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = (names[a] or "frames", int(frames[a])) if a < b else now
                if now is not None and key != now:
                    flush()
                    held = []
                    if key < now:
                        raise ValueError(f"rows are not sorted by structure and frame: {key} after {now}")
                now = key
                held.append(xyz[a:b])
        if now is not None:
            flush()
        if out is not None:
            out.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        by: dict[str, list] = {}
        for m in messages:
            for p in m.parts if m is not None else ():
                by.setdefault(p[0], []).append(p)
        try:
            fs, base = file_system(self.path)
            ready = []
            for name, parts in sorted(by.items()):
                parts.sort(key=lambda p: p[1])
                if any(a[2] >= b[1] for a, b in zip(parts[:-1], parts[1:], strict=True)):
                    raise ValueError(f"{name}: a frame is in two tasks")
                sizes = {p[4] for p in parts}
                if len(sizes) > 1:
                    raise ValueError(f"frames of {name} have {min(sizes)} to {max(sizes)} atoms")
                whole = f"{base}/{self.staging.rsplit('/', 1)[-1]}/{name}.whole"
                with fs.open_output_stream(whole) as out:
                    if self.kind == "dcd":
                        out.write(dcd_head(sum(p[3] for p in parts), parts[0][4]))
                    for p in parts:
                        with fs.open_input_stream(p[5]) as f:
                            while block := f.read(8 << 20):
                                out.write(block)
                ready.append((whole, f"{base}/{name}{KINDS[self.kind].suffix}"))
            for whole, final in ready:
                fs.move(whole, final)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.staging)
        if fs.get_file_info(base).type == pa.fs.FileType.Directory:
            fs.delete_dir(base)


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return COORDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.kind, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.kind, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.kind, self.options["path"])


class DcdSource(_Source):
    """``format("dcd")``: a file or a folder of DCD trajectories."""

    kind = "dcd"


class XtcSource(_Source):
    """``format("xtc")``: a file or a folder of XTC trajectories."""

    kind = "xtc"


def register(spark: SparkSession) -> None:
    """Make both formats known to the session and let conditions go down to them."""
    spark.dataSource.register(DcdSource)
    spark.dataSource.register(XtcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def kind_of(path: str) -> str:
    """Format by suffix; of a folder, the kind of its files. DCD where neither says anything."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in KINDS:
        return suffix
    fs, p = file_system(path)
    if fs.get_file_info(p).type == pa.fs.FileType.Directory and any(x.path.lower().endswith(".xtc") for x in fs.get_file_info(pa.fs.FileSelector(p))):
        return "xtc"
    return "dcd"


def read_trajectory(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, kind: str | None = None) -> DataFrame:
    """structure, frame, atom, x, y, z of trajectory files, read by ranges of frames."""
    register(spark)
    return spark.read.format(kind or kind_of(path)).option("range_bytes", range_bytes).load(path)


def read_dcd(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    return read_trajectory(spark, path, range_bytes, "dcd")


def read_xtc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    return read_trajectory(spark, path, range_bytes, "xtc")


def stream_trajectory(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, kind: str | None = None) -> DataFrame:
    """The frames of a growing file as a stream; every micro-batch holds whole frames."""
    register(spark)
    return spark.readStream.format(kind or kind_of(path)).option("range_bytes", range_bytes).load(path)


def atoms_of(path: str, kind: str | None = None) -> dict[str, int]:
    """Atoms a frame of each trajectory at ``path``, from its header."""
    kind = kind or kind_of(path)
    out = {}
    for x in _Reader(kind, {"path": path}).files():
        file = KINDS[kind](x)
        if file.n is None:
            file.ranges(0, 1, RANGE_BYTES)
        out[structure_of(x)] = file.n or 0
    return out


def frame_count(path: str, kind: str | None = None) -> int:
    """Whole frames of a file, from headers alone."""
    file = KINDS[kind or kind_of(path)](path)
    file.ranges(0, 1 << 62, RANGE_BYTES)
    return file.frames


def write_trajectory(coords: DataFrame, path: str, kind: str = "dcd", order: str = "atom", parts: int | None = None) -> DataFrame:
    """One file a structure below ``path``; frames are dealt over tasks by ranges, so one structure is written by many.

    Returns structure, frames, atoms of what was written.
    """
    register(coords.sparkSession)
    name = F.col("structure") if "structure" in coords.columns else F.lit("frames")
    rows = coords.select(name.alias("structure"), F.col("frame").cast("int").alias("frame"), F.col(order).cast("int").alias("atom"), "x", "y", "z")
    keys = ["structure", "frame"]
    dealt = (rows.repartitionByRange(*keys) if parts is None else rows.repartitionByRange(parts, *keys)).sortWithinPartitions(*keys, "atom")
    dealt.write.format(kind).mode("append").save(path)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).groupBy("structure").agg(F.count("*").cast("int").alias("frames"), F.max("n").cast("int").alias("atoms"))


def write_dcd(coords: DataFrame, path: str, order: str = "atom", parts: int | None = None) -> DataFrame:
    return write_trajectory(coords, path, "dcd", order, parts)


def write_xtc(coords: DataFrame, path: str, order: str = "atom", parts: int | None = None) -> DataFrame:
    return write_trajectory(coords, path, "xtc", order, parts)
