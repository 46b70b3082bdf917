"""DCD and XTC: round trips, cut and corrupt files, planned ranges, growing files, writers that are repeated or stopped."""

import os
import struct

import numpy as np
import pytest

from rollprobe.sources import trajectories as T


def frames(n_frames, n, seed=0, scale=3.0):
    r = np.random.default_rng(seed)
    return np.round(np.cumsum(r.standard_normal((n_frames, n, 3)) * scale, axis=1), 2)


def xtc_file(path, xyz):
    with open(path, "wb") as f:
        for k, x in enumerate(xyz):
            f.write(T.xtc_frame(x, k))


def table(df):
    return {(r.structure, r.frame, r.atom): (r.x, r.y, r.z) for r in df.collect()}


def test_xtc_frames():
    """Few and many atoms, tight and wide spaces, runs and lone atoms, a box whose coordinates have bits of their own."""
    r = np.random.default_rng(1)
    for n in (1, 9, 10, 11, 60, 700):
        for scale in (0.5, 5, 50, 3000, 2e5):
            for chain in (False, True):
                xyz = r.standard_normal((n, 3)) * scale
                if chain:
                    xyz = np.cumsum(r.standard_normal((n, 3)), axis=0) + xyz.mean(axis=0)
                want = np.rint(xyz / 10 * 1000) / 100 if n > 9 else xyz
                assert np.abs(T.xtc_decode(T.xtc_frame(xyz)) - want).max() <= 1e-4 * max(1, scale)
                if n > 9:
                    whole = np.rint(xyz / 10 * 1000).astype(np.int64)
                    for small in (9, 13, 31, 60):
                        low, high, begin, data = T.xtc_block(whole, small)
                        assert (T.xtc_coordinates(data, n, tuple(low), tuple(high), begin) == whole).all()
                        for cut in (1, len(data) // 2):
                            with pytest.raises(T.Corrupt):
                                T.xtc_coordinates(data[:-cut], n, tuple(low), tuple(high), begin)


def test_xtc_bits_by_hand():
    """A block put together bit by bit: two lone atoms, then a run of two differences, whose first atom changes places with the full one."""
    low, high, small = (0, 0, 0), (15, 7, 3), 9  # 16 * 8 * 4 values: 10 bits; differences of 8 values, 9 bits
    bits = ""

    def number(v, width):
        out = ""
        while width > 8:
            out, v, width = out + f"{v & 255:08b}", v >> 8, width - 8
        return out + f"{v:0{width}b}"

    full = lambda x, y, z: number((x * 8 + y) * 4 + z, (16 * 8 * 4).bit_length())
    diff = lambda x, y, z: number(((x + 4) * 8 + y + 4) * 8 + z + 4, 9)
    bits += full(1, 2, 3) + "0"  # no run so far
    bits += full(15, 7, 0) + "1" + f"{0 + 1:05b}"  # a run of none, the small index stays
    bits += full(5, 5, 1) + "1" + f"{6 + 1:05b}" + diff(1, -2, 0) + diff(-3, 3, 1)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert T.xtc_coordinates(data, 5, low, high, small).tolist() == [[1, 2, 3], [15, 7, 0], [6, 3, 1], [5, 5, 1], [3, 6, 2]]


def test_xtc_equals_dcd_of_the_same_frames(spark, tmp_path):
    xyz = frames(7, 40)
    xtc_file(tmp_path / "a.xtc", xyz)
    (tmp_path / "a.dcd").write_bytes(T.dcd_bytes(xyz))
    one, two = table(T.read_xtc(spark, str(tmp_path / "a.xtc"))), table(T.read_dcd(spark, str(tmp_path / "a.dcd")))
    assert len(one) == 280 and one.keys() == two.keys()
    assert all(np.allclose(one[k], two[k], atol=1e-4) for k in one)
    few = frames(3, 9)
    xtc_file(tmp_path / "few.xtc", few)
    got = table(T.read_trajectory(spark, str(tmp_path / "few.xtc")))
    assert len(got) == 27 and np.allclose(got["few", 2, 8], few[2, 8], atol=1e-4) and T.frame_count(str(tmp_path / "few.xtc")) == 3
    assert len(table(T.read_xtc(spark, str(tmp_path)))) == 280 + 27  # a folder


def test_cut_and_corrupt_files(spark, tmp_path):
    xyz = frames(4, 30)
    xtc_file(tmp_path / "x.xtc", xyz)
    data = (tmp_path / "x.xtc").read_bytes()
    sizes = [len(T.xtc_frame(x, k)) for k, x in enumerate(xyz)]
    for cut in (1, 30, sizes[-1] - 20):
        (tmp_path / "x.xtc").write_bytes(data[:-cut])
        assert T.frame_count(str(tmp_path / "x.xtc")) == 3 and T.read_xtc(spark, str(tmp_path / "x.xtc")).count() == 90
    for at, value, message in ((4, 31, "atoms"), (sizes[0] + 4, 31, "not a frame"), (T.XTC_HEAD + 28, 99, "small index"), (T.XTC_HEAD + 32, 10**6, "bytes for")):
        bad = bytearray(data)
        bad[at : at + 4] = struct.pack(">i", value)
        (tmp_path / "x.xtc").write_bytes(bad)
        with pytest.raises(Exception, match=message):
            T.read_xtc(spark, str(tmp_path / "x.xtc")).collect()
    bad = bytearray(data)
    bad[sizes[0] + T.XTC_HEAD + T.XTC_BLOCK : sizes[0] + sizes[1]] = b"\xff" * (sizes[1] - T.XTC_HEAD - T.XTC_BLOCK)
    (tmp_path / "x.xtc").write_bytes(bad)
    with pytest.raises(Exception, match="frame 1"):
        T.read_xtc(spark, str(tmp_path / "x.xtc")).collect()
    (tmp_path / "y.dcd").write_bytes(T.dcd_bytes(xyz)[:-7])
    assert T.read_dcd(spark, str(tmp_path / "y.dcd")).count() == 90


@pytest.mark.parametrize("kind", ["dcd", "xtc"])
def test_only_wanted_frames_are_planned(spark, tmp_path, kind):
    xyz = frames(40, 12)
    for name in ("a", "b"):
        xtc_file(tmp_path / f"{name}.xtc", xyz) if kind == "xtc" else (tmp_path / f"{name}.dcd").write_bytes(T.dcd_bytes(xyz))
    df = T.read_trajectory(spark, str(tmp_path), range_bytes=1, kind=kind)  # a frame a task
    want = {(s, k, i): tuple(xyz[k, i]) for s in "ab" for k in range(40) for i in range(12)}
    for condition, keep, parts in (
        ("frame >= 10 and frame < 20", lambda s, k, i: 10 <= k < 20, 20), ("frame > 37", lambda s, k, i: k > 37, 4), ("frame <= 1 and structure = 'b'", lambda s, k, i: k <= 1 and s == "b", 2), ("frame = 5 and atom >= 3 and atom < 5", lambda s, k, i: k == 5 and 3 <= i < 5, 2),
        ("frame in (2, 30, 99) and atom in (0, 11)", lambda s, k, i: k in (2, 30) and i in (0, 11), 4), ("frame >= 50", lambda s, k, i: False, 1), ("frame < 3 and frame % 2 = 0", lambda s, k, i: k in (0, 2), 6), ("frame < 2 and x > 0", lambda s, k, i: k < 2 and want[s, k, i][0] > 0, 4),
    ):
        some = df.where(condition)
        assert some.rdd.getNumPartitions() == parts, condition
        got = table(some)
        assert got.keys() == {k for k in want if keep(*k)} and all(np.allclose(got[k], want[k], atol=1e-4) for k in got), condition


@pytest.mark.parametrize("kind", ["dcd", "xtc"])
def test_a_growing_file_is_a_stream(spark, tmp_path, kind):
    """Frames that are there when a batch begins; one that is written in part waits."""
    xyz = frames(9, 11)
    path = tmp_path / f"t.{kind}"
    whole = T.dcd_bytes(xyz) if kind == "dcd" else b"".join(T.xtc_frame(x, k) for k, x in enumerate(xyz))
    ends = [len(T.dcd_head(9, 11)) + k * len(T.dcd_frame(xyz[0])) for k in range(10)] if kind == "dcd" else np.cumsum([0, *(len(T.xtc_frame(x, k)) for k, x in enumerate(xyz))]).tolist()
    seen = []
    for upto in (ends[2] + 5, ends[2] + 9, ends[6], len(whole)):
        path.write_bytes(whole[:upto])
        df = T.stream_trajectory(spark, str(path), range_bytes=1000)
        q = df.writeStream.foreachBatch(lambda b, n: seen.append(table(b))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [sorted({k[1] for k in s}) for s in seen if s]
    assert got == [[0, 1], [2, 3, 4, 5], [6, 7, 8]]
    assert all(np.allclose(v, xyz[f, i], atol=1e-4) for s in seen for (_, f, i), v in s.items())


@pytest.mark.parametrize("kind", ["dcd", "xtc"])
def test_many_tasks_write_one_file(spark, tmp_path, kind):
    xyz = frames(30, 10)
    rows = [("s" if k < 25 else "t", k, i, *map(float, xyz[k, i])) for k in range(30) for i in range(10)]
    np.random.default_rng(3).shuffle(rows)
    df = spark.createDataFrame([(str(a), int(b), int(c), float(x), float(y), float(z)) for a, b, c, x, y, z in rows], "structure string, frame int, atom int, x double, y double, z double")
    out = tmp_path / "out"
    report = T.write_trajectory(df, str(out), kind, parts=7)
    assert sorted(map(tuple, report.collect())) == [("s", 25, 10), ("t", 5, 10)] and sorted(os.listdir(out)) == [f"s.{kind}", f"t.{kind}"]
    want = T.dcd_bytes(xyz[:25]) if kind == "dcd" else b"".join(T.xtc_frame(xyz[k], k) for k in range(25))
    assert (out / f"s.{kind}").read_bytes() == want
    bad = df.where("not (frame = 3 and atom = 4)")
    with pytest.raises(Exception, match="9 to 10 atoms"):
        T.write_trajectory(bad, str(tmp_path / "bad"), kind, parts=3)
    assert os.listdir(tmp_path / "bad") == []  # nothing stays behind
    assert T.write_trajectory(df.limit(0), str(tmp_path / "none"), kind).count() == 0


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """A task that is repeated, as after a lost executor, has two sets of parts; the committed one is used."""
    import pyarrow as pa

    xyz = frames(4, 5)
    batch = lambda ks: pa.RecordBatch.from_pydict({"structure": ["s"] * 5 * len(ks), "frame": pa.array([k for k in ks for _ in range(5)], pa.int32()), "atom": pa.array(list(range(5)) * len(ks), pa.int32()), **{c: [float(xyz[k, a, i]) for k in ks for a in range(5)] for i, c in enumerate("xyz")}})
    w = T._Writer("dcd", str(tmp_path))
    w.write(iter([batch([0, 1])]))  # lost
    w.commit([w.write(iter([batch([2]), batch([3])])), w.write(iter([batch([0, 1])])), None])
    assert (tmp_path / "s.dcd").read_bytes() == T.dcd_bytes(xyz) and os.listdir(tmp_path) == ["s.dcd"]
    w = T._Writer("dcd", str(tmp_path))
    w.write(iter([batch([0])]))
    w.abort([])
    assert os.listdir(tmp_path) == ["s.dcd"]
    w = T._Writer("dcd", str(tmp_path / "again"))
    with pytest.raises(ValueError, match="two tasks"):
        w.commit([w.write(iter([batch([0, 1])])), w.write(iter([batch([1, 2])]))])
    with pytest.raises(ValueError, match="not sorted"):
        w.write(iter([batch([1]), batch([0])]))


def test_memory_an_atom():
    """A frame as Python numbers takes several hundred bytes an atom."""
    import tracemalloc

    a = np.arange(40_000)
    xyz = np.stack([a % 12 * 4 + a * 7919 % 1000 / 1000, a // 12 % 12 * 4 + a * 104729 % 1000 / 1000, a // 144 * 4.0], axis=1)
    tracemalloc.start()
    try:
        frame = T.xtc_frame(xyz)
        wrote = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        back = T.xtc_decode(frame)
        read = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.abs(back - xyz).max() < 0.01
    assert wrote < 190 * len(a) and read < 250 * len(a)
