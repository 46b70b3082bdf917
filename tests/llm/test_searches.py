"""Hard negatives, conversation trie and SimHash against plain loops, on both sides of every bound and on odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rollprobe.llm import graph, hard_negatives, prefix_trie, simhash
from rollprobe.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- op11
def plain_negatives(rows, every=10, k=3, top=4):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        x = tuple(math.floor(256 * c) for c in v)
        key = (label, np.array(x, "<f8").tobytes())
        if i not in best or key < best[i][0]:
            best[i] = key, (i, label, x)
    size = sorted(((-sum(len(r[2]) == d for _, r in best.values()), d) for d in {len(r[2]) for _, r in best.values()}))[0][1]
    rows = [r for _, r in best.values() if len(r[2]) == size]
    dot = lambda a, b: max(-hard_negatives.LONG, min(hard_negatives.LONG, sum(x * y for x, y in zip(a, b))))
    out = set()
    for i, label, v in rows:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, lab) for j, lab, w in rows if j != i)
        for ps, p, _ in [s for s in scored if s[2] == label][:k]:
            window = [(s, j) for s, j, lab in scored if lab != label and 30 * -ps <= 100 * -s <= 90 * -ps][:top]
            out |= {(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(window)}
    return out


@pytest.mark.parametrize("bucket,block", [(4096, 4096), (7, 3)])
def test_hard_negatives(spark, bucket, block):
    r = np.random.default_rng(4)
    rows = [(i, int(r.integers(0, 4)), (r.standard_normal(5) * (1 + i % 9)).tolist()) for i in range(150)]
    rows += [(200 + i, int(r.integers(0, 3)), rows[20][2]) for i in range(40)]  # many equal vectors
    rows += [(400, 1, None), (410, None, rows[0][2]), (None, 1, rows[0][2]), (420, 2, [1.0, None, 0.0, 0.0, 0.0]), (430, 2, [float("nan")] * 5), (440, 3, [float("inf")] * 5), (450, 3, [1.0, 2.0]), (460, 2, [1e308] * 5), (470, 5, rows[1][2])]
    rows += [rows[10], rows[10], (10, 0, [9.0] * 5), (480, 1, [0.0] * 5), (490, 0, [-3.0] * 5)]
    df = spark.createDataFrame([(*x, "e", 7.0) for x in rows], "vec_id long, label int, embedding array<double>, need string, score double")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, positives=3, negatives=4, bucket=bucket, block=block).collect()
    want = plain_negatives(rows)
    assert len(got) == len(want) > 100 and {tuple(x) for x in got} == want


def test_hard_negatives_of_very_large_components(spark):
    """Beyond exact doubles, and beyond a long."""
    rows = [(i, i % 2, [float(s * (10**e + i)), float(i)]) for i, (s, e) in enumerate([(1, 5), (1, 6), (1, 7), (1, 7), (1, 8), (-1, 8), (1, 12), (1, 12)])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(df, F.col("vec_id") >= 0, positives=3, negatives=4).collect()
    assert {tuple(x) for x in got} == plain_negatives(rows, 1)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0
    df = spark.createDataFrame([(0, 1, []), (1, None, [1.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0
    df = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0


# ---------------------------------------------------------------- op12
def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[x] for x in children[key]) if children[key] else 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0) + sum(saved[x] for x in children[key])
    sha = lambda key: hashlib.sha256(",".join(str(c) for c in sorted(members[key]) if len(convs[c]) == len(key)).encode()).hexdigest()
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], sha(k)) for k, m in members.items()}


def conversations():
    r = random.Random(6)
    rows = []
    for c in [*range(-12, 90), 1000, 1001, 2**40]:
        if c % 11 == 3:
            continue
        n = 150 if c in (20, 21, 63) else r.randint(1, 12)
        kind = r.randint(0, 3)
        rows += [(c, None if t == 0 and c % 4 == 0 else t, r.choice(["user", None]) if kind == 3 else "user", None if t == 2 else f"é{t % 7}" if kind < 3 and t < 5 else f"{kind} {t} {r.randint(0, 1)}") for t in range(n)]
    rows += [(300 + i, t, "user", f"stair {t}" if t <= i else "end") for i in range(30) for t in range(12 + i)]  # every chain hangs on the one before
    rows += [(400 + i, t, "a", f"same {t}") for i in range(60) for t in range(10)]  # many copies
    rows += [(None, 1, "a", "b")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
        monkeypatch.setattr(prefix_trie, "IDS", 3)
        monkeypatch.setattr(graph, "SHARE", 20)
    rows = conversations()
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, owner string, depth int")
    got = prefix_trie.trie(df, **({"least": 5, "each": 100} if small else {})).collect()
    want = plain_trie(rows)
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_trie_of_repeated_turns_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, 1, "a", "x"), (7, 1, "a", "x"), (8, 5, "b", "long " * 100000)]
    got = {tuple(x) for x in prefix_trie.trie(spark.createDataFrame(rows, schema)).collect()}
    assert got == plain_trie(rows)
    rows = [(10, 1, "a", "first"), (10, 1, "a", "second"), (11, 2, None, None)]  # a tie: the order is that of the content, and always the same
    one, two = ({tuple(x) for x in prefix_trie.trie(spark.createDataFrame(x, schema)).collect()} for x in (rows, rows[::-1]))
    assert one == two and len(one) >= 3


# ---------------------------------------------------------------- op13
def plain_fingerprint(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    runs = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(low):
    """Smallest id reachable of every fingerprint, by all pairs."""
    fps, comp = sorted(low), dict(low)
    near = {f: [g for g in fps if (f ^ g).bit_count() <= 2] for f in fps}
    moved = True
    while moved:
        moved = False
        for f in fps:
            least = min(comp[g] for g in near[f])
            if least < comp[f]:
                comp[f], moved = least, True
    return comp


@pytest.mark.parametrize("piece", [5, 1 << 16])
def test_simhash_of_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    r = random.Random(8)
    texts = ["", None, " \n", "a", "A b", "x y z", "Ünï ÇA ÀB ss tt", "\x1c a b c", "é" * 50000, "tail word here "]
    for _ in range(12):
        w = [f"w{r.randint(0, 400)}" for _ in range(r.randint(3, 150))]
        texts.append(r.choice(["", " ", "\n"]) + r.choice([" ", "  ", "\t"]).join(w))
        for _ in range(4):
            w[r.randrange(len(w))] = "X"
            texts.append(" ".join(w))
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "other text of an id with two texts", "c"), (None, "a", "c"), (12, texts[12], "c"), (-5, texts[11], "c")]
    got = simhash.simhash_join(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    low = {}
    for i, t, _ in rows:
        if i is not None:
            f = plain_fingerprint(t)
            low[f] = min(i, low.get(f, i))
    comp = plain_components(low)
    key = lambda x: tuple((v is not None, v) for v in x)
    want = sorted(((i, f"{plain_fingerprint(t):016x}", None if i is None else comp[plain_fingerprint(t)]) for i, t, _ in rows), key=key)
    assert sorted((tuple(x) for x in got), key=key) == want
    assert simhash.simhash_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [2, 32])
def test_simhash_links_every_pair(spark, limit):
    """Fingerprints around few centres: shared halves, neighbouring halves, chains; both sides of the limit."""
    r = random.Random(9)
    fps = {0, 1, 3, 7, 2**63, 2**63 | 1, 2**64 - 1}
    for _ in range(6):
        c = r.getrandbits(64)
        fps |= {c}
        for _ in range(40):
            f = c
            for b in r.sample(range(64) if r.random() < 0.5 else range(32, 64) if r.random() < 0.5 else range(32), r.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    signed = {f - 2**64 if f >= 2**63 else f: f for f in fps}
    t = graph.Tables(spark)
    links = simhash.links(t, spark.createDataFrame([(f,) for f in signed], "fp long"), limit, least=10).collect()
    assert all((signed[x.a] ^ signed[x.b]).bit_count() <= 2 for x in links)
    comp = graph.components(t, spark.createDataFrame(links or [], "a long, b long"), least=10)
    got = {signed[x.node]: x.comp for x in comp.collect()}
    want = plain_components({f: s for s, f in signed.items()})
    assert {f: got.get(f, s) for s, f in signed.items()} == want


@pytest.mark.parametrize("light", [0, 1000])
def test_components(spark, monkeypatch, light):
    monkeypatch.setattr(graph, "SHARE", 10)
    r = random.Random(3)
    links = [(i, i + 1) for i in range(70)] + [(500, 500 + i) for i in range(1, 120)] + [(r.randint(1000, 1060), r.randint(1000, 1060)) for _ in range(50)] + [(5, 5)]
    up = {x: x for e in links for x in e}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    t = graph.Tables(spark)
    got = graph.components(t, spark.createDataFrame(links, "a long, b long"), light, least=10)
    assert {(x.node, x.comp) for x in got.collect()} == set(up.items())


def test_numbered(spark):
    rows = [(g, i) for g, n in ((-3, 1), (0, 500), (4, 7), (9, 60)) for i in range(n)]
    random.Random(1).shuffle(rows)
    got = graph.numbered(graph.Tables(spark), spark.createDataFrame(rows, "g long, i long"), "g", [F.desc("i")], 20).collect()
    size = {g: sum(x[0] == g for x in rows) for g, _ in rows}
    assert sorted((x.g, x.i, x.nth) for x in got) == sorted((g, i, size[g] - 1 - i) for g, i in rows) and len({x.part for x in got}) > 2
