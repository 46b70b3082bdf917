"""Operators against brute force, exact round trips and odd rows (nulls, empty, repeated, clashing columns)."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollprobe.llm import ann, common, html_extract, jaccard_join, media, mixing, packing, quality, token_counts, token_output, toxicity
from rollprobe.llm.chunk_tokens import Encoder, SpacelessEncoder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["Naïve Café's ŸŽ ĲŁ", "İstanbul ıı ſs", "x'll 'Tis I'M a-b,c. (d) 12,5% e@f.gh", "ab" * 300 + " " + "7" * 200, "a  b", "\n a", "foo <|endoftext|> bar", "don't  we'll\n\nx", "  lead", " trail ", "é́x Ω ΣΑΣ", "\x1cq w", "", " ", "\n", "a\tb c", "aaaaaaaaa aaaa"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(6, 120))) for _ in range(40)]
    texts = list(base)
    for t in base[:15]:
        for cut in (1, 3, 6):
            w = t.split()
            for _ in range(cut):
                w[r.randrange(len(w))] = "x"
            texts.append(" ".join(w))
    texts += [base[0]] * 12 + [base[1].upper()] + ["one two", "one two", "", None, "three", *ODD] + ["shared line of eight words stands here now " + " ".join(r.choice(words) for _ in range(12)) for _ in range(20)]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(rows):
    out = {}
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (r.text or "").encode()))
        out[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize("small,block", [(64, 512), (2, 3)])
def test_jaccard_join_is_exact(spark, docs, monkeypatch, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    sets = shingle_sets(docs.collect())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = jaccard_join.jaccard_join(docs.withColumn("node", F.lit("clash"))).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), root(i)) for i, s in sets.items()}
    if small == 64:
        kept = jaccard_join.deduplicate(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({root(i) for i in sets})
        assert jaccard_join.jaccard_join(empty(spark)).count() == 0


@pytest.mark.parametrize("block,columns", [(512, 4096), (3, 50)])
def test_jaccard_join_counts_every_link(spark, docs, monkeypatch, block, columns):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "COLUMNS", columns, raising=False)
    w = [f"v{i}" for i in range(90)]
    near = [" ".join([*w[:k], "x", *w[k + 1 :]]) for k in range(0, 90, 4)]  # all linked with each other
    rows = spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate([*near, near[0]])], SCHEMA)
    sets = shingle_sets(docs.union(rows).collect())
    texts = {frozenset(u) for u in sets.values() if u}
    linked = lambda u, v: u != v and 5 * len(u & v) >= 4 * len(u | v)
    want = {i: sum(linked(u, v) for v in texts) for i, u in sets.items()}
    assert max(want.values()) >= len(near) - 1
    assert {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(docs.union(rows)).collect()} == want


def test_pivots_give_one_row_a_member(spark, monkeypatch):
    """Rows of regions do not multiply by their pivots."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    w, seen = [f"v{i}" for i in range(90)], []
    texts = [" ".join("x%d" % i if p in (k, (k + 7 * i) % 90) else t for p, t in enumerate(w)) for i, k in enumerate(range(2, 90, 2))]
    cut = jaccard_join._Join.to_pivots

    def watched(self, large, depth):
        out = self.keep(cut(self, large, depth))
        seen.append((large.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join._Join, "to_pivots", watched)
    assert jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)
    assert seen and all(a == b for a, b in seen)


def test_regions_hold_rows_that_can_link(spark, monkeypatch):
    """A row stays in a region only where its shingle can be the first that it shares; no link goes by that."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 12)
    monkeypatch.setattr(jaccard_join, "BLOCKS", 2, raising=False)
    r, w, most = random.Random(3), [f"v{i}" for i in range(90)], []
    edits = [r.sample(range(90), r.randint(1, 3)) for _ in range(48)]
    near = [" ".join(f"x{i}" if p in at else t for p, t in enumerate(w)) for i, at in enumerate(edits)]
    of = jaccard_join._Join.regions

    def watched(self, rows):
        out = of(self, rows)
        most.append(max(r["count"] for r in out.groupBy("node").count().collect()))
        return out

    monkeypatch.setattr(jaccard_join._Join, "regions", watched)
    for more in ([], [" ".join(w[k : k + 72 + k]) for k in range(10)]):  # sets of one size, then of several
        rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*near, *more])], SCHEMA)
        sets = shingle_sets(rows.collect())
        linked = {(a, b) for a in sets for b in sets if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
        least = {i: i for i in sets}
        for _ in sets:
            for a, b in linked:
                least[a] = min(least[a], least[b])
        got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_join(rows).collect()}
        assert got == {i: (least[i], sum(a == i for a, _ in linked)) for i in sets}
    assert most[0] <= 10  # of 18 in the prefix of 86 shingles: 9 * (86 - pos) >= 4 * (86 + 86)


def test_jaccard_join_of_overlapping_chains(spark, monkeypatch):
    """Windows that slide over common texts: long chains of links, regions that are cut into cells, cells cut again."""
    for name, value in (("SMALL", 6), ("BLOCK", 8), ("PIVOTS", 4), ("BLOCK_SHINGLES", 400)):
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(11)
    texts = []
    for t in range(5):
        words, at = [f"t{t}w{r.randrange(4000)}" for _ in range(900)], 0
        while at < 700:
            n = r.choice((40, 60, 80))
            texts.append(" ".join(words[at : at + n]))
            at += r.choice((1, 2, 5, 9, 30))
    texts = [x for x in texts if r.random() < 0.6] + ["common head of many documents here " + " ".join(f"u{r.randrange(9999)}" for _ in range(9)) for _ in range(30)]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = shingle_sets(df.collect())
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and up[a] != up[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((up[a], up[b]))
                up = {k: low if v == high else v for k, v in up.items()}
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(df).collect()}
    assert got == up and len(set(up.values())) > 40


def test_jaccard_join_keeps_chained_members_of_a_large_region(spark):
    """x and its 70 variants hang on the pivot p by a chain (z), were never measured against it, and alone link y."""

    def hashes(words):
        return np.unique(common.shingles(common.Words(pa.array([" ".join(words)])), 1)[0])

    def node(words):
        u = hashes(words)
        return (common.mix(u, 11).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(common.mix(u, 12))).view(np.int64)

    often = sorted((f"c{i}" for i in range(99)), key=lambda w: hashes([w])[0])
    core, e = often[:88], often[88:]  # e: in all but the pivot
    x = {"b", *core, *e}
    fillers = [(x - {"b", core[20 + i % 60]}) | {f"f{i}", "e_" + str(i)} for i in range(70)]
    y = (x - {"b", *core[9:20]}) | {"y0", "y1"}
    for t in range(10000):
        own = [f"p{t}_{i}" for i in range(12)]
        p, z = {*own, *core}, {*own[:5], "b", *core, *e[:6]}
        if node(p) < min(map(node, [x, y, z, *fillers])) and node(z) > min(map(node, fillers)):
            break
    sets = dict(enumerate([p, z, x, y, *fillers]))
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n) and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = {k: low if v == high else v for k, v in up.items()}
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_join(df, k=1).collect()} == set(up.items())


def test_tokens_equal_the_library(docs):
    texts = [r.text or "" for r in docs.collect()]
    for enc in (Encoder(BYTE), SpacelessEncoder(WORD)):
        assert enc.encode(texts) == enc.raw(texts)


def test_token_counts(spark, docs):
    enc = Encoder(BYTE)
    want = {(r.doc_id, len((r.text or "").encode()), len(enc.raw([r.text or ""])[0]) // 2) for r in docs.collect()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, BYTE).collect()} == want
    assert token_counts.token_counts(empty(spark), BYTE).count() == 0


def test_token_files_round_trip(spark, docs):
    """One row a document, repeated and null ids too; starts run over all documents in ascending doc_id order."""
    odd = docs.union(spark.createDataFrame([(7, "another text", "en", "s", 1), (7, "", "en", "s", 1), (None, "no id", "en", "s", 1), (None, None, "en", "s", 1)], SCHEMA)).withColumn("ids", F.lit("clash"))
    rows, enc = odd.collect(), Encoder(BYTE)
    want = []
    for r in rows:
        ids = np.append(np.frombuffer(enc.raw([r.text or ""])[0], "<u2"), 2).astype("<u4")
        want.append((r.doc_id is not None, r.doc_id or 0, len(ids), zlib.crc32(ids.tobytes())))
    got = token_output.token_output(odd, BYTE, 2).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.found
        at += r.n_tokens
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    assert token_output.token_output(empty(spark), BYTE, 2).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    index = token_output.Index.load(token_output.Index.build(keys, keys % 7, np.arange(len(keys)), keys % 9).dump())
    assert sorted(index.hash.slots(keys)) == list(range(len(keys)))
    found, slots = index.look(keys)
    assert found.all() and (slots["first"] == np.arange(len(keys))).all() and not index.look(keys + 1)[0][~np.isin(keys + 1, keys)].any()


def test_packing(spark, docs):
    size, enc = 64, SpacelessEncoder(WORD)
    got = packing.pack(docs, WORD, 0, size).collect()
    total = sum(len(enc.raw([r.text or ""])[0]) // 2 + 1 for r in docs.collect())
    assert sum(r.length for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    # sequential best-fit decreasing opens as many
    gaps = []
    for n in sorted((r.length for r in got), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((size if fit is None else fit) - n)
    assert len(by) == len(gaps)
    assert packing.pack(empty(spark), WORD, 0, size).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix(docs.withColumn("slot", F.lit(1)), {"s0": 3, "s1": 1, None: 2}, block=2)
    rows = sorted(got.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(docs.count())) and "_slot" in got.columns
    units = {"s0": 3, "s1": 1, "s2": 1, None: 2}
    seen, slots = dict.fromkeys(units, 0), sorted({(r._slot, r.mix_source) for r in rows}, key=lambda x: x[0])
    left = {s: -(-sum(r.mix_source == s for r in rows) // 2) for s in units}
    for n, (_, s) in enumerate(slots, 1):
        seen[s] += 1
        assert all(abs(seen[k] - n * u / 7) < 1 for k, u in units.items())
        if seen[s] == left[s]:
            break
    assert mixing.mix(empty(spark)).count() == 0


def test_pfair_deviates_less_than_one():
    r = random.Random(2)
    for _ in range(30):
        units = [r.randint(1, 9) for _ in range(r.randint(1, 7))]
        done = [0] * len(units)
        for n, i in enumerate(mixing.pfair(units), 1):
            done[i] += 1
            assert all(abs(d - n * u / sum(units)) < 1 for d, u in zip(done, units))


def test_media_round_trip(spark, docs):
    files = media.to_media(docs)
    for r, t in zip(media.digests(files).collect(), docs.collect(), strict=True):
        raw = (t.text or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert media.clip_rows(files).count() >= docs.count()
    payload = os.urandom(6400) + b"\xff" * 640
    back, avi, _ = media.read_avi(media.write_avi(payload))
    info, scan = media._split(avi.frames[-1])
    assert back == payload and (media._huffman(info, scan) == media.decode_frame(avi.frames[-1])[0]).all()
    assert media.digests(media.to_media(empty(spark))).count() == 0


def test_null_and_damaged_media(spark):
    whole = media.write_avi(b"x" * 640)
    df = spark.createDataFrame([(1, 640, whole), (2, 0, None), (3, 640, whole[: len(whole) // 2]), (4, 1, b"RIFF")], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.digests(df.withColumn("feature", F.lit("clash"))).collect()}
    assert got[1].payload_bytes == 640 and got[2].media_bytes is None and got[3].media_bytes == len(whole) // 2 and all(got[k].payload_sha256 is None and got[k].feature is None for k in (2, 3, 4))
    assert {r.doc_id for r in media.clip_rows(df).collect()} == {1}


def test_shots():
    bins = np.repeat([[10, 0], [0, 10]], 15, axis=0)
    assert media.shots(bins) == [0, 15] and media.shots(np.zeros((0, 2))) == []


def test_nearest_neighbours(spark):
    x = np.random.default_rng(1).standard_normal((600, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(600, None, 0), (601, [0.0] * 8, 0), (602, [None] * 8, 0), (603, [float("nan")] * 8, 0), (700, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ann.search(df, F.col("vec_id") % 50 == 0).toPandas()
    full = np.concatenate([x, x[:1]]).astype(float)
    ids = np.append(np.arange(600), 700)
    unit, hits, total = full / np.linalg.norm(full, axis=1, keepdims=True), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -9
        best = ids[np.lexsort((ids, -s.round(12)))[:5]]
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert len(own) == 5 and list(own["rank"]) == [1, 2, 3, 4, 5]
        hits += len(set(best) & set(own.vec_id))
        total += 5
    assert hits / total >= 0.9
    assert ann.search(df.where("vec_id in (600, 601)"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_neighbours_in_two_levels(spark, monkeypatch):
    """Partitions that are cut again, components of very different size, and a cluster smaller than ``top``."""
    monkeypatch.setattr(ann, "LEAF", 150)
    r = np.random.default_rng(8)
    centre = r.standard_normal((24, 12))
    x = centre[r.integers(0, 24, 1500)] + 0.3 * r.standard_normal((1500, 12))
    scale = np.where(np.arange(1500) % 3 == 0, 1e-200, np.where(np.arange(1500) % 3 == 1, 1e200, 1.0))
    df = spark.createDataFrame([(i, (v * c).tolist()) for i, (v, c) in enumerate(zip(x, scale))], "vec_id long, embedding array<double>")
    got = ann.search(df.withColumn("part", F.lit("clash")), F.col("vec_id") % 50 == 0, parts=4).toPandas()
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -9
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and np.allclose(own.score, s[own.vec_id], atol=1e-12)
        hits += len(set(np.argsort(-s)[:5]) & set(own.vec_id))
    assert hits / (30 * 5) >= 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_the_whole_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(e, F.col("vec_id") % 50 == 0).toPandas()
    pdf = e.toPandas()
    x, ids = np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(got[got.query_id == ids[q]].vec_id))
        total += 5
    assert hits / total >= 0.9


def test_probe_reaches_its_recall_on_unseen_vectors():
    """Noise has no partitions to learn: a probe chosen on the training rows promises more than it holds."""
    r = np.random.default_rng(4)
    x, fresh = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in r.standard_normal((2, 600, 64)))
    router = ann.train(x, 16, 5, 0.97)
    order = np.argsort(-router.scores(fresh), axis=1, kind="stable")
    reached = (order[:, None, : router.probe] == order[ann.graph(fresh, 5), :1]).any(axis=2).mean()
    assert router.recall >= 0.97 and reached >= 0.97


@pytest.mark.parametrize("step", [1, -1])
def test_equal_vectors_go_by_id(spark, step):
    r = np.random.default_rng(77)
    v = r.standard_normal(77)
    x = [r.standard_normal(77) if i % 3 else v for i in range(123)]
    rows = [(i, a.tolist()) for i, a in enumerate(x)][::step]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") % 3 == 0).toPandas()
    for q, own in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        assert list(own.vec_id) == [i for i in range(0, 123, 3) if i != q][:5]


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    for module, label, rest, threshold, least in ((quality, "quality", (5, 0), 0.3, 0.95), (toxicity, "toxic", (3, 1), 0.7, 0.93)):
        model = module.fit(docs, labels.where(~quality.held_out(*rest)), label)
        got = module.score(docs, model).toPandas().merge(labels.where(quality.held_out(*rest)).toPandas(), on="doc_id")
        assert ((got.score >= threshold).astype(int) == got[label]).mean() >= least
        odd = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 200000)], "doc_id long, text string")
        assert all(0 <= r.score <= 1 for r in module.score(odd, model).collect())
        assert module.score(empty(spark), model).count() == 0


def test_html(spark):
    pages = [(0, "u", None), (1, "u", ""), (2, "u", "<html><body><nav><a href=x>Menu</a></nav><div class=ad>Buy now.</div><article><h1>Title &amp; more</h1><p><b>First   words.<br><p>Second one.</article><footer>&copy; me</footer>"), (2, "u", "plain words")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [r.text for r in html_extract.extract_pages(df).collect()]
    assert got[:3] == ["", "", "Title & more First words. Second one."] and html_extract.extract_pages(df.limit(0)).count() == 0


def test_trees_on_unseen_layouts():
    model, r = html_extract.train(200), np.random.default_rng(99)
    right = total = 0
    for _ in range(60):
        nodes = html_extract.parse(html_extract.layout(r))
        own = html_extract.decode(nodes, model.predict(html_extract.features(nodes)))
        right, total = right + (own == html_extract.truth(nodes)).sum(), total + len(nodes)
    assert right / total > 0.93


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert (out.count() == docs.count()) == (name == "mixing") or name != "mixing"
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
