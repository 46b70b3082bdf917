"""The numbered queries and the pipeline as they are registered, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rollprobe.llm import quality, toxicity
from rollprobe.llm.chunk_tokens import Encoder, SpacelessEncoder, tokenizer_path
from rollprobe.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, part string, score double"


def rows_of(seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    bad = ["zzugly", "qqvile", "xxfoul"]
    out = []
    for i in range(150):
        n = r.randint(1, 120)
        t = " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
        if i % 10 == 0:
            t += " " + " ".join(r.choice(bad) for _ in range(8))
        if i % 7 == 0:
            t = " ".join("$$%% ## 123" for _ in range(n))
        out.append((i, t))
    out += [(200, out[1][1]), (201, out[1][1] + " one"), (202, out[2][1]), (300, None), (301, ""), (302, "  \n\t "), (303, "a" * 60000), (304, "x y"), (305, "Ünï ça ß"), (306, "tail "), (None, "no id at all here"), (None, None)]
    out += [out[5], (6, "another text of a repeated id")]
    return [(i, t, "en", None if k % 13 == 0 else f"s{k % 3}", len(t or ""), k, "p", 0.5) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs = rows_of()
    spark.createDataFrame(docs, SCHEMA).coalesce(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(not re.search(r"[$#%]", t or "")), int("zzugly" in (t or "") or "qqvile" in (t or "") or "xxfoul" in (t or ""))) for i, t, *_ in docs if i is not None and i < 150] + [(None, 1, 1), (3, None, None), (4, 7, 7)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    r = np.random.default_rng(2)
    vectors = [(i, r.standard_normal(6).tolist(), 0) for i in range(130)] + [(500, None, 0), (550, [0.0] * 6, 0), (600, [float("nan")] * 6, 0), (650, [1e300] * 6, 0), (700, [1e300] * 6, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    pages = [(1, "u", "<html><body><nav>Menu</nav><article><p>One  two.</p><p class=it's>Three &amp; four.</p></article></body></html>"), (2, "u", None), (3, None, ""), (4, "u", "<p>" + "long " * 20000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    turns = [(c, t, "user" if t % 2 else None, f"turn {t} of {c // 3}") for c in range(20) for t in range(c % 6)] + [(3, None, "user", None), (None, 1, "user", "x"), (40, 1, "user", "turn 1 of 0")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{at}/conversations.parquet")
    return at, docs


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def held(i, modulus, rest):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == rest


@pytest.fixture(scope="module")
def got(spark, tables):
    return lambda name: QUERIES[name](spark, tables[0])


def test_op1(got, tables):
    df = got("op1_ngram_jaccard_join")
    assert df.columns[:3] == ["doc_id", "n_shingles", "component_id"] and dict(df.dtypes)["n_shingles"] == "bigint"
    rows = df.collect()
    assert key([(r.doc_id,) for r in rows]) == key([(d[0],) for d in tables[1]])
    by = {r.doc_id: r for r in rows}
    assert by[200].component_id == 1 and by[202].component_id == 2 and by[301].component_id == 301 and by[301].n_shingles == 0 and by[304].n_shingles == 1


@pytest.mark.parametrize("name,modulus,rest,threshold", [("op2_quality_classifier", 5, 0, 0.3), ("op4_toxicity", 3, 1, 0.7)])
def test_scores(got, tables, name, modulus, rest, threshold):
    df = got(name)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = df.collect()
    assert key([(r.doc_id,) for r in rows]) == key([(d[0],) for d in tables[1]])
    for r in rows:
        assert r.held_out == held(r.doc_id, modulus, rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)


def test_scores_equal_a_plain_loop(spark, tables):
    """Gated attention and votes, one document and one passage at a time."""
    docs, labels = (spark.read.parquet(f"{tables[0]}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels)
    texts = {d[0]: d[1] or "" for d in tables[1] if d[0] is not None and d[0] < 50 and d[0] not in (5, 6)}
    scores = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    for i, t in texts.items():
        x, _ = quality.passages(pa.array([t]))
        raw, hs = [], []
        for p in x:
            h = np.tanh(((p - m.mean) * m.scale) @ m.p["W"] + m.p["b"])
            gate = 1 / (1 + np.exp(-(h @ m.p["U"])))
            raw.append(float((np.tanh(h @ m.p["V"]) * gate) @ m.p["w"]))
            hs.append(h)
        a = np.exp(np.array(raw) - max(raw))
        z = sum(w * h for w, h in zip(a / a.sum(), hs))
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-(z @ m.p["c"] + m.p["d"][0]))), abs=1e-4)
    m = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert len(m.lexicon)
    for i, t in texts.items():
        row, term, words = toxicity.terms(pa.array([t]))
        votes = [float(v in set(term.tolist())) for v in m.lexicon.tolist()]
        hits = sum(v in set(m.lexicon.tolist()) for v in term.tolist())
        plain = re.findall(r"[A-Za-z\x80-\U0010ffff]+", t)
        votes += [sum(len(w) >= 3 and w.isascii() and w.isupper() for w in plain) > 0.3 * max(len(plain), 1), bool(re.search(r"[!?]{2}", t)), hits >= 2, hits >= 6, hits > 0.004 * max(len(plain), 1), hits == 0]
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-(np.array(votes, float) @ m.weights + m.bias))), abs=1e-5)


def test_op3(got):
    rows = got("op3_approximate_nearest_neighbours").collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == [0, 50, 100, 650, 700] and all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in by.values())
    assert sorted(by[650])[0][1] == 700 and sorted(by[650])[0][2] == pytest.approx(1.0)


def test_op5_and_op9(got, tables):
    enc = Encoder(tokenizer_path("byte_bpe_50k.json"))
    ids = [(d[0], np.append(np.frombuffer(enc.raw([d[1] or ""])[0], "<u2"), 2).astype("<u4"), len((d[1] or "").encode())) for d in tables[1]]
    rows = got("op5_token_output").collect()
    assert key([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows]) == key([(i, len(x), zlib.crc32(x.tobytes())) for i, x, _ in ids])
    rows = got("op9_token_counts").collect()
    assert key([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows]) == key([(i, n, len(x) - 1, len(x) - 1 > 512) for i, x, n in ids])


def test_op6(got, tables):
    want = []
    for d in tables[1]:
        raw = (d[1] or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((d[0], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    rows = got("op6_media_columns").collect()
    assert key([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows]) == key(want)


def packed_well(rows, texts):
    enc = SpacelessEncoder(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in texts:
        ids = np.append(np.frombuffer(enc.raw([t or ""])[0], "<u2"), 0).astype("<u4")
        want += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert key([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]) == key(want)
    by, gaps = {}, []
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for n in sorted((w[3] for w in want), reverse=True):  # one piece after another into the best gap opens as many
        fit = min((g for g in gaps if g >= n), default=2048)
        if fit in gaps:
            gaps.remove(fit)
        gaps.append(fit - n)
    assert len(by) == len(gaps)


def test_op7(got, tables):
    packed_well(got("op7_best_fit_packing").collect(), [(d[0], d[1]) for d in tables[1]])


def test_op8(got):
    rows = {r.page_id: r for r in got("op8_html_extraction").collect()}
    assert sorted(rows) == [1, 2, 3, 4] and rows[2].text == "" and rows[3].text == "" and all(r.n_chars == len(r.text) for r in rows.values())
    assert "<" not in rows[1].text and "Three & four." in rows[1].text


def test_op10(got, tables):
    rows = got("op10_mixing").collect()
    assert key([(r.doc_id, r.source) for r in rows]) == key([(d[0], d[3]) for d in tables[1]])
    assert sorted(r.position for r in rows) == list(range(len(rows)))


def test_op11_to_op13(got, tables):
    """Registered with the parameters of their contracts; the operators themselves are held against plain loops elsewhere."""
    rows = got("op11_hard_negatives").collect()
    assert {r.anchor_id for r in rows} <= {0, 100, 700} and all((r.negative_id % 7 == 0) != (r.anchor_id % 7 == 0) for r in rows) and rows[0].asDict().keys() == {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"}
    rows = got("op12_prefix_trie").collect()
    root = [r for r in rows if r.depth == 0]
    assert len(root) == 1 and root[0].parent_conv_id is None and root[0].n_convs == 17 and sum(r.n_children == 0 for r in rows) == root[0].n_leaves
    rows = got("op13_simhash").collect()
    assert key([(r.doc_id,) for r in rows]) == key([(d[0],) for d in tables[1]]) and all(len(r.fingerprint) == 16 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[200].fingerprint == by[1].fingerprint and by[200].component_id == by[1].component_id and by[300].fingerprint == "0" * 16 and by[302].component_id == by[300].component_id == by[301].component_id


def test_pipeline(spark, tables):
    """run() against a plain chain: scores of the same models, sets compared pair by pair, packing checked piece by piece."""
    at, docs = tables
    labels = spark.read.parquet(f"{at}/labels.parquet")
    frame = spark.read.parquet(f"{at}/documents.parquet")
    m = toxicity.fit(frame, labels.where(~quality.held_out(3, 1)))
    left = [d for d in docs if toxicity.predict(pa.array([d[1] or ""]), m)[0] < 0.7]
    assert len(left) < len(docs)
    m = quality.fit(spark.createDataFrame(left, SCHEMA), labels.where(~quality.held_out(5, 0)))
    left = [d for d in left if m.forward(*quality.passages(pa.array([d[1] or ""])))["y"][0] >= 0.3]
    sets, up = {}, {}
    for d in left:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda x: x.group().lower(), (d[1] or "").encode()))
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        if d[0] is not None:
            sets.setdefault(d[0], []).append(s)
            up[d[0]] = d[0]
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and up[a] != up[b] and any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((up[a], up[b]))
                up = {k: low if v == high else v for k, v in up.items()}
    seen, kept = set(), []
    for d in left:
        name = (d[0], d[1]) if d[0] is None else d[0]
        if (d[0] is None or up[d[0]] == d[0]) and name not in seen:
            seen.add(name)
            kept.append((d[0], d[1]))
    rows = corpus_pipeline.run(spark, at).collect()
    texts = {}
    for d in docs:
        texts.setdefault(d[0], []).append(d[1])
    assert {(r.doc_id) for r in rows} == {i for i, _ in kept}
    single = [(i, t) for i, t in kept if len(texts[i]) == 1]
    enc = SpacelessEncoder(tokenizer_path("word_bpe_49k.json"))
    n = {}
    for r in rows:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.length
    for i, t in single:
        assert n[i] == len(enc.raw([t or ""])[0]) // 2 + 1
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in ends.values():
        assert sum(x for _, x in spans) <= 2048 and sorted(spans)[0][0] == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]


def test_empty_tables(spark, tables, tmp_path):
    at = tables[0]
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
