"""Each operator on small tables against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import functools
import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweft.llm import op01_topk, op02_sentencepiece, op03_embedding_dedup, op04_quality, op05_minhash, op06_toxicity, op07_mixture, op08_substrings, op09_langid, op10_records
from docweft.llm.components import components
from docweft.llm.queries import tokenizer_file
from docweft.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
RNG = np.random.default_rng(3)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "rho", "tau", "chi", "psi", "nu", "mu"]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n).tolist())


@functools.cache
def rows():
    base, passage = [prose(120) for _ in range(6)], prose(70)
    near = base[0].split()
    near[7] = "changed"
    texts = [*base, base[0], " ".join(near), base[1].upper(), passage + " " + prose(30), prose(30) + "\n" + passage, "", None, "one", "one", "  ", prose(6000), "é 日本 <|endoftext|> ▁x"]
    out = [(i, t, "xx", f"s{i % 3}" if i % 5 else None, 0, 1.0, "clash") for i, t in enumerate(texts)]
    return [*out, out[2], (None, base[3], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def vectors(spark):
    v = RNG.standard_normal((40, 8))
    v[10] = v[3] * 2
    v[11] = v[3] + 0.01
    data = [(i, [float(x) for x in r], 1.0) for i, r in enumerate(v)]
    data += [(40, None, 0.0), (41, [0.0] * 8, 0.0), (42, [float("nan")] * 8, 0.0), (43, [None] * 8, 0.0), (44, [], 0.0), data[3], (None, data[5][1], 0.0), (45, data[5][1], 0.0)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, score double")


def test_topk(spark):
    df = vectors(spark)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in op01_topk.top_k(df, 5, 10).collect()}
    data = {r.vec_id: np.floor(np.array(r.embedding) * 256) for r in df.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()}
    for q in [k for k in data if k % 10 == 0]:
        order = sorted(((-int(data[q] @ v), k) for k, v in data.items() if k != q))[:5]
        assert [got[q, i + 1] for i in range(5)] == [(k, -s) for s, k in order]
    assert op01_topk.top_k(df.limit(0), 5, 10).count() == 0


def test_embedding_links(spark):
    df = vectors(spark)
    got = {r.vec_id: r for r in op03_embedding_dedup.near_duplicates(df, 0.95, block=4).collect()}
    data = {r.vec_id: np.array(r.embedding) for r in df.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    links = {(a, b) for a, b in itertools.permutations(data, 2) if data[a] @ data[b] / np.linalg.norm(data[a]) / np.linalg.norm(data[b]) >= 0.95}
    assert set(got) == set(range(46))
    for k, r in got.items():
        assert r.n_links == sum(a == k for a, _ in links)
    assert (got[11].component_id, got[10].kept, got[3].kept, got[45].component_id, got[41].kept) == (3, False, True, 5, True)
    assert op03_embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", range(12, 31))
def test_embedding_tables_grow_with_bits(spark, monkeypatch, bits):
    used = []
    monkeypatch.setattr(op03_embedding_dedup, "_hashed", lambda rows, tables, bits, width: used.append((tables, bits)) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        op03_embedding_dedup.near_duplicates(vectors(spark).limit(3), bits=bits)
    (tables, own), agree = used[0], (1 - np.arccos(0.95) / np.pi) ** bits
    assert own == bits and (1 - agree) ** tables <= 1 / 34_000


def test_embedding_pairs_found_at_22_bits(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9501 * a + (1 - 0.9501**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([a, b]))]
    got = op03_embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"), bits=22)
    assert got.where("n_links = 1 and component_id = vec_id % 1500").count() == 3000


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 100), *[(300, i) for i in range(301, 340)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[200] == 100 and got[339] == 300


@pytest.mark.parametrize("words", [2, 5])
def test_minhash(docs, none, words):
    got = {r.doc_id: r for r in op05_minhash.near_duplicates(docs, words, 80).collect()}
    sets = {r[0]: op05_minhash.shingle_set(r[1], words) for r in rows() if r[0] is not None}
    parent = {k: k for k in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(s), parent[k], parent[k] == k) for k, s in sets.items()}
    assert op05_minhash.near_duplicates(none, words).count() == 0
    left = op05_minhash.deduplicated(docs, words)
    assert left.columns == docs.columns and left.where("doc_id = 6").count() == 0 and left.where("doc_id is null").count() == 1


def test_minhash_group_of_edited_copies(spark):
    base, out = [f"w{i}" for i in range(150)], []
    for i in range(120):
        own = list(base)
        for j in RNG.choice(150, int(RNG.integers(2, 16)), replace=False):
            own[j] = f"x{i}_{j}"
        out.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in op05_minhash.near_duplicates(spark.createDataFrame(out, "doc_id long, text string"), 2, 80).collect()}
    sets = {i: op05_minhash.shingle_set(t, 2) for i, t in out}
    parent = {k: k for k in sets}
    for _ in range(20):
        for a, b in itertools.combinations(sets, 2):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


@pytest.mark.parametrize("length", [35, 50])
def test_substrings(docs, none, length):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op08_substrings.removals(docs, length).collect())
    words = [(r[0], (r[1] or "").encode().split()) for r in rows()]
    seen = Counter(tuple(w[i : i + length]) for _, w in words for i in range(len(w) - length + 1))
    want = []
    for k, w in words:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        want.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    assert got == Counter(want)
    assert op08_substrings.removals(none).count() == 0
    left = op08_substrings.cleaned(docs, length)
    assert left.columns == docs.columns and left.where("doc_id = 9").first().text.split() == rows()[9][1].split()[70:]


def test_mixture(docs, none):
    mixed = op07_mixture.mix(docs, keep=("doc_id", "source"))
    got = mixed.collect()
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, mixed.collect()))
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len((r[1] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * sizes[s]}
        for s in full or free:
            target[s] = 3.0 * sizes[s] if full else weight[s] * level
        rest -= sum(target[s] for s in full)
        free = free - full if full else set()
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(0 <= taken[s] - target[s] < 2 * largest[s] or taken[s] == pytest.approx(target[s]) for s in order)
    assert op07_mixture.mix(none).count() == 0
    assert op07_mixture.repeated(mixed).count() == sum(r.taken // r.size for r in got if r.size)


def test_records(spark, docs, none):
    from docweft.llm.units import byte_level

    tokens = byte_level(tokenizer_file("byte_bpe_50k.json"))
    at, want = 0, []
    for k, t in sorted(((r[0], r[1]) for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*tokens.whole((t or "").encode()), 2], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    got = op10_records.token_records(spark, docs, tokenizer_file("byte_bpe_50k.json"), 2).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert op10_records.token_records(spark, none, tokenizer_file("byte_bpe_50k.json"), 2).count() == 0
    data = op10_records.frame(op10_records.pack(None, np.arange(3), 2))
    assert op10_records.unpack(op10_records.unframe(data, 0)[0])[0] is None
    with pytest.raises(ValueError):
        op10_records.unframe(data[:-1] + bytes([data[-1] ^ 1]), 0)


def test_sentencepiece(docs, none):
    model = tokenizer_file("piece_bpe_32k.model")
    assert op02_sentencepiece.parity(model, [(r[1] or "") for r in rows()] + ["  a  b\n\nc ", " ", "\t", "x▁▁y", "😀 ü"]) == []
    got = op02_sentencepiece.encode_decode(docs, model, with_text=True).collect()
    assert len(got) == docs.count() and all(r.decodes for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[12] == 0
    assert all(zlib.crc32(np.array(r.input_ids, "<u4")) == r.ids_crc32 for r in got)
    assert op02_sentencepiece.encode_decode(none, model).count() == 0


def test_classifiers(spark, docs, none):
    good = [(i, prose(60), "en", "s", 0, 0.0, "") for i in range(1000, 1120)]
    bad = [(i, " ".join(w + "!!" for w in prose(60).upper().split()), "de", "s", 0, 0.0, "") for i in range(2000, 2120)]
    foul = [(i, prose(40) + " scoundrel " + prose(20), "en", "s", 0, 0.0, "") for i in range(3000, 3120)]
    df = spark.createDataFrame([*good, *bad, *foul, *rows()], DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] < 2000 or r[0] >= 3000), int(r[0] >= 3000)) for r in [*good, *bad, *foul]] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    q = op04_quality.quality(df, labels).where("doc_id >= 1000 and held_out").collect()
    assert q and all(r.predicted == int(not 2000 <= r.doc_id < 3000) and 0 <= r.score <= 1 for r in q)
    t = op06_toxicity.toxicity(df, labels).where("doc_id >= 1000 and held_out").collect()
    assert t and np.mean([r.predicted == int(r.doc_id >= 3000) for r in t]) > 0.95
    for found in (op04_quality.quality(df, labels), op06_toxicity.toxicity(df, labels)):
        assert found.count() == df.count() and found.where("score is null or score < 0 or score > 1").count() == 0
    assert op04_quality.quality(none, labels).count() == 0 and op06_toxicity.toxicity(none, labels.limit(0)).count() == 0
    assert op04_quality.quality(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    kept = op04_quality.accepted(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id between 2000 and 2999").count() == 0


def test_toxicity_reads_all_of_long_tokens():
    for n in (1, 39, 40, 41, 76, 77, 300, 5000):
        raw = bytes(RNG.integers(97, 123, n, dtype=np.uint8))
        texts = op06_toxicity.Texts(np.frombuffer(raw + b" tail" + raw, np.uint8), np.array([0, n + 5, 2 * n + 5]))
        words = op06_toxicity.tokens(texts)
        own = [texts.data[a:b].tobytes() for a, b in zip(words.start[: words.of[1]], words.end[: words.of[1]], strict=True)]
        assert own.pop() == b"tail" and max(map(len, own)) <= op06_toxicity.LONGEST
        assert {raw[i : i + 5] for i in range(max(n - 4, 1))} == {x[i : i + 5] for x in own for i in range(max(len(x) - 4, 1))}
        assert own[0] == raw[:40] and own[-1] == raw[-40:] and len(own) == len(words) - words.of[1]
    good, foul = ["_".join(prose(12).split()) for _ in range(200)], ["_".join([*prose(6).split(), "scoundrel", *prose(6).split()]) for _ in range(200)]
    net = op06_toxicity.train([x.encode() for x in good[:150] + foul[:150]], np.repeat([0, 1], 150))
    held = pa.array(good[150:] + foul[150:])
    scores = op06_toxicity.Scorer(net).score(op06_toxicity.views(held))
    assert np.mean((scores > 0.5) == np.repeat([False, True], 50)) > 0.9


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in op06_toxicity._start(rng, 5).items()}
    x, mask, y = rng.standard_normal((5, 3, 16)), np.arange(5)[:, None] < np.array([5, 3, 1]), np.array([1.0, 0.0, 1.0])
    g, d_x, _ = op06_toxicity.gradients(p, x, mask, y)

    def loss():
        z = op06_toxicity.forward(p, x, mask)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    for name, (array, grad) in {**{k: (p[k], g[k]) for k in ("Wf", "Ub", "bf", "A", "a", "o", "c")}, "x": (x, d_x)}.items():
        at = tuple(rng.integers(0, n) for n in array.shape)
        keep, eps = array[at], 1e-3
        array[at] = keep + eps
        up = loss()
        array[at] = keep - eps
        slope = (up - loss()) / (2 * eps)
        array[at] = keep
        assert grad[at] == pytest.approx(slope, rel=0.05, abs=2e-4), name


def test_language_likelihood_sums_all_segmentations():
    pieces = sorted({bytes([i]) for i in range(256)} | {b" a", b"ab", b" ab", b"bc"})
    model = op09_langid.train([b"ab abc", b"bc bcb"], ["x", "y"], pieces)
    texts = op09_langid.Texts(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))
    scorer = op09_langid.Scorer(model)
    row = scorer._score(texts, np.array([0]), np.array([3]))[0]
    chance = {p: model.chance[i] for i, p in enumerate(pieces)}

    def total(raw):
        return sum((chance[raw[:n]] * total(raw[n:]) for n in range(1, len(raw) + 1) if raw[:n] in chance), np.zeros(2)) if raw else np.ones(2)

    assert np.exp(row) == pytest.approx(total(b" abc"), rel=1e-4)


def test_languages(spark, docs, none):
    a = [(i, " ".join(RNG.choice(["the", "house", "with", "green"], 30)), "en", "s", 0, 0.0, "") for i in range(100)]
    b = [(i, " ".join(RNG.choice(["das", "haus", "mit", "grün"], 30)), "de", "s", 0, 0.0, "") for i in range(100, 200)]
    more = [(300, "12 34 !!", "en", "s", 0, 0.0, ""), (301, None, "en", "s", 0, 0.0, ""), (302, "the", None, "s", 0, 0.0, "")]
    vocabulary = tokenizer_file("piece_bpe_32k.model")
    got = {r.doc_id: r for r in op09_langid.languages(spark.createDataFrame([*a, *b, *more], DOCS), vocabulary).collect()}
    assert all(got[i].lang_pred == ("en" if i < 100 else "de") for i in range(200))
    assert (got[300].lang_pred, got[301].lang_pred, got[302].lang_pred) == ("und", "und", "en")
    assert op09_langid.languages(none, vocabulary).count() == 0
    assert op09_langid.languages(docs.where("lang is null"), vocabulary).where("lang_pred <> 'und'").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "tokens" or out.columns == names
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ours = corpus_pipeline.run(spark, sf).select("doc_id", "ids_crc32").collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, docs.select("doc_id", "ids_crc32").collect()))
    assert docs.where("not decodes").count() == 0 and docs.count() > 50


def test_pipeline_keeps_one_of_repeated_and_null_id_rows(spark):
    import corpus_pipeline

    a, b, c, d = (prose(90) for _ in range(4))
    rows = [(1, a), (1, a), (1, a.upper()), (2, b), (2, c), (2, c), (None, d), (None, d), (None, b), (5, a), (6, ""), (6, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    once = corpus_pipeline.near_dedup(spark, docs, "")
    assert once.columns == docs.columns
    left = corpus_pipeline.substring_dedup(spark, once, "").select("doc_id", "text").collect()
    want = Counter([(1, min(a, a.upper())), (2, b), (2, c), (None, d), (6, ""), (None, None)])
    assert Counter((r.doc_id, r.text) for r in once.collect()) == want
    assert Counter((r.doc_id, r.text) for r in left if r.text) == Counter({k: n for k, n in want.items() if k[1]})


def test_pipeline_draws_by_quality_labels(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, "plain words of one kind", "en", "ab"[i % 2], 23) for i in range(800)]
    rows += [rows[0], (None, "no id", "en", "a", 5), (None, "no id", "en", None, 5), (0, "", "en", "a", 0), (0, None, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(800)] + [(0, None), (None, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter(map(tuple, corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect()))
    rated = docs.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    mixed = op07_mixture.mix(rated, quality=op07_mixture.by_label(F.col("quality")), keep=tuple(docs.columns))
    assert got == Counter(map(tuple, op07_mixture.repeated(mixed).select(*docs.columns).collect()))
    good, bad = (sum(n for r, n in got.items() if r[3] == "a" and r[0] is not None and r[0] // 2 % 2 == y) for y in (1, 0))
    assert good > 1.5 * bad > 0
