"""Cases where a plainer implementation goes wrong: equal hashes, repeated and null ids, clashing names, very long texts, skewed samples."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweft.llm import learning, op01_topk, op02_sentencepiece, op03_embedding_dedup, op04_quality, op05_minhash, op06_toxicity, op07_mixture, op08_substrings, op09_langid, op10_records, units
from docweft.llm.queries import tokenizer_file
from docweft.llm.scratch import Scratch
from docweft.llm.words import split, views, word_hashes

BYTES, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
RNG = np.random.default_rng(17)
#: Two words on which every polynomial hash modulo 2**64 agrees.
TWINS = ["".join(pair[i.bit_count() % 2] for i in range(1024)) for pair in ("ab", "ba")]


def words(n, of=400):
    return [f"w{i}" for i in RNG.integers(0, of, n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(2)


def test_different_words_of_one_polynomial_hash(spark):
    tail = " ".join(words(40, 10**6))
    docs = table(spark, [(1, f"x {TWINS[0]} end"), (2, f"x {TWINS[1]} end"), (3, f"{TWINS[0]} {tail}"), (4, f"{TWINS[1]} {' '.join(words(40, 10**6))}")])
    linked = {r.doc_id: r.component_id for r in op05_minhash.near_duplicates(docs, 2, 80).collect()}
    assert linked == {1: 1, 2: 2, 3: 3, 4: 4}
    assert op08_substrings.removals(docs, 35).where("n_removed > 0").count() == 0
    other = op02_sentencepiece.Codec(PIECES_DATA)
    got = {r.doc_id: r.input_ids for r in op02_sentencepiece.encode_decode(docs, PIECES).collect()}
    assert all(got[r.doc_id] == other.whole(r.text.encode()) for r in docs.collect())


PIECES_DATA = open(PIECES, "rb").read()


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(units, "word_hashes", lambda texts, words, lower=False: word_hashes(texts, words, lower) % np.uint64(7))
    encoder = units.byte_level(BYTES)
    texts = ["hello world foo bar", "baz qux  zip", "", "a somewhat internationalisation-longer word", "hello hello", "internationalisation-other"]
    for _ in range(2):
        ids, at = encoder.encode(views(pa.array(texts)))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [encoder.whole(x.encode()) for x in texts]


def test_topk_with_repeated_ids_and_huge_weights(spark):
    schema = "id long, weights array<long>"
    rows = [(1, [1, 1]), (2, [2, 2]), (1, [50, 50]), (2, [1, 1])]
    got = op01_topk.search(spark.createDataFrame([(9, [1, 1])], schema), spark.createDataFrame(rows, schema).coalesce(1), 2, block=2).collect()
    assert [(r.id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 100), (2, 4)]
    # Sums that leave 64 bits rank as they are; only one that must be returned is an error.
    low = [(1, [-(1 << 62), -(1 << 62)]), (2, [5, 5]), (3, [7, 1])]
    got = op01_topk.search(spark.createDataFrame([(9, [4, 4])], schema), spark.createDataFrame(low, schema), 2).collect()
    assert sorted((r["rank"], r.id, r.score) for r in got) == [(1, 2, 40), (2, 3, 32)]
    for x in (1e8, 1e300):
        df = spark.createDataFrame([(50, [x, 1.0]), (1, [x, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            op01_topk.top_k(df).collect()


@pytest.mark.parametrize("ids", [[7] * 100, [None] * 100])
@pytest.mark.parametrize("same", [True, False])
def test_mixture_stops_within_a_document_among_equal_ids(spark, ids, same):
    rows = [(i, "one two three" if same else f"one two {n}", "a") for n, i in enumerate(ids)] + [(1000 + n, f"w {n} x", "b") for n in range(100)]
    mixed = op07_mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert 0 <= r.taken - r.target < 3


def test_index_agrees_before_and_after_compaction_and_when_opened_again(spark, tmp_path):
    passage = words(40, 10**6)
    batches = [[(10 * b + i, " ".join(words(60, 10**6) + passage * (i == b))) for i in range(6)] for b in range(5)]
    folder = f"file://{tmp_path}/index"
    plain = op08_substrings.FingerprintIndex(Scratch(spark, "a"), 35, fanout=99)
    index = op08_substrings.FingerprintIndex(Scratch(spark, "b"), 35, folder=folder)
    for n, rows in enumerate(batches):
        if n == 3:
            index = op08_substrings.FingerprintIndex(Scratch(spark, "c"), 35, folder=folder)
        df = op08_substrings._rows(table(spark, rows), "doc_id", "text")
        found = [{r.fp for r in x.add(df).collect()} for x in (plain, index)]
        assert found[0] == found[1] and bool(found[0]) == (n > 0)
    assert len(plain.runs) == 5 and len(index.runs) == 2


CLASH = ["_id", "_text", "_s", "_key", "_tie", "whole", "_last", "_room", "in", "_gone", "gone", "key", "row", "fp", "k1", "k2", "_k1", "_kept", "kept", "c0", "c1", "n", "words", "draw", "bucket", "copies_"]


def test_clashing_columns_come_back_unchanged(spark):
    base = [(i, " ".join(words(60, 10**6)), "en", "ab"[i % 2]) for i in range(8)]
    base += [(20, base[0][1], "en", "a"), (21, base[1][1] + " more", "en", "b"), (None, "x", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    outs = {
        "mix": op07_mixture.repeated(op07_mixture.mix(docs)),
        "encode": op02_sentencepiece.encode_decode(docs, PIECES),
        "dedup": op05_minhash.deduplicated(docs),
        "nulls": op05_minhash.deduplicated(docs, nulls=True),
        "cleaned": op08_substrings.cleaned(docs, 35),
        "accepted": op04_quality.accepted(docs, labels),
    }
    for name, out in outs.items():
        assert set(CLASH) <= set(out.columns), name
        for r in out.collect():
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in CLASH), name
    assert {r.doc_id for r in outs["dedup"].collect()} == {*range(8), None}


def test_labels_of_absent_documents_take_no_places(spark):
    docs = table(spark, [(i, "good text" if i % 2 else "bad text") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, i % 2) for i in range(1000, 6000)], "doc_id long, quality int")
    sample, share = learning.labelled(docs, labels, "quality", F.lit(True), 10)
    assert sorted(sample.column("y").to_pylist()) == [0] * 10 + [1] * 10 and share == 0.5


def test_no_language_is_lost_beside_a_larger_one(spark):
    rows = [(i, "the house", "en", "s") for i in range(3000)] + [(i, "das haus", "de", "s") for i in range(3000, 3008)] + [(i, "das haus", "de", "s") for i in (4000, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = op09_langid.fit(docs, PIECES, F.lit(True), rows=20)
    assert model.names == ["de", "en"] and np.exp(model.shares) == pytest.approx([10 / 3010, 3000 / 3010])
    got = op09_langid.languages(docs, PIECES, rows=20).where("doc_id >= 3000").select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in got] == ["de"]


def _segments(raw, chance):
    """[sum over all segmentations of raw[:b]] for every b, by the plain recursion."""
    ahead = [np.ones(2)]
    for b in range(1, len(raw) + 1):
        ahead.append(sum((ahead[a] * chance[raw[a:b]] for a in range(b) if raw[a:b] in chance), np.zeros(2)))
    return ahead


def test_a_language_of_many_rows_and_few_ids_is_learned(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(300)] + [(10_000 + i % 3, "der hund und die katze", "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert op09_langid.fit(docs, PIECES, F.lit(True), rows=20).names == ["de", "en"]


@pytest.mark.parametrize("group", [1 << 16, 64, 11])
def test_language_sums_over_whole_words_of_any_length(monkeypatch, group):
    monkeypatch.setattr(op09_langid, "_GROUP", group)
    pieces = sorted({bytes([i]) for i in range(256)} | {b" a", b"ab", b" ab", b"bc", b"abc", b"bcb", b"cabab"})
    lexicon, p = op09_langid.Lexicon(pieces), RNG.random((len(pieces), 2))
    p /= p.sum(axis=0)
    chance = dict(zip(pieces, p, strict=True))
    lifted = np.concatenate([p * op09_langid.LIFT ** lexicon.sizes[:, None], np.zeros((1, 2))])
    own = [bytes(RNG.choice(list(b"abc"), n).tolist()) for n in (1, 2, 15, 16, 17, 33, 50)]
    texts = views(pa.array([b" ".join(own).decode()]))
    found = split(texts)
    size = found.end - found.start
    rows = op09_langid._matrix(texts, found.start, size, int(size.max()))
    ahead = [_segments(b" " + x, chance) for x in own]
    got = op09_langid.forward(rows, lexicon, lifted, size + 1)[0] - (size + 1)[:, None] * np.log(op09_langid.LIFT)
    assert got == pytest.approx(np.log([x[-1] for x in ahead]), rel=1e-9)
    counts, want = RNG.integers(1, 5, (len(own), 2)).astype(float), np.zeros_like(p)
    for x, a, c in zip(own, ahead, counts, strict=True):
        raw = b" " + x
        behind = [None] * len(raw) + [np.ones(2)]
        for i in range(len(raw) - 1, -1, -1):
            behind[i] = sum((behind[b] * chance[raw[i:b]] for b in range(i + 1, len(raw) + 1) if raw[i:b] in chance), np.zeros(2))
        for i, b in itertools.combinations(range(len(raw) + 1), 2):
            if raw[i:b] in chance:
                want[pieces.index(raw[i:b])] += a[i] * chance[raw[i:b]] * behind[b] / a[-1] * c
    assert op09_langid.expected(rows, size + 1, counts, lexicon, lifted) == pytest.approx(want, rel=1e-8)


def test_language_posterior_is_the_product_over_words():
    pieces = sorted({bytes([i]) for i in range(256)} | {b" a", b"ab", b"ba"})
    model = op09_langid.train([b"ab abab", b"ba bbba"], ["x", "y"], pieces, {"x": 3, "y": 1})
    chance = dict(zip(pieces, model.chance, strict=True))
    texts = ["ab ba ab", "bbb", "abab ba", "ü ab"]
    want = []
    for t in texts:
        like = np.exp(model.shares)
        for w in t.encode().split():
            like = like * _segments(b" " + w, chance)[-1]
        want.append(like / like.sum())
    assert np.exp(model.shares) == pytest.approx([0.75, 0.25])
    assert op09_langid.Scorer(model).posterior(views(pa.array(texts))) == pytest.approx(np.array(want), rel=1e-6)


def test_quality_is_the_mean_over_words_pairs_and_character_ngrams():
    table = RNG.standard_normal(op04_quality.BUCKETS).astype(np.float32)
    texts = ["Grüße an alle  alle", "", " a\n", "日本語 x", "ab ab cd ab"]
    column = views(pa.array(texts))
    every = [np.split(buckets, at[1:-1]) for buckets, at in op04_quality.features(column)]
    for i, t in enumerate(texts):
        own, seen = t.split(), [len(kind[i]) for kind in every]
        marked = ["\x01" + w + "\x01" for w in own]
        grams = [[w[j : j + n] for w in marked for j in range(len(w) - n + 1)] for n in op04_quality.GRAMS]
        assert seen == [len(own), max(0, len(own) - 1), *map(len, grams)]
        for k, (n, wanted) in enumerate(zip(op04_quality.GRAMS, grams, strict=True)):
            want = []
            for g in wanted:
                value = 0
                for j, ch in enumerate(g):
                    code = 1 if ch == "\x01" else ord(ch) + 2
                    value = code if j == 0 else (value * 0x01000193 + code) % 2**32
                want.append((value * 0x9E3779B1 % 2**32 >> (32 - op04_quality.GRAM_BITS)) + (1 << op04_quality.WORD_BITS) + (k << op04_quality.GRAM_BITS))
            assert sorted(every[2 + k][i].tolist()) == sorted(want)
        values = np.concatenate([table[kind[i]] for kind in every])
        assert op04_quality.logits(column, table, 0.25)[i] == pytest.approx((values.mean() if len(values) else 0) + 0.25, rel=1e-5)


def test_quality_follows_the_classes_shares():
    good, bad = [" ".join(words(20, 30)).encode() for _ in range(40)], [" ".join(words(20, 30)).encode() for _ in range(40)]
    y = np.repeat([1, 0], 40)
    even, most = (op04_quality.train(good + bad, y, prior)[1] for prior in (0.5, 0.9))
    assert most - even == pytest.approx(np.log(9), rel=1e-4)


def test_toxicity_is_the_greatest_window_of_a_plain_network():
    texts = [" ".join(words(n, 30)) for n in (1, 5, 47, 48, 49, 100, 200)]
    net = op06_toxicity.train([t.encode() for t in texts * 4], np.arange(28) % 2, epochs=1, steps=1)
    p, scorer = net.p, op06_toxicity.Scorer(net)
    h = op06_toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def run(xs, side):
        state, out = np.zeros(h), []
        for x in xs if side == "f" else xs[::-1]:
            pre = x @ p[f"W{side}"] + p[f"b{side}"]
            z, r = np.split(sig(pre[: 2 * h] + state @ p[f"U{side}"][:, : 2 * h]), 2)
            state = (1 - z) * state + z * np.tanh(pre[2 * h :] + (r * state) @ p[f"U{side}"][:, 2 * h :])
            out.append(state)
        return np.array(out if side == "f" else out[::-1])

    got = scorer.score(views(pa.array(texts)))
    for t, score in zip(texts, got, strict=True):
        column = views(pa.array([t]))
        tokens = op06_toxicity.tokens(column)
        xs = op06_toxicity.Scorer(net)._inputs(column, tokens.start, tokens.end, word_hashes(column, tokens, lower=True))
        best = -np.inf
        low = 0
        while True:
            window = xs[low : low + op06_toxicity.WINDOW]
            states = np.concatenate([run(window, "f"), run(window, "b")], axis=1)
            e = np.tanh(states @ p["A"]) @ p["a"]
            w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            best = max(best, (w @ states) @ p["o"] + p["c"][0])
            if low + op06_toxicity.WINDOW >= len(xs):
                break
            low += op06_toxicity.STRIDE
        assert score == pytest.approx(sig(best), rel=1e-3)


def test_texts_of_over_a_megabyte(spark):
    long = " ".join(words(230_000, 5000))
    near = long.replace(" ", "  ", 1) + " tail"
    docs = table(spark, [(1, long), (2, near), (3, "x" * 1_200_000), (4, " ".join(words(50, 10**6)))])
    assert len(long) > 1 << 20
    linked = {r.doc_id: (r.n_shingles, r.component_id) for r in op05_minhash.near_duplicates(docs, 2, 80).collect()}
    sets = {r.doc_id: op05_minhash.shingle_set(r.text, 2) for r in docs.collect()}
    assert linked == {i: (len(s), 1 if i < 3 else i) for i, s in sets.items()}
    gone = {r.doc_id: r.n_removed for r in op08_substrings.removals(docs, 35).collect()}
    assert gone == {1: 230_000, 2: 230_000, 3: 0, 4: 0}
    encoder, codec = units.byte_level(BYTES), op02_sentencepiece.Codec(PIECES_DATA)
    want = {r.doc_id: zlib.crc32(np.array([*encoder.whole(r.text.encode()), 2], "<u4")) for r in docs.where("doc_id <> 3").collect()}
    records = op10_records.token_records(spark, docs, BYTES, 2).collect()
    assert {r.doc_id: r.ids_crc32 for r in records if r.doc_id != 3} == want
    assert op02_sentencepiece.encode_decode(docs.where("doc_id <> 3"), PIECES).where("not decodes").count() == 0
    column = views(pa.array([long, "short one"], pa.large_string()))
    ids, at = codec.encode(column)
    assert ids[at[0] : at[1]].tolist() == codec.whole(long.encode())
    model = op09_langid.train([b"w1 w2", b"u3 u4"], ["x", "y"], [bytes([i]) for i in range(256)])
    assert op09_langid.Scorer(model).posterior(views(pa.array([long, "w" * 70_000])))[:, 0] == pytest.approx([1, 1])
    assert op07_mixture.mix(docs).agg(F.sum("size")).first()[0] == 460_052


def test_files_are_cut_by_bytes(spark):
    docs = table(spark, [(i % 50, f"text number {i}") for i in range(200)] + [(None, f"n {i}") for i in range(20)])
    scratch = Scratch(spark, "files")
    folder = scratch.place("files")
    manifest = scratch.keep(op10_records.write_records(docs, folder, BYTES, 2, partitions=3, file_bytes=1), "manifest")
    got = op10_records.read_records(manifest, folder, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0)) and len(got) == 220
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    row = manifest.orderBy("part", "nth").first()
    assert op10_records.read_record(folder, row.file, 0)[1].tolist() == got[0].input_ids


def test_dense_cluster_over_several_blocks(spark):
    centre = RNG.standard_normal(16)
    data = np.concatenate([centre + RNG.standard_normal((60, 16)) * 0.12, RNG.standard_normal((20, 16))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    got = {r.vec_id: r.n_links for r in op03_embedding_dedup.near_duplicates(df, 0.95, block=7).collect()}
    assert got == {i: int(link[i].sum()) - 1 for i in range(80)}


def test_pipeline_stages_on_empty_tables_and_nulls(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(words(60, 10**6))
    some = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, text, None, "s", 5), (None, text, None, None, None)]
    for rows in ([], some):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "tokens" or out.columns == docs.columns
            got = out.collect()
            if name in ("quality", "tokens"):
                assert len(got) == len(rows)
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter({(None, None): 1, (1, None): 1, (2, ""): 1, (3, text): 1})
    left = {r.doc_id: r.kept_sha256 for r in op08_substrings.removals(docs, 50).where("doc_id = 3").collect()}
    assert left == {3: hashlib.sha256(b"").hexdigest()}
