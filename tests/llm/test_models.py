"""PPM, multi-index hashing, toxicity, quality: reference models, recall, held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.llm import mih, ppm, quality, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def levels(texts, order):
    stream, at, _ = ppm.symbols(texts, order)
    code = ppm.grams(stream, at, order)
    return [tuple(np.unique(ppm.low(code, j + 1), return_counts=True)) for j in range(order + 1)]


def taught(texts, order):
    model = ppm.Adaptive(order)
    for text in texts:
        context = (ppm.END,) * order
        for symbol in [*text, ppm.END]:
            model.learn(context, symbol)
            context = (*context, symbol)[1:] if order else ()
    return model


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_trie_equals_the_model_over_dictionaries(order):
    rng = random.Random(order)
    train = [bytes(rng.choices(b"abc d\xc3", k=rng.randint(0, 40))) for _ in range(50)]
    tests = [bytes(rng.choices(b"abc dxyz\xff", k=rng.randint(0, 30))) for _ in range(40)] + [b""]
    model = taught(train, order)
    got = ppm.Trie(levels(train, order)).scores(tests)
    assert np.allclose(got, [model.score(t, learn=False) for t in tests], atol=1e-5)
    assert math.isclose(sum(10 ** model.log((97,) * order, s) for s in range(257)), 1, abs_tol=1e-9)


def test_adaptive_model_learns_while_it_codes():
    repeated, noise = b"the same line again. " * 20, bytes(random.Random(1).choices(range(256), k=420))
    assert ppm.Adaptive(4).score(repeated) > ppm.Adaptive(4).score(noise) / 4
    assert ppm.Trie([(np.zeros(0, np.uint64), np.zeros(0))] * 3).scores([b"ab"])[0] == pytest.approx(-3 * math.log10(257))


def test_scores_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "BETA", "gamma", "naïve", "x"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(40)]
    rows += [(41, None), (42, ""), (None, "alpha no id"), (7, rows[7][1]), (43, "only\there\x0bhere")]
    df = docs_of(spark, rows).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    got = ppm.scores(df, order=3).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    lower = [(i, (t or "").encode().lower()) for i, t in rows]
    train = [t for i, t in lower if not held(i)]
    count = Counter(w for t in train for w in t.split())
    n, v = sum(count.values()) + len(train), len(count) + 1
    model = taught(train, 3)
    want = []
    for i, t in lower:
        c = [*(count[w] for w in t.split()), len(train)]
        want.append((i, held(i), len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c), model.score(t, False)))
    key = lambda r: (str(r[0]), r[2], r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)


def test_rare_words_are_joined(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in ppm.scores(df, order=1).collect()}
    monkeypatch.setattr(ppm, "TOP_WORDS", 3)
    for r in ppm.scores(df, order=1).collect():
        assert r["n_known"] == whole[r["doc_id"]][0] and r["base_score"] == pytest.approx(whole[r["doc_id"]][1])


@pytest.mark.parametrize("cached", [0, 40])
def test_grams_beyond_the_cache_count_in_full(spark, monkeypatch, cached):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcd xyz", k=rng.randint(0, 60)))) for i in range(60)] + [(61, None), (62, "QQ\u00e9")]
    monkeypatch.setattr(ppm, "MAX_ENTRIES", cached)
    got = {r["doc_id"]: r["score"] for r in ppm.scores(docs_of(spark, rows)).collect()}
    texts = {i: (t or "").encode().lower() for i, t in rows}
    model = taught([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2], ppm.ORDER)
    assert got == {i: pytest.approx(model.score(t, False), abs=1e-6) for i, t in texts.items()}


@pytest.mark.parametrize("at_a_time", [1, 100, 1 << 23])
def test_grams_are_counted_in_blocks(spark, monkeypatch, at_a_time):
    rng = random.Random(9)
    monkeypatch.setattr(ppm, "SORTED", at_a_time)
    rows = [("".join(rng.choices("abC", k=rng.randint(0, 30))).encode(), i % 3 == 0) for i in range(50)]
    table = spark.createDataFrame(rows, "text binary, held_out boolean").coalesce(1)
    got = {r["gram"]: (r["times"], r["n"]) for r in ppm.count_grams(table, 2).collect()}
    times, learned = Counter(), Counter()
    for text, out in rows:
        context = (ppm.END,) * 2
        for symbol in [*text.lower(), ppm.END]:
            gram = context[0] << 18 | context[1] << 9 | symbol
            times[gram] += 1
            learned[gram] += not out
            context = (context[1], symbol)
    assert got == {g: (times[g], learned[g]) for g in times}


def test_scores_of_empty_tables(spark):
    assert ppm.scores(docs_of(spark, [])).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.scores(docs_of(spark, []), labels).count() == 0
    assert toxicity.scores(docs_of(spark, []), labels).count() == 0
    assert {r["score"] for r in quality.scores(docs_of(spark, [(1, "a"), (None, None)]), labels).collect()} == {0.5}
    assert {r["score"] for r in toxicity.scores(docs_of(spark, [(1, "a"), (None, None)]), labels).collect()} == {0.0}


def test_index_finds_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (500, 8)).astype(np.uint16)
    codes[250:] = codes[:250] ^ (1 << rng.integers(0, 16, (250, 8))).astype(np.uint16) * (rng.random((250, 8)) < 0.5).astype(np.uint16)
    index = mih.Index(codes)
    for q in (0, 17, 300):
        for radius in (0, 1, 3, 7, 8, 20, 50, 60):
            far = mih.distance(codes, codes[q])
            assert np.array_equal(index.within(codes[q], radius), np.flatnonzero(far <= radius))


def exact(rows, k=5, every=50):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i in np.unique(ids[ids % every == 0]):
        q = int(np.flatnonzero(ids == i)[0])
        score = mih.cosines(x[q], x)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def test_recall_on_the_embeddings_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {}
    for r in mih.nearest(df, query_block=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95


def test_nearest_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 8)).tolist()
    rows = [(i, base[i % 30]) for i in range(100)] + [(0, base[0])]
    bad = [(200, None), (250, [0.0] * 8), (300, [float("nan")] + [1.0] * 7), (350, [float("inf")] * 8), (400, [None] * 8), (450, [1.0] * 3), (None, base[0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in mih.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["score"])))
    want = exact([*rows[:-1]])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in mih.nearest(few).orderBy("rank").collect()] == [1, 2]
    assert mih.nearest(few.limit(0)).count() == 0


def test_copies_of_a_near_vector_take_one_place(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    base[7] = base[0] + 0.01
    rows = [(i, v) for i, v in enumerate(base.tolist())] + [(7, (base[0] + 0.02 + 0.001 * c).tolist()) for c in range(40)]
    got = {}
    for r in mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (0, 50):
        score = {}
        for (i, _), c in zip(rows, mih.cosines(base[q], np.array([v for _, v in rows]))):
            score[i] = max(c, score.get(i, -2))
        want = sorted((i for i in score if i != q), key=lambda i: (-score[i], i))[:5]
        assert [i for i, _ in got[q]][:1] == want[:1] and len({i for i, _ in got[q]}) == 5
        assert all(s == pytest.approx(score[i]) for i, s in got[q])
    coder = mih.Coder(base)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = mih.search_block(coder, coder.bits, ids, x, ([0], x[:1], coder.codes(x[:1])), 5)
    order = [i for i in ids[np.argsort(-mih.cosines(x[0], x), kind="stable")] if i]
    assert found[1].tolist() == list(dict.fromkeys(order))[:5]


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(rng.normal(size=toxicity.WORD_BUCKETS), rng.normal(size=toxicity.GRAM_BUCKETS))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words, y, weight = [["idiot", "the", "foo"], ["bar"], ["a", "b", "c", "idiot"]], np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    grads = net.learn(words, y, weight)

    def loss():
        names = sorted({w for ws in words for w in ws})
        ids = np.array([[names.index(ws[t]) if t < len(ws) else 0 for ws in words] for t in range(4)])
        mask = np.array([[float(t < len(ws)) for ws in words] for t in range(4)])
        x = net.inputs(*toxicity.parts(names))[ids]
        p = toxicity.sigmoid(net.logits(x @ net.w["fx"] + net.w["fb"], x @ net.w["bx"] + net.w["bb"], mask))
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * weight).sum() / weight.sum()

    for name in ("fx", "bx", "fh", "bh", "fb", "attend", "query", "out", "attend_bias"):
        at = tuple(rng.integers(s) for s in net.w[name].shape)
        net.w[name][at] += 0.01
        up = loss()
        net.w[name][at] -= 0.02
        down = loss()
        net.w[name][at] += 0.01
        assert grads[name][at] == pytest.approx((up - down) / 0.02, rel=1e-2, abs=1e-6)


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 84, 85, 500):
        spans = toxicity.windows(n)
        assert sorted({k for a, b in spans for k in range(a, b)}) == list(range(n))
        assert all(b - a <= toxicity.WINDOW for a, b in spans)


def test_every_character_of_a_long_token_is_scored():
    rng = np.random.default_rng(2)
    net = toxicity.Network(np.zeros(toxicity.WORD_BUCKETS), rng.normal(size=toxicity.GRAM_BUCKETS))
    net.w["word"][:] = 0
    for head in ("x." * 50, "x\u00a0y" * 40, "\u8a9e" * 70, "ab" * 1000):
        plain, marked = toxicity.Scorer(net).scores([(head + end + head).encode() for end in ("fine", "idiot")])
        assert abs(plain - marked) > 1e-6
    for n in (65, 112, 113, 300):
        word = "".join(rng.choice(list("abcdef"), n))
        pieces = [p.decode() for p in toxicity.tokens(f"to {word} be".encode())][1:-1]
        assert all(len(p) <= 64 for p in pieces) and all(any(word[i : i + 5] in p for p in pieces) for i in range(n - 4))
    assert toxicity.tokens(b"a " + b"z" * 64 + b" " + b"-" * 80 + b"q") == [b"a", b"z" * 64, b"-" * 80 + b"q"]


def area(labels, scores):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    n = int(labels.sum())
    return (order[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


@pytest.mark.parametrize("module, column, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, column, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    blind = docs.withColumn("lang", F.lit(None)).withColumn("source", F.lit(0)).withColumn("predicted", F.lit(9))
    got = module.scores(blind, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert held.held_out.all() and (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()
    assert area(held[column].to_numpy(), held.score.to_numpy()) > least
    cut = 0.5 if column == "toxic" else 0.3
    assert ((got.score >= cut).astype(int) == got.predicted).all()


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    one, two = (quality.scores(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(one.score, two.score)
    kept = quality.accept(docs.withColumn("score", F.lit(-1)), labels)
    assert kept.columns == [*docs.columns, "score"]
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(one.doc_id[one.predicted == 1])


def test_a_repeated_id_enters_the_samples_once(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"some words of {i}") for i in range(40)] + [(i, f"row {k} of {i}") for i in (3, 8) for k in range(50)])
    assert len(quality.sample(docs, None, 60, "s")) == 40
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity.Network, "fit", lambda self, words, marks: fitted.append(len(words)))
    toxicity.train(docs, labels)
    part = toxicity.chosen(labels).filter("part = 1").collect()
    assert fitted == [sum(2 - r["toxic"] for r in part)]


def test_non_negative_risk_recovers_the_prior():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, (4000, 4)), rng.normal(-2, 1, (4000, 4))
    mixed = np.concatenate((good[:3000], bad[:1000]))
    net, prior = quality.pu_fit(good[3000:], mixed)
    assert prior == pytest.approx(0.75, abs=0.06)
    assert (net.logit(good) > 0).mean() > 0.97 and (net.logit(bad) > 0).mean() < 0.05
    assert quality.features(b"") == [0.0] * len(quality.FEATURES) and quality.features(b" \n") == quality.features(b"")
