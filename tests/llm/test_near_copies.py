"""SimHash groups, relative Lempel-Ziv spans, components: against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadspark.llm import rlz, simhash
from leadspark.llm.common import Scratch
from leadspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_print(text, size=4):
    words = [w for w in (text or "").encode().lower().split() if w]
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (200, 201), (5, 5)]
    got = components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t"))
    want = roots({n for p in pairs for n in p}, pairs)
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("block", [50_000, 20])
def test_links_connect_as_all_pairs_do(spark, block):
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 30))):
            prints.add(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long")
    got = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(df, Scratch(spark, "t"), block=block).collect()]
    near = [(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 4]
    assert roots(prints, got) == roots(prints, near)


def test_near_prints_share_a_cell(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(200):
        p = q = rng.getrandbits(64)
        for bit in rng.sample(range(64), 4):
            q ^= 1 << bit
        pairs.append((simhash.signed(p), simhash.signed(q)))
    cells = {}
    df = spark.createDataFrame([(p,) for pair in pairs for p in pair], "print long")
    for r in simhash.cells(df).collect():
        cells.setdefault(r["print"], set()).add(r["cell"])
    assert all(cells[p] & cells[q] for p, q in pairs)


def test_groups_with_nulls_ties_and_repeats(spark):
    text = "one two three four five six seven eight nine ten " * 8
    rows = [(7, text), (3, text), (3, text), (None, text), (9, None), (4, ""), (11, "alone"), (12, "a b c"), (5, "A B  C")]
    got = {(r["doc_id"], r["print"] & (1 << 64) - 1, r["component_id"]) for r in simhash.groups(docs_of(spark, rows)).collect()}
    p = plain_print
    assert got == {
        (7, p(text), 3), (3, p(text), 3), (None, p(text), 3), (9, 0, 4), (4, 0, 4), (11, p("alone"), 11), (12, p("a b c"), 5), (5, p("a b c"), 5),
    }
    kept = simhash.keep_one(docs_of(spark, rows).withColumn("print", F.lit("x")).withColumn("component_id", F.lit(1)))
    assert kept.columns[-2:] == ["print", "component_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 11]
    assert simhash.groups(docs_of(spark, [])).count() == 0


def test_one_id_with_several_texts_and_copies_without_an_id(spark):
    a, b, c = (" ".join(f"{k}{n}" for n in range(60)) for k in "abc")
    rows = [(1, a), (1, b), (1, a), (2, b), (None, c), (None, c), (None, a), (5, c + " end"), (7, None), (7, "")]
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in simhash.keep_one(docs_of(spark, rows)).collect())))
    assert kept == sorted(map(str, [(1, a), (1, b), (5, c + " end"), (7, kept_empty(kept))]))
    alone = simhash.keep_one(docs_of(spark, [(None, c), (None, c), (None, b)])).collect()
    assert sorted(r["text"] for r in alone) == [b, c] and simhash.keep_one(docs_of(spark, [])).count() == 0


def kept_empty(kept):
    """Null and empty texts are equal; either row may stand for both."""
    return None if "(7, None)" in kept else ""


def test_groups_of_the_documents_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_print(r["text"]) for r in rows}
    ids = sorted(prints)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = {(i, prints[i], root) for i, root in roots(ids, near).items()}
    assert {(r["doc_id"], r["print"] & (1 << 64) - 1, r["component_id"]) for r in simhash.groups(df).collect()} == want


def plain_spans(rows):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        for k in range(len(words) - 49):
            key = tuple(words[k : k + 50])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in texts:
        gone = set()
        for k in range(len(words) - 49):
            if i is not None and first[tuple(words[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n=60):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(400)}" for _ in range(rng.choice((30, 49, 50, 51, 70, 130)))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.5:
                part = list(rng.choice(pool))
                if rng.random() < 0.4:
                    a = rng.randrange(len(part))
                    part = part[a:] if rng.random() < 0.5 else part[:a]
                if part and rng.random() < 0.3:
                    part[rng.randrange(len(part))] = "edit"
                words += part
            elif kind < 0.6:
                words += ["same"] * rng.randint(1, 140)
            else:
                words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))]
        rows.append((i * 3 % 61, rng.choice((" ", "\n", "  \t")).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spans_are_exact(spark, seed):
    rows = passages(seed) + [(None, "x " * 80), (62, "x " * 80), (63, "x " * 60), (64, None), (65, ""), (66, "\x1c  " * 55)]
    got = rlz.digest(docs_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_spans(rows)


def test_long_passages_are_copied_in_chunks(spark):
    """Passages of many runs, whole, cut and edited, in many documents."""
    rng = random.Random(8)
    pool = [[f"w{rng.randrange(900)}" for _ in range(n)] for n in (400, 900, 1500)]
    rows = [(0, " ".join(pool[1]))]
    for i in range(1, 40):
        part = list(rng.choice(pool))
        if i % 3 == 0:
            part[rng.randrange(len(part))] = "edit"
        a = rng.randrange(len(part) // 2) if i % 2 else 0
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.choice((0, 3, 80)))]
        rows.append((i, " ".join(own + part[a:] + own[::-1])))
    docs = docs_of(spark, rows)
    keys = rlz.find_chunks(rlz.marked(docs)).groupBy("key", "check").agg(F.countDistinct("doc_id").alias("n"))
    assert keys.filter("n > 1").count() > 20
    got = rlz.digest(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_spans(rows)


def test_dedup_rewrites_only_what_it_cuts(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(1, f"start\n\n{passage}  end"), (2, f"other\t{passage} tail"), (3, "short  text"), (4, None), (2, f"other\t{passage} tail")]
    df = docs_of(spark, rows).withColumn("mark", F.lit(5)).withColumn("spans", F.lit("s"))
    got = [tuple(r) for r in rlz.dedup(df).orderBy("doc_id").select("doc_id", "text", "n_chars", "mark", "spans").collect()]
    cut = (2, "other tail", 10, 5, "s")
    assert got == [(1, rows[0][1], len(rows[0][1]), 5, "s"), cut, cut, (3, "short  text", 11, 5, "s"), (4, None, None, 5, "s")]
    assert rlz.dedup(docs_of(spark, [])).count() == 0


def test_every_window_is_in_one_run():
    hasher, rng = rlz.Hasher(), np.random.default_rng(1)
    x = rng.integers(0, 50, 400).astype(np.uint64)
    _, _, lo, hi = rlz.runs(x, hasher)
    assert [k for a, b in zip(lo, hi) for k in range(a, b + 1)] == list(range(351))


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_similar_texts_are_grouped_and_others_left(spark):
    rng = random.Random(9)
    rows, family = [], {}
    for base in range(40):
        words = [f"t{rng.randrange(5000)}" for _ in range(200)]
        for copy, edits in enumerate((0, 1, 3)):  # similarity 1, about 0.95 and 0.86 to the first
            rows.append((base * 10 + copy, edited(rng, words, edits), "s"))
            family[base * 10 + copy] = base * 10
        rows.append((base * 10 + 5, " ".join(words[:100]) + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(100)), "s"))
        family[base * 10 + 5] = base * 10 + 5
    rows += [(900, "too short", "s"), (901, "too short", "s"), (902, "too long", "s"), (903, None, "s")]
    family |= {900: 900, 901: 900, 902: 902, 903: 903}
    df = docs_of(spark, [r[:2] for r in rows])
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(df, size=5, similarity=0.8).collect()}
    assert got == family
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == set(family.values())


def test_similarity_is_exact_at_the_threshold(spark):
    rng, rows, want = random.Random(12), [], {}
    for base in range(0, 1200, 10):  # of 100 shingles each, 89 or 88 are shared: 0.802 and 0.786
        words, changed = [f"t{rng.randrange(10**6)}" for _ in range(104)], 11 + base // 10 % 2
        other = words[:-changed] + [f"n{rng.randrange(10**6)}" for _ in range(changed)]
        rows += [(base, " ".join(words)), (base + 1, " ".join(other))]
        want |= {base: base, base + 1: base + (changed == 12)}
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(docs_of(spark, rows), size=5, similarity=0.8).collect()}
    assert got == want


@pytest.mark.parametrize("block", [4_000, 7])
def test_exact_links_connect_as_all_pairs_do(spark, block):
    rng, words = random.Random(6), [f"t{k}" for k in range(150)]
    texts = [edited(rng, words, k % 8) for k in range(60)] + ["", " ", "alone"]
    docs = docs_of(spark, list(enumerate(texts)))
    candidates = docs.select(F.col("doc_id").alias("id"), simhash.digest(), F.lit(5).cast("long").alias("cell"))
    found = simhash.exact_links(docs, candidates, Scratch(spark, "t"), 0.8, 5, block).collect()
    sets = [set(simhash.shingles(t.encode(), 5).tolist()) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(i, j) for i in range(63) for j in range(i) if near(sets[i], sets[j])]
    assert roots(range(63), [(r["a"], r["b"]) for r in found]) == roots(range(63), pairs)


@pytest.mark.parametrize("block", [20_000, 7])
def test_similar_links_of_a_crowded_cell(spark, block):
    rng = random.Random(3)
    words = [f"t{k}" for k in range(300)]
    df = docs_of(spark, [(k, edited(rng, words, k % 4)) for k in range(60)])
    scratch = Scratch(spark, "t")
    rows = scratch.write(simhash.fingerprints(df, 5, True))
    prints = {r["print"] for r in rows.collect()}
    found = simhash.similar_links(rows, scratch, 0.8, block).collect()
    assert len(found) <= 10 * len(prints) * (1 if block > 60 else len(prints))
    assert len(set(roots(prints, [(r["a"], r["b"]) for r in found]).values())) == 1
