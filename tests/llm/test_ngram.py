"""N-gram rules: estimates against dictionaries, counts against a plain loop, joins against arrays."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.llm import ngram
from leadspark.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string"


class Plain:
    """Modified Kneser-Ney over dictionaries of byte strings."""

    def __init__(self, words, order):
        self.order, counts = order, Counter()
        for w in words:
            s = b" " + w + b"\n"
            for i in range(1, len(s)):
                counts[s[max(0, i - order + 1) : i + 1]] += 1
        self.n = {order: {g: c for g, c in counts.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1]) | Counter({g: c for g, c in counts.items() if len(g) == k})
        self.cuts, self.after = {}, {}
        for k, grams in self.n.items():
            t = Counter(grams.values())
            cut = (0.5, 1.0, 1.5)
            if t[1] and t[2] and t[3]:
                y = t[1] / (t[1] + 2 * t[2])
                found = tuple(j + 1 - (j + 1) * y * t[j + 2] / t[j + 1] for j in range(3))
                if all(0 < f < j + 1 for j, f in enumerate(found)):
                    cut = found
            self.cuts[k] = cut
            self.after[k] = defaultdict(list)
            for g, c in grams.items():
                self.after[k][g[:-1]].append(c)

    def prob(self, gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        after = self.after[k].get(gram[:-1])
        lower = self.prob(gram[1:])
        if not after:
            return lower
        cut = lambda c: self.cuts[k][min(c, 3) - 1]
        own = self.n[k].get(gram, 0)
        return (max(own - cut(own), 0) / sum(after) if own else 0) + sum(map(cut, after)) / sum(after) * lower

    def word(self, w):
        s = b" " + w + b"\n"
        return sum(math.log10(self.prob(s[max(0, i - self.order + 1) : i + 1])) for i in range(1, len(s)))


def fitted(spark, rows, order):
    docs, scratch = spark.createDataFrame(rows, SCHEMA), Scratch(spark, "test")
    return docs, scratch.write(ngram.kneser_ney(scratch.write(ngram.gram_counts(docs, order)), scratch, order)), scratch


def some_words(seed, n=300):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "é", "ing", "a", "日", "\x00", "#"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]


@pytest.mark.parametrize("order", [2, 3, 5])
def test_estimates_equal_dictionaries(spark, order):
    words = some_words(order)
    docs, model, _ = fitted(spark, [(1, " ".join(words[:200]), "en"), (2, "\n".join(words[200:]), "en"), (3, "autre été", None)], order)
    plain = Plain([w.encode() for w in words], order)
    arrays = ngram.loaded(model, 10**6)
    fresh = [w.encode() for w in [*words, "unseen", "erer", "x", "thé日z"]]
    grams, starts = ngram.top_grams(fresh, order)
    got = np.add.reduceat(arrays.log10("en", grams), starts[:-1])
    assert np.allclose(got, [plain.word(w) for w in fresh], atol=1e-4)
    for context in (b" ", b"th", b"e", b"zz"):
        assert math.isclose(sum(plain.prob((context + bytes([c]))[-order:]) for c in range(256)), 1, abs_tol=1e-9)
    assert np.allclose(arrays.log10("xx", grams[:3]), -math.log10(256))


def test_joins_equal_the_arrays(spark):
    rows = [(k, " ".join(some_words(k, 80)), ("en", "fr")[k % 2]) for k in range(12)] + [(50, None, "en"), (51, "", None)]
    docs, model, scratch = fitted(spark, rows, 4)
    whole = {r.doc_id: r.score for r in ngram.read_all(docs, model, scratch, 4, 10**6).collect()}
    unseen = spark.createDataFrame([(k, " ".join(some_words(k + 100, 30)) + " zzzz", "en") for k in range(5)], SCHEMA)
    more = {r.doc_id: r.score for r in ngram.read_all(unseen, model, scratch, 4, 10**6).collect()}
    for limit in (0, 5, 300):
        assert {r.doc_id: r.score for r in ngram.read_all(docs, model, scratch, 4, limit).collect()} == pytest.approx(whole, abs=1e-3)
        assert {r.doc_id: r.score for r in ngram.read_all(unseen, model, scratch, 4, limit).collect()} == pytest.approx(more, abs=1e-3)


def facts(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [line for line in text.encode().split(b"\n") if line.split()]
    n = len(words)
    return (
        n, sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated),
        n < 50 or 100 * len(repeated) > 50 * n,
    )


def test_counts_equal_a_plain_loop(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \n\t\x0b", "one", "a b c a b c", "x y z w", "\x1c a|b <#> &%\n\n a|b <#> &%\nend"]
    texts += [" ".join(rng.choices(some_words(k, 30), k=rng.randint(40, 200))).replace(" a ", "\n") for k in range(25)]
    texts += ["\n".join(rng.choices(["the same line", "another one here", ""], k=60)), "w" * 300_000 + " tail", ("long text " * 9 + "\n") * 5000]
    rows = [(k, t, rng.choice(["en", "fr", None])) for k, t in enumerate(texts)] + [(None, "no id here", "en"), (3, texts[8], "en")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).withColumn("kept", F.lit(0)).withColumn("step", F.lit(0))
    got = ngram.rules(df.repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((i, *facts(t)) for i, t, _ in rows), key=key)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)
    monkeypatch.setattr(ngram, "PIECE", 64)
    for text in (t or "" for t in texts[:20]):
        assert [w for words in ngram.words_of(text.encode()) for w in words] == text.encode().split()


def test_repeated_windows_when_hashes_meet(monkeypatch):
    rng = random.Random(4)
    ids, owner = np.array(rng.choices(range(3), k=400)), np.sort(np.array(rng.choices(range(9), k=400)))
    want = []
    for k in range(9):
        mine = ids[owner == k].tolist()
        windows = Counter(zip(mine, mine[1:], mine[2:]))
        want.append(len({j for i in range(len(mine) - 2) if windows[tuple(mine[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}))
    assert ngram.repeated_windows(ids, owner, 9).tolist() == want
    monkeypatch.setattr(ngram, "mixed", lambda columns: np.arange(len(columns[0])).astype(np.uint64) % 5)
    assert ngram.repeated_windows(ids, owner, 9).tolist() == want


def test_empty_table(spark):
    assert ngram.rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bands_reject_what_reads_unlike_its_language(spark):
    rng = random.Random(9)
    plain = lambda n: " ".join("".join(rng.choices(["th", "er", "on", "ing", "a"], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(k, plain(120), "en") for k in range(300)]
    rows += [(1000 + k, " ".join("".join(rng.choices("bcdfgjkqxzBCDF0123", k=9)) for _ in range(120)), "en") for k in range(5)]
    rows += [(2000, " ".join(rng.choices(["a", "er"], k=120)), "en")]
    kept = {r.doc_id: r.kept for r in ngram.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(kept[k] for k in range(300)) >= 297 and not any(kept[1000 + k] for k in range(5)) and not kept[2000]
