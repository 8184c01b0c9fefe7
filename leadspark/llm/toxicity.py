"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as an embedding of itself and of its character n-grams, so that unseen
forms of a known stem are recognised. Windows of WINDOW words, overlapping by
WINDOW - STRIDE, cover every word of a text; the text scores as its worst window.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import fold, one_text, raw

FOLDS = 5
#: Labelled documents of either label that the network is fitted on.
MAX_PER_LABEL = 3_000
WINDOW, STRIDE = 48, 36
#: Characters of the longest word; a longer one is cut into pieces that start STEP apart.
LONGEST, STEP = 64, 48
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 17
EMBED, HIDDEN, ATTEND = 6, 8, 8
INPUTS = 2 * EMBED + 3
BATCH = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)
MARKS = string.punctuation + "\u00ab\u00bb\u2018\u2019\u201c\u201d\u2026\u2013\u2014\u00bf\u00a1"


def normal(word: bytes) -> str:
    """A word in lower case without the marks around it."""
    text = word.decode("utf-8", "replace").lower()
    return text.strip(MARKS) or text


def tokens(text: bytes) -> list[bytes]:
    """The words of a text; overlapping pieces stand for a word of over LONGEST characters."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out = []
    for word in words:
        whole = normal(word) if len(word) > LONGEST else ""
        if len(whole) <= LONGEST:
            out.append(word)
        else:
            out += [whole[a : a + LONGEST].encode() for a in range(0, len(whole) - LONGEST + STEP, STEP)]
    return out


def parts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, the buckets of all character 3- to 5-grams word by word, and their numbers.

    The ends of a word are marked. Words come from `tokens`, so none is over LONGEST.
    """
    buckets = np.fromiter((zlib.crc32(w.encode()) % WORD_BUCKETS for w in words), np.int64, len(words))
    marked = [f"<{w or ' '}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    flat, whose = [], []
    code = points * MIX
    for n in range(2, 6):
        code = (code[:-1] ^ (points[n - 1 :] + np.uint64(n))) * MIX
        if n > 2:
            inside = owner[n - 1 :] == owner[: max(0, len(owner) - n + 1)]
            flat.append((code[inside] >> np.uint64(40)) % np.uint64(GRAM_BUCKETS))
            whose.append(owner[n - 1 :][inside])
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return buckets, np.concatenate(flat)[order].astype(np.int64), np.bincount(whose, minlength=len(words))


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values added up per row: (distinct rows, sums)."""
    distinct, at = np.unique(rows, return_inverse=True)
    out = np.zeros((len(distinct), values.shape[1]), np.float32)
    np.add.at(out, at, values)
    return distinct, out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the windows of a text of n words; together they hold every word."""
    if n <= WINDOW:
        return [(0, n)]
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


class Network:
    """Weights, forward and backward pass. Time runs along the first axis."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.word_odds, self.gram_odds = word_odds.astype(np.float32), gram_odds.astype(np.float32)
        w = {
            "word": rng.normal(0, 0.1, (WORD_BUCKETS, EMBED)),
            "gram": rng.normal(0, 0.1, (GRAM_BUCKETS, EMBED)),
            "attend": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)),
            "attend_bias": np.zeros(ATTEND),
            "query": rng.normal(0, 0.5, ATTEND),
            "out": rng.normal(0, 0.3, 2 * HIDDEN),
            "bias": np.zeros(1),
        }
        for side in "fb":
            w[side + "x"] = rng.normal(0, INPUTS**-0.5, (INPUTS, 3 * HIDDEN))
            w[side + "h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
            w[side + "b"] = np.zeros(3 * HIDDEN)
        self.w = {k: v.astype(np.float32) for k, v in w.items()}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, buckets: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The input vectors of words given by `parts`: both embeddings and the odds."""
        at = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(self.w["gram"][flat], at, axis=0) / sizes[:, None]
        odds = self.gram_odds[flat]
        top, total = np.maximum.reduceat(odds, at), np.add.reduceat(odds, at) / sizes
        known = self.word_odds[buckets]
        return np.concatenate((self.w["word"][buckets], mean, np.stack((known, top, total), axis=1)), axis=1).astype(np.float32)

    def turn(self, xp: np.ndarray, mask: np.ndarray, side: str, keep: bool):
        """One direction over projected inputs (T, B, 3H); steps in `order` of time."""
        u, h = self.w[side + "h"], np.zeros((xp.shape[1], HIDDEN), np.float32)
        steps = range(len(xp)) if side == "f" else range(len(xp) - 1, -1, -1)
        out, saved = np.empty((*xp.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            hu = h @ u
            gates = 1 / (1 + np.exp(-(xp[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(xp[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            new = h + m * (1 - z) * (c - h)
            if keep:
                saved.append((t, h, z, r, c, hu[:, 2 * HIDDEN :], m))
            h = out[t] = new
        return out, saved

    def pool(self, h: np.ndarray, mask: np.ndarray):
        a = np.tanh(h @ self.w["attend"] + self.w["attend_bias"])
        s = np.where(mask > 0, a @ self.w["query"], -1e9)
        e = np.exp(s - s.max(axis=0)) * mask
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", alpha, h)
        return pooled @ self.w["out"] + self.w["bias"][0], a, alpha, pooled

    def logits(self, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self.turn(forward, mask, "f", False)
        b, _ = self.turn(backward, mask, "b", False)
        return self.pool(np.concatenate((f, b), axis=2), mask)[0]

    def learn(self, words: list[list[str]], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of one batch of windows."""
        vocabulary: dict[str, int] = {}
        length = max(map(len, words))
        ids = np.zeros((length, len(words)), np.int64)
        mask = np.zeros((length, len(words)), np.float32)
        for k, ws in enumerate(words):
            ids[: len(ws), k] = [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
            mask[: len(ws), k] = 1
        buckets, flat, sizes = parts(list(vocabulary))
        table = self.inputs(buckets, flat, sizes)
        x = table[ids]
        saved, outs = {}, []
        for side in "fb":
            out, saved[side] = self.turn(x @ self.w[side + "x"] + self.w[side + "b"], mask, side, True)
            outs.append(out)
        h = np.concatenate(outs, axis=2)
        logit, a, alpha, pooled = self.pool(h, mask)
        slope = ((sigmoid(logit) - labels) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ slope, "bias": np.array([slope.sum()])}
        d_pooled = np.outer(slope, self.w["out"])
        d_alpha = np.einsum("bh,tbh->tb", d_pooled, h)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["query"] = np.einsum("tb,tba->a", d_score, a)
        d_a = d_score[:, :, None] * self.w["query"] * (1 - a * a)
        g["attend"] = np.einsum("tbh,tba->ha", h, d_a)
        g["attend_bias"] = d_a.sum(axis=(0, 1))
        d_h = alpha[:, :, None] * d_pooled + d_a @ self.w["attend"].T
        d_x = np.zeros_like(x)
        for side, part in (("f", d_h[:, :, :HIDDEN]), ("b", d_h[:, :, HIDDEN:])):
            u, wx = self.w[side + "h"], self.w[side + "x"]
            d_u, d_xp, back = np.zeros_like(u), np.zeros((*ids.shape, 3 * HIDDEN), np.float32), 0.0
            for t, before, z, r, c, hc, m in reversed(saved[side]):
                d = part[t] + back
                d_c = d * m * (1 - z) * (1 - c * c)
                d_z = d * m * (before - c) * z * (1 - z)
                d_r = d_c * hc * r * (1 - r)
                d_xp[t] = np.concatenate((d_z, d_r, d_c), axis=1)
                d_hu = np.concatenate((d_z, d_r, d_c * r), axis=1)
                d_u += before.T @ d_hu
                back = d * (1 - m * (1 - z)) + d_hu @ u.T
            rows = d_xp.reshape(-1, 3 * HIDDEN)
            g[side + "h"], g[side + "b"] = d_u, rows.sum(axis=0)
            g[side + "x"] = x.reshape(-1, INPUTS).T @ rows
            d_x += d_xp @ wx.T
        d_table = np.zeros_like(table)
        np.add.at(d_table, ids.ravel(), d_x.reshape(-1, INPUTS) * mask.reshape(-1, 1))
        g["word"] = summed(buckets, d_table[:, :EMBED])
        each = np.repeat(d_table[:, EMBED : 2 * EMBED] / sizes[:, None], sizes, axis=0)
        g["gram"] = summed(flat, each)
        return g

    def fit(self, words: list[list[str]], labels: np.ndarray, epochs: int = 8, seed: int = 3) -> None:
        """Adam over shuffled batches, AdaGrad on the embedding rows a batch touches;
        either label weighs the same in total."""
        rng = np.random.default_rng(seed)
        power = {k: np.full(len(self.w[k]), 1e-8, np.float32) for k in ("word", "gram")}
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        dense = [k for k in self.w if k not in power]
        m, v = ({k: np.zeros_like(self.w[k]) for k in dense} for _ in range(2))
        t, size = 0, 64 if len(words) > 1000 else 16
        for epoch in range(epochs):
            for pick in np.array_split(rng.permutation(len(words)), -(-len(words) // size)):
                g = self.learn([words[i] for i in pick], labels[pick], weight[pick])
                t += 1
                rate = 0.01 * (1 - epoch / epochs) + 0.001
                for k in power:
                    rows, d = g.pop(k)
                    power[k][rows] += (d * d).mean(axis=1)
                    self.w[k][rows] -= 0.03 * d / np.sqrt(power[k][rows])[:, None]
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


class Scorer:
    """Scores texts with a network, projecting each distinct word once."""

    def __init__(self, network: Network, limit: int = 250_000):
        self.network = network
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.table = np.zeros((self.limit + 1, 6 * HIDDEN), np.float32)
        self.row: dict[bytes, int] = {}

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Table rows of words, projecting the new ones; row 0 stands for no word."""
        new = set(words).difference(self.row)
        if len(new) + len(self.row) > self.limit:
            self.reset()
            new = set(words)
            if len(new) > self.limit:
                self.limit = len(new)
                self.reset()
        if new:
            w = self.network.w
            x = self.network.inputs(*parts(list(map(normal, new))))
            at = len(self.row) + 1
            both = np.concatenate((x @ w["fx"] + w["fb"], x @ w["bx"] + w["bb"]), axis=1)
            self.table[at : at + len(new)] = both
            self.row.update(zip(new, range(at, at + len(new))))
        get = self.row
        return np.fromiter((get[x] for x in words), np.int64, len(words))

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """The highest window logit of each text; a text is split into parts when long."""
        best = np.full(len(texts), -np.inf)
        ids, owner = [], []
        for k, text in enumerate(texts):
            words = tokens(text)
            for part in range(0, max(1, len(words)), 1000 * STRIDE):
                rows = self.rows(words[part : part + 1000 * STRIDE + WINDOW])
                for a, b in windows(len(rows)):
                    ids.append(self.table[rows[a:b]])
                    owner.append(k)
                    if len(ids) >= BATCH:
                        self.flush(ids, owner, best)
        if ids:
            self.flush(ids, owner, best)
        return best

    def flush(self, ids: list, owner: list, best: np.ndarray) -> None:
        x = np.zeros((WINDOW, len(ids), 6 * HIDDEN), np.float32)
        mask = np.zeros((WINDOW, len(ids)), np.float32)
        for j, rows in enumerate(ids):
            x[: len(rows), j] = rows
            mask[: len(rows), j] = 1
        long = max(1, int(mask.any(axis=1).sum()))
        found = self.network.logits(x[:long, :, : 3 * HIDDEN], x[:long, :, 3 * HIDDEN :], mask[:long])
        np.maximum.at(best, owner, found)
        ids.clear()
        owner.clear()

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.network.scale * self.worst(texts) + self.network.shift)


def chosen(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, part): at most MAX_PER_LABEL ids of either label, not held out.

    Taken by the hash of the id; part 0 yields the odds, part 1 the training windows. An
    id labelled twice counts as toxic if one label says so.
    """
    known = labels.filter((fold("doc_id", FOLDS) != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("toxic"), F.col("doc_id"))
    each = [known.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(MAX_PER_LABEL) for k in (0, 1)]
    return each[0].unionByName(each[1]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(2)))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Documents of either label by word and n-gram bucket: one bounded array per task."""

    def run(batches):
        found = np.zeros((2, WORD_BUCKETS + GRAM_BUCKETS), np.int64)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = list({normal(w) for w in tokens(text)})
                if words:
                    buckets, flat, _ = parts(words)
                    found[toxic, np.unique(np.concatenate((buckets, flat + WORD_BUCKETS)))] += 1
        at = np.flatnonzero(found.sum(axis=0))
        cols = [pa.array(at), pa.array(found[1, at]), pa.array(found[0, at])]
        yield pa.RecordBatch.from_arrays(cols, ["bucket", "toxic", "clean"])

    out = texts.select("toxic", "text").mapInArrow(run, "bucket long, toxic long, clean long")
    rows = out.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    counts = np.zeros((2, WORD_BUCKETS + GRAM_BUCKETS))
    counts[0, rows["bucket"]], counts[1, rows["bucket"]] = rows["clean"], rows["toxic"]
    return counts


def log_odds(counts: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Smoothed log odds per bucket, shrunk towards zero where few documents hold it."""
    odds = np.log((counts[1] + 0.5) / (n_toxic + 1)) - np.log((counts[0] + 0.5) / (n_clean + 1))
    seen = counts.sum(axis=0)
    return np.clip(odds * seen / (seen + 4), -3, 5) * (seen > 1)


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network fitted on windows of a bounded sample of labelled documents.

    The odds of words and n-grams come from one half of the sample, the windows from the
    other: of each text the window whose words are the most suspicious, and of clean
    texts a random one too, so every whole text is looked at. An id that repeats counts
    with one text. None without both labels.
    """
    ids = chosen(labels).cache()
    n = {(r["toxic"], r["part"]): r["count"] for r in ids.groupBy("toxic", "part").count().collect()}
    if not all(n.get((k, p)) for k in (0, 1) for p in (0, 1)):
        ids.unpersist()
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw().alias("text")).join(F.broadcast(ids), "doc_id")
    texts = one_text(texts, "doc_id", "toxic", "part")
    counts = bucket_counts(texts.filter("part = 0"))
    odds = log_odds(counts, n[0, 0], n[1, 0])
    network = Network(odds[:WORD_BUCKETS], odds[WORD_BUCKETS:])
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("array<string>")
    def pick(text: pd.Series, toxic: pd.Series, doc_id: pd.Series) -> pd.Series:
        net = shared.value

        out = []
        for t, k, d in zip(text, toxic, doc_id):
            words = [normal(w) for w in tokens(t)]
            spans = windows(len(words))
            sums = np.zeros(len(words) + 1)
            if words:
                distinct, at = np.unique(words, return_inverse=True)
                buckets, flat, sizes = parts(distinct.tolist())
                top = np.maximum.reduceat(net.gram_odds[flat], np.cumsum(sizes) - sizes) + net.word_odds[buckets]
                sums[1:] = np.cumsum(np.maximum(0, top - 1)[at])
            a, b = spans[int(np.argmax([sums[b] - sums[a] for a, b in spans]))]
            found = [" ".join(words[a:b])]
            if k == 0:
                a, b = spans[zlib.crc32(str(d).encode()) % len(spans)]
                found.append(" ".join(words[a:b]))
            out.append(found)
        return pd.Series(out)

    rows = texts.filter("part = 1").select("doc_id", "toxic", pick("text", "toxic", "doc_id").alias("windows"))
    rows = rows.toPandas().sort_values("doc_id", kind="stable")
    ids.unpersist()
    words = [w.split(" ") for ws in rows["windows"] for w in ws]
    marks = np.array([k for k, ws in zip(rows["toxic"], rows["windows"]) for _ in ws], np.float32)
    if not len(words):
        return None
    network.fit(words, marks)
    return network


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    score is the sigmoid of the worst window's logit; predicted is 1 from 0.5 on.
    held_out: crc32 of the id as text modulo 5 is 0 (so is a null id). A null or empty
    text is one empty window. Without labels of both kinds the score is 0. Repeated rows
    are scored each. Labels, lang and source are no inputs.
    """
    network = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = scorer.scores(texts) if scorer else np.zeros(len(texts))
            cols = [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == 0).alias("held_out"), raw().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
