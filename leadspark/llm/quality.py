"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import fold, one_text

#: Rows of trusted positives and of unlabelled text that the classifier is fitted on.
MAX_POSITIVES = 15_000
MAX_UNLABELLED = 15_000
HIDDEN = 16
ACCEPT = 0.3
FOLDS = 5

FEATURES = (
    "words", "word_length", "word_spread", "distinct", "top_word", "next_same", "lines", "line_words",
    "distinct_lines", "letters", "upper", "digits", "spaces", "controls", "commas_stops", "marks", "marked_words",
    "bare_marks", "shouted_words", "wide", "long_words", "end_marks", "distinct_pairs", "byte_entropy",
)
CLASSES = np.zeros(256, np.int8)
for _group, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\r\x0b\x0c", b".,;:'-", b"!?"), 1
):
    CLASSES[list(_bytes)] = _group
CLASSES[128:] = 8
MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def features(data: bytes) -> list[float]:
    """Numbers that describe the make-up of a text; all of it is read. Order: FEATURES."""
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(CLASSES, weights=seen, minlength=9) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = [line for line in data.split(b"\n") if line.strip()]
    marked = bare = shouted = ends = 0
    for w, c in counts.items():
        inner = MARKS.sub(b"", w)
        bare += c * (not inner)
        marked += c * (len(w) - len(inner) > 1)
        shouted += c * (len(inner) > 1 and inner.isupper())
        ends += c * (w[-1:] in b".,")
    share = seen[seen > 0] / size
    return [
        np.log1p(n), float(lengths.mean()), float(np.log1p(lengths.std())), len(counts) / n, max(counts.values()) / n,
        same / n, np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines), kinds[1], kinds[2],
        kinds[3], kinds[4], kinds[5], kinds[6], kinds[0] + kinds[7], marked / n, bare / n, shouted / n, kinds[8],
        float((lengths > 24).mean()), ends / n, (pairs + 1) / n, float(-(share * np.log2(share)).sum()),
    ]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Net:
    """One hidden layer over standardised features."""

    def __init__(self, x: np.ndarray, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        d = x.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def gradient(self, z: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Of a sum of losses with the given slopes by logit, at scaled inputs z."""
        h = np.tanh(z @ self.w[0] + self.w[1])
        back = np.outer(slope, self.w[2]) * (1 - h * h)
        return [z.T @ back, back.sum(axis=0), h.T @ slope, np.array([slope.sum()])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7, epochs: int = 60) -> Net:
    """Minimise the non-negative unbiased risk with the logistic loss.

    risk = prior * E_p[l(f, 1)] + max(0, E_u[l(f, 0)] - prior * E_p[l(f, 0)]). Where the
    second part of a batch is below zero, the step goes up that part instead.
    """
    rng = np.random.default_rng(seed)
    net = Net(np.concatenate((positive, unlabelled)), HIDDEN, seed)
    p, u = net.scaled(positive), net.scaled(unlabelled)
    batches = max(1, max(len(p), len(u)) // 512)
    m, v, t = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
    for epoch in range(epochs):
        for bp, bu in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)):
            if not len(bp) or not len(bu):
                continue
            zp, zu = p[bp], u[bu]
            fp = np.tanh(zp @ net.w[0] + net.w[1]) @ net.w[2] + net.w[3]
            fu = np.tanh(zu @ net.w[0] + net.w[1]) @ net.w[2] + net.w[3]
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            up_u, up_p = sigmoid(fu) / len(bu), -prior * sigmoid(fp) / len(bp)
            z = np.concatenate((zp, zu))
            if negative >= 0:
                g = net.gradient(z, np.concatenate((up_p - prior * sigmoid(-fp) / len(bp), up_u)))
            else:
                g = [-x for x in net.gradient(z, np.concatenate((up_p, up_u)))]
            t += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, w in enumerate(net.w):
                step = g[k] + 1e-4 * w
                m[k] = 0.9 * m[k] + 0.1 * step
                v[k] = 0.999 * v[k] + 0.001 * step * step
                w -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from their scores alone.

    In any region the unlabelled hold at least prior times the positives' share, so each
    upper range of scores bounds the prior from above. The bound taken is the one with
    the least sampling error added.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    sp = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    su = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    error = np.sqrt(1 / len(positive)) + np.sqrt(1 / len(unlabelled))
    best = int(np.argmin((su + error) / sp))
    return float(np.clip(su[best] / sp[best], 0.02, 0.98))


def pu_fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Net, float]:
    """Estimate the prior from held-back scores of a first net, then fit with it."""
    rng = np.random.default_rng(11)
    positive, unlabelled = rng.permutation(positive), rng.permutation(unlabelled)
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    prior = 0.5
    for _ in range(2):
        net = fit(positive[:half_p], unlabelled[:half_u], prior, epochs=20)
        prior = class_prior(net.logit(positive[half_p:]), net.logit(unlabelled[half_u:]))
    return fit(positive, unlabelled, prior), prior


def sample(docs: DataFrame, ids: DataFrame | None, limit: int, seed: str) -> np.ndarray:
    """Feature rows of at most `limit` documents, those of the smallest hashes of the id.

    With `ids`, only documents among them. An id that repeats counts with one text. The bound is on the sample a classifier is
    fitted on; scoring reads every row.
    """

    @F.pandas_udf("array<float>")
    def described(text: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(t or b""), np.float32) for t in text])

    pool = docs.select("doc_id").filter("doc_id is not null") if ids is None else ids
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    chosen = pool.select("doc_id").distinct().orderBy(order, "doc_id").limit(limit)
    text = F.col("text").cast("string").cast("binary")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = one_text(rows, "doc_id").select("doc_id", described("text").alias("f")).toPandas().sort_values("doc_id", kind="stable")
    return np.stack(rows["f"]).astype(np.float64) if len(rows) else np.zeros((0, len(FEATURES)))


def train(docs: DataFrame, labels: DataFrame) -> Net | None:
    """A classifier from trusted positives and unlabelled documents.

    Positives are labelled 1 and not held out; labels of 0 are not used, nor any label
    of a held-out id. The unlabelled text is a sample of all documents. Without
    positives or documents there is no classifier.
    """
    good = labels.filter((F.col("quality") == 1) & (fold("doc_id", FOLDS) != 0)).select("doc_id")
    positive = sample(docs, good, MAX_POSITIVES, "positive")
    unlabelled = sample(docs, None, MAX_UNLABELLED, "unlabelled")
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    return pu_fit(positive, unlabelled)[0]


def score(docs: DataFrame, net: Net | None) -> Column:
    """Probability of good quality of the column `text`; 0.5 where nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.full(len(text), 0.5))
        x = np.array([features(t or b"") for t in text]).reshape(len(text), len(FEATURES))
        return pd.Series(sigmoid(shared.value.logit(x)))

    return run(F.col("text").cast("string").cast("binary"))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    held_out: crc32 of the id as text modulo 5 is 0 (a null id counts as held out).
    predicted is 1 from a score of ACCEPT on. Null texts score as empty ones. Repeated
    rows are scored each; ties play no part. Labels, lang and source are no inputs.
    """
    net = train(docs, labels)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", FOLDS) == 0).alias("held_out"), score(docs, net).alias("score")
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier does not reject; columns as they are."""
    return docs.filter(score(docs, train(docs, labels)) >= ACCEPT)
