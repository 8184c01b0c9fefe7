"""Substring duplicates by relative Lempel-Ziv factors over an index of every document."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import Memo, Scratch, free_name, raw

WINDOW = 50
#: Words of an anchor. Any window holds WINDOW - ANCHOR + 1 anchors and names the smallest.
ANCHOR = 16
#: Runs of a chunk on average: a chunk ends behind a run whose context hash it divides.
CHUNK = 4
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP2 = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of any word range of a text from prefix sums modulo 2^64.

    With odd step B the range [i, j) has hash B^-i * sum(x[k] * B^k), equal for equal
    word sequences wherever they stand.
    """

    def __init__(self):
        self.of_word = Memo(xxhash.xxh3_64_intdigest, 400_000)
        self.up, self.down = {}, {}

    def tables(self, base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up.get(base, ())) < n:
            size = max(4096, 1 << (n - 1).bit_length())
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            self.up[base], self.down[base] = powers(base, size), powers(inverse, size)
        return self.up[base], self.down[base]

    def words(self, words: list[bytes]) -> np.ndarray:
        get = self.of_word
        return np.fromiter((get[w] for w in words), np.uint64, len(words))

    def prefix(self, x: np.ndarray, base: np.uint64) -> np.ndarray:
        up, _ = self.tables(base, len(x) + 1)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)], dtype=np.uint64)))

    def ranges(self, prefix: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self.tables(base, len(prefix))
        return mixed((prefix[ends] - prefix[starts]) * down[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of modular sums over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def runs(x: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows that name the same anchor: (anchor, context, first, last).

    `first` and `last` are window starts; the context hash covers all words of the run
    and the anchor's place in it. Every window is in exactly one run, and windows of
    equal words name equal anchors at the same place, in any document.
    """
    n = len(x) - WINDOW + 1
    if n <= 0:
        z = np.zeros(0, np.uint64)
        return z, z, z.astype(np.int64), z.astype(np.int64)
    prefix = hasher.prefix(x, STEP)
    at = np.arange(len(x) - ANCHOR + 1)
    grams = hasher.ranges(prefix, STEP, at, at + ANCHOR)
    named = np.argmin(np.lib.stride_tricks.sliding_window_view(grams, WINDOW - ANCHOR + 1), axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
    last = np.append(first[1:], n) - 1
    place = named[first]
    second = hasher.prefix(x, STEP2)
    context = hasher.ranges(second, STEP2, first, last + WINDOW)
    context = mixed(context + (place - first).astype(np.uint64) * STEP + (last - first).astype(np.uint64) * STEP2)
    return grams[place], context, first, last


def window_hashes(x: np.ndarray, starts: np.ndarray, hasher: Hasher) -> np.ndarray:
    prefix = hasher.prefix(x, STEP2)
    return hasher.ranges(prefix, STEP2, starts, starts + WINDOW)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def chunks(anchors: np.ndarray, contexts: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Neighbouring runs as chunks (key, check, first run, end): the content alone decides
    where a chunk ends, so a passage that two texts share has the same chunks inside."""
    ends = np.flatnonzero(contexts % np.uint64(CHUNK) == 0) + 1
    if not len(ends) or ends[-1] < len(contexts):
        ends = np.append(ends, len(contexts))
    starts = np.concatenate(([0], ends[:-1]))
    key = hasher.ranges(hasher.prefix(mixed(anchors), STEP), STEP, starts, ends)
    check = hasher.ranges(hasher.prefix(mixed(contexts), STEP2), STEP2, starts, ends)
    return key, check, starts, ends


RUN = pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def find_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, key, check, runs) of the chunks of each text of WINDOW words or more."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found, offsets, total = [], [np.zeros(1, np.int64)], 0
            for doc, mark, text in zip(ids, marks, batch.column(2).to_pylist()):
                words = text.split()
                if len(words) >= WINDOW:
                    a, c, lo, hi = runs(hasher.words(words), hasher)
                    key, check, _, ends = chunks(a, c, hasher)
                    found.append((np.full(len(key), doc), np.full(len(key), mark, np.int32), key, check, a, c, lo, hi))
                    offsets.append(ends + total)
                    total += len(a)
            if found:
                d, m, k, h, a, c, lo, hi = (np.concatenate(col) for col in zip(*found))
                cols = [signed(a), signed(c), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
                inner = pa.StructArray.from_arrays(cols, fields=list(RUN))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), inner)
                cols = [pa.array(d), pa.array(m), signed(k), signed(h), listed]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "key", "check", "runs"])

    kind = "doc_id long, mark int, key long, check long, runs array<struct<anchor: long, context: long, lo: int, hi: int>>"
    return docs.mapInArrow(run, kind)


def find_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, anchor, window, at) of the windows in the given runs of each text."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            found = []
            for doc, mark, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                x = hasher.words(text.split())
                starts = np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans]))
                anchor = np.zeros(len(x), np.int64)
                for s in spans:
                    anchor[s["lo"] : s["hi"] + 1] = s["anchor"]
                found.append((np.full(len(starts), doc), np.full(len(starts), mark, np.int32), anchor[starts], window_hashes(x, starts, hasher), starts))
            if found:
                d, m, a, w, s = (np.concatenate(col) for col in zip(*found))
                cols = [pa.array(d), pa.array(m), pa.array(a), signed(w), pa.array(s.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "anchor", "window", "at"])

    return docs.mapInArrow(run, "doc_id long, mark int, anchor long, window long, at int")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text bytes); the mark keeps different texts under one id apart."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.col("text").cast("string")).alias("mark"), raw().alias("text")
    ).filter("doc_id is not null")


def spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, mark, spans: array<struct<lo, hi>>): window starts, both ends included,
    whose word sequence also starts in a document with a smaller doc_id.

    Relative Lempel-Ziv in four steps. (1) Index: each text is cut into runs, the
    windows that name one anchor, and neighbouring runs into chunks; those of all
    documents, dealt by their hashes, are the reference blocks. (2) Long factors: a chunk
    that stands whole in an earlier document is copied from there as one row. Only runs
    of chunks not copied go on; the first document that holds a run is among them, since
    it is the first that holds the chunk around it. (3) Factors: a run whose whole
    context stands in an earlier document is copied from there. (4) Factor boundaries:
    where a context is the first of its kind but the anchor stands in an earlier document
    with other words around it, a copied passage ends inside the run, so its windows are
    looked up one by one among the windows of the first occurrences. Every window is
    decided in step 2, 3 or 4, so the result is exact; keys are pairs of 64-bit hashes.
    """
    texts = marked(docs)
    whole = scratch.write(find_chunks(texts))
    shared = whole.groupBy("key", "check").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    # written first, so that both sides of the join are shuffles and a frequent chunk can be split
    shared = scratch.write(shared.filter("earliest < latest").drop("latest"))
    new = F.coalesce(F.col("doc_id") <= F.col("earliest"), F.lit(True))
    dealt = scratch.write(
        whole.join(shared, ["key", "check"], "left").select(
            "doc_id",
            "mark",
            F.when(~new, F.struct(F.col("runs")[0]["lo"].alias("lo"), F.element_at("runs", -1)["hi"].alias("hi"))).alias("copy"),
            F.when(new, F.col("runs")).alias("runs"),
        )
    )
    long = dealt.filter("copy is not null").select("doc_id", "mark", "copy.lo", "copy.hi")
    rows = dealt.filter("copy is null").select("doc_id", "mark", F.inline("runs"))
    key = ["anchor", "context"]
    blocks = rows.groupBy(*key).agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    anchors = (
        blocks.groupBy("anchor")
        .agg(
            F.min("earliest").alias("anchor_first"),
            F.max("latest").alias("anchor_last"),
            (F.min("earliest") < F.max("earliest")).alias("varied"),
        )
        .filter("anchor_first < anchor_last")
        .drop("anchor_first", "anchor_last")
    )
    index = scratch.write(blocks.drop("latest").join(anchors, "anchor"))
    met = scratch.write(rows.join(index, key).filter("doc_id > earliest or varied").drop("context"))
    copied = met.filter("doc_id > earliest").select("doc_id", "mark", "lo", "hi")
    edges = met.filter("doc_id = earliest").groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("anchor", "lo", "hi")).alias("runs")
    )
    windows = scratch.write(find_windows(texts.join(edges, ["doc_id", "mark"])))
    first = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
    first = first.filter("earliest < latest").drop("latest")
    single = (
        windows.join(first, ["anchor", "window"])
        .filter("doc_id > earliest")
        .select("doc_id", "mark", F.col("at").alias("lo"), F.col("at").alias("hi"))
    )
    out = long.unionByName(copied).unionByName(single).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = scratch.write(out)
    scratch.drop(out)
    return out


def kept_words(words: list[bytes], found: list) -> list[bytes]:
    """The words that no window of `found` covers."""
    if found is None or not len(found):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s in found:
        edge[s["lo"]] += 1
        edge[s["hi"] + WINDOW] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` without the words that a window of 50 words repeats from an earlier document.

    A text that loses words becomes its kept words joined by one space; all other texts
    stay as they are, white space included. A window is 50 consecutive words of one
    text; it repeats if its word sequence also starts in a document with a smaller
    doc_id. Windows are judged on the input. `n_chars`, where present, follows the text.
    Null and short texts, and rows without a doc_id, stay. Rows that repeat a doc_id are
    not earlier than one another. All columns and rows are kept.
    """
    scratch = Scratch(docs.sparkSession, "rlz")
    found = spans(docs, scratch)
    mark, hit = free_name(docs, "mark"), free_name(docs, "spans")
    found = found.select("doc_id", F.col("mark").alias(mark), F.col("spans").alias(hit))
    joined = docs.withColumn(mark, F.hash(F.col("text").cast("string"))).join(found, ["doc_id", mark], "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, where: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else b" ".join(kept_words(t.encode().split(), w)).decode() for t, w in zip(text, where)]
        )

    gone = F.col(hit).isNotNull()
    out = joined.withColumn(hit, cut(F.when(gone, F.col("text")), F.col(hit)))
    changed = {"text": F.coalesce(hit, "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.coalesce(F.length(hit).cast(kind), F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of `docs`; see `dedup`.

    A null text has no words; its kept text is empty.
    """
    scratch = Scratch(docs.sparkSession, "rlz")
    found = spans(docs, scratch)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.col("text").cast("string")).alias("mark"), raw().alias("text")
    )
    joined = texts.join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            total, gone, sha = [], [], []
            for text, where in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                kept = kept_words(words, where)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            cols = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
