"""Benchmark decontamination by greedy string tiling with running Karp-Rabin seeds."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import Memo

#: Shortest tile in tokens, and the share of an item's tokens that tiles must cover.
MIN_TILE = 5
MIN_COVERAGE = 0.5
BLOCK_BYTES = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def core(word: bytes) -> bytes:
    """A token: a word in lower case without the marks around it."""
    text = word.decode("utf-8", "replace").lower()
    lo, hi = 0, len(text)
    while lo < hi and not text[lo].isalnum():
        lo += 1
    while hi > lo and not text[hi - 1].isalnum():
        hi -= 1
    return text[lo:hi].encode()


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash modulo 2^64 of every run of `size` ids."""
    n = max(0, len(ids) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * BASE + ids[j : j + n]
    return h


class Items:
    """A block of benchmark items, indexed by the hash of their seeds."""

    def __init__(self, rows: list[tuple[int, bytes]], min_tile: int):
        self.min_tile, self.vocabulary, self.items = min_tile, {}, []
        seeds, whole = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            words = [w for w in map(core, text.split()) if w]
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            if not len(ids):
                continue
            if len(ids) < min_tile:
                whole[len(ids)][int(rolling(ids, len(ids))[0])].append((item_id, ids))
                continue
            for at, h in enumerate(rolling(ids, min_tile).tolist()):
                seeds[h].append((len(self.items), at))
            self.items.append((item_id, ids))
        self.hashes = np.array(sorted(seeds), np.uint64)
        self.places = [seeds[h] for h in self.hashes.tolist()]
        #: Items shorter than a seed, by size and hash.
        self.short = {size: dict(found) for size, found in whole.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "of_word"}

    def ids(self, text: bytes) -> np.ndarray:
        """Vocabulary ids of the tokens of a text; 0 for words that no item has."""
        if not hasattr(self, "of_word"):
            self.of_word = Memo(self.word, 300_000)
        get = self.of_word
        found = np.array([get[w] for w in text.split()], np.int64)
        return found[found >= 0].astype(np.uint64)

    def word(self, word: bytes) -> int:
        token = core(word)
        return self.vocabulary.get(token, 0) if token else -1

    def whole(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(item_id, tokens) of the items shorter than a seed that the text holds as they are."""
        found = {}
        for size, items in self.short.items():
            h, first = np.unique(rolling(ids, size), return_index=True)
            for at in np.flatnonzero(np.isin(h, np.array(list(items), np.uint64))):
                run = ids[first[at] : first[at] + size]
                found |= {item_id: size for item_id, item in items[int(h[at])] if np.array_equal(run, item)}
        return list(found.items())

    def seeds(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Item number -> (place in the text, place in the item) of every shared seed."""
        h = rolling(ids, self.min_tile)
        gap = np.concatenate((np.zeros(1, np.int64), np.cumsum(ids == 0)))
        whole = np.flatnonzero(gap[self.min_tile :] == gap[: len(gap) - self.min_tile])[: len(h)]
        spot = np.searchsorted(self.hashes, h[whole])
        spot[spot == len(self.hashes)] = 0
        hit = self.hashes[spot] == h[whole] if len(self.hashes) else np.zeros(0, bool)
        out = defaultdict(list)
        for p, s in zip(whole[hit].tolist(), spot[hit].tolist()):
            for item, q in self.places[s]:
                out[item].append((p, q))
        return out


def matches(text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, place in text, place in item) that the seeds make up."""
    out = []
    end: dict[int, int] = {}
    for p, q in sorted(s for s in seeds if np.array_equal(text[s[0] : s[0] + size], item[s[1] : s[1] + size])):
        line = p - q
        at = end.get(line)
        if at is not None and out[at][1] + out[at][0] - size + 1 == p:
            out[at][0] += 1
        else:
            end[line] = len(out)
            out.append([size, p, q])
    return [tuple(m) for m in out]


def tiles(text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: again and again the longest match of tokens not marked yet.

    A match that earlier tiles cut is split into its unmarked runs, which compete again
    if they are `size` tokens or longer. Ties go to the earliest place.
    """
    heap = [(-n, p, q) for n, p, q in matches(text, item, seeds, size)]
    heapq.heapify(heap)
    in_text, in_item, out = set(), np.zeros(len(item), bool), []
    while heap:
        n, p, q = heapq.heappop(heap)
        free = [not (in_item[q + k] or p + k in in_text) for k in range(-n)]
        if all(free):
            out.append((p, q, -n))
            in_item[q : q - n] = True
            in_text.update(range(p, p - n))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= size:
                    heapq.heappush(heap, (start - k, p + start, q + start))
                start = None
    return out


def best(items: Items, text: bytes | None, min_coverage: float) -> tuple:
    """(n_items, coverage, item_id, n_tiles, longest) of one text; see `contamination`."""
    if not text or not (items.items or items.short):
        return 0, 0.0, None, 0, 0
    ids = items.ids(text)
    n, top = 0, (0.0, None, 0, 0)
    for item_id, size in items.whole(ids):
        n += 1
        if top[1] is None or item_id < top[1]:
            top = (1.0, item_id, 1, size)
    if len(ids) >= items.min_tile:
        for number, seeds in items.seeds(ids).items():
            item_id, item = items.items[number]
            found = tiles(ids, item, seeds, items.min_tile)
            share = sum(t[2] for t in found) / len(item)
            n += share >= min_coverage
            one = (share, item_id, len(found), max((t[2] for t in found), default=0))
            if (share, -item_id) > (top[0], -(top[1] if top[1] is not None else item_id + 1)):
                top = one
    return n, *top


def blocks(benchmark: DataFrame, min_tile: int, block_bytes: int) -> list:
    """Broadcast blocks of items, each of about `block_bytes`, read one after the other.

    A benchmark is a stated query set. Its total size is measured first; the items are
    dealt into as many blocks as that size asks for, by a hash of their id.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")
    ).filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    out = []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).distinct().collect()
        out.append(spark.sparkContext.broadcast(Items(sorted((r[0], bytes(r[1])) for r in rows), min_tile)))
    return out


def scorer(block, min_coverage: float):
    @F.pandas_udf("n_items int, coverage double, item_id long, n_tiles int, longest int")
    def score(text: pd.Series) -> pd.DataFrame:
        rows = [best(block.value, t, min_coverage) for t in text]
        out = pd.DataFrame(rows, columns=["n_items", "coverage", "item_id", "n_tiles", "longest"])
        return out.astype({"item_id": "Int64"})

    return score(F.col("text").cast("string").cast("binary"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, min_coverage: float = MIN_COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of `docs`: doc_id, contaminated, n_items, item_id, coverage, n_tiles, longest.

    Tokens are words in lower case without surrounding marks. Seeds, the runs of
    `min_tile` tokens that a text shares with an item, are joined by hash against the
    broadcast block; the text and each item it meets are then tiled greedily, so
    passages count in any order. coverage is the share of the item's tokens under
    tiles, item_id the item covered most (ties: the smallest id; null if no seed is
    shared), n_items the number of items with at least `min_coverage`, and
    contaminated whether there is one. An item of fewer than `min_tile` tokens is found
    where the text holds all of it in a row, as one tile. Null and empty texts are clean.
    Null items and those without a token take no part. Repeated rows are scored each.
    """
    found = blocks(benchmark, min_tile, block_bytes)
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[scorer(b, min_coverage).alias(f"s{k}") for k, b in enumerate(found)]
    )
    top = F.array_max(
        F.array(
            *[
                F.struct(
                    F.col(f"s{k}.coverage").alias("coverage"), (-F.col(f"s{k}.item_id")).alias("less"),
                    F.col(f"s{k}.n_tiles").alias("n_tiles"), F.col(f"s{k}.longest").alias("longest"),
                )
                for k in range(len(found))
            ]
        )
    )
    total = sum((F.col(f"s{k}.n_items") for k in range(1, len(found))), F.col("s0.n_items"))
    return scored.select("doc_id", total.alias("n_items"), top.alias("top")).select(
        "doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", (-F.col("top.less")).alias("item_id"),
        F.col("top.coverage").alias("coverage"), F.col("top.n_tiles").alias("n_tiles"), F.col("top.longest").alias("longest"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that cover no benchmark item; columns as they are."""
    out = docs
    for block in blocks(benchmark, options.get("min_tile", MIN_TILE), options.get("block_bytes", BLOCK_BYTES)):
        out = out.filter(scorer(block, options.get("min_coverage", MIN_COVERAGE))["n_items"] == 0)
    return out
