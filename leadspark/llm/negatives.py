"""Hard negatives by score bounds along spanning trees of the anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.common import Scratch

#: Anchors of one pass over the rows, and rows scored at a time.
ANCHORS = 2_048
ROWS = 1_024
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v: array<long>) of the rows that take part: relabelled, in whole numbers."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("x", lambda x: F.floor(F.lit(256.0) * x)).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


class Products:
    """Exact integer inner products of rows and anchors, in the narrowest arithmetic that holds them."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        reach = [np.abs(m.astype(np.float64)).max(initial=0) for m in (rows, anchors)]
        top = reach[0] * reach[1] * max(1, rows.shape[1])
        kind = np.float64 if top < 2**53 else np.int64 if top < 2**62 else object
        self.fits = kind is not object
        self.rows, self.anchors = rows.astype(kind), anchors.astype(kind)

    def of(self, which: np.ndarray) -> Products:
        part = object.__new__(Products)
        part.fits, part.rows, part.anchors = self.fits, self.rows[which], self.anchors
        return part

    def scores(self, which: np.ndarray, anchor: int) -> np.ndarray:
        """int64; a product beyond a long becomes the nearest long."""
        rows = self.rows if len(which) == len(self.rows) else self.rows[which]
        found = rows @ self.anchors[anchor]
        return (found if self.fits else np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in found], object)).astype(np.int64)


class Forest:
    """A minimum spanning tree per label over a block of anchors.

    `trees` holds (label, nodes, parents, edges): nodes in an order that names every parent
    first, the place of each node's parent in it, and the Euclidean length of that edge.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        x = vectors.astype(np.float64)
        self.trees = []
        for label in np.unique(labels):
            nodes = np.flatnonzero(labels == label)
            order, parents, edges = self.spanning(x[nodes])
            self.trees.append((label, nodes[order], parents, edges))

    @staticmethod
    def spanning(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prim's algorithm from the point nearest the centre."""

        def away(point: np.ndarray) -> np.ndarray:
            d = x - point
            return np.sqrt(np.einsum("ij,ij->i", d, d))

        n = len(x)
        order, parents, edges = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
        root = int(np.argmin(away(x.mean(axis=0))))
        place, near, length = np.zeros(n, np.int64), np.full(n, root), away(x[root])
        order[0], length[root] = root, np.inf
        out = np.arange(n) != root
        for k in range(1, n):
            node = int(np.argmin(np.where(out, length, np.inf)))
            order[k], parents[k], edges[k], place[node], out[node] = node, place[near[node]], length[node], k, False
            distance = away(x[node])
            closer = out & (distance < length)
            near[closer], length[closer] = node, distance[closer]
        return order, parents, edges


def walk(tree: tuple, products: Products, norms: np.ndarray, window: Callable[[int], tuple[float, float] | None]) -> Iterator[tuple]:
    """(anchor, rows, exact scores) along a tree, of the rows whose bounds meet the anchor's window.

    With parent p of anchor c, <x, c> = <x, p> + <x, c - p> lies within |c - p| |x| of <x, p>
    (Cauchy-Schwarz). The root is scored for every row; a row that a parent was not scored for
    passes on the bounds it had there. `window` gives the least and the largest score of
    interest, or None. Rounding is covered by a slack.
    """
    _, nodes, parents, edges = tree
    low, high = np.empty((len(nodes), len(norms))), np.empty((len(nodes), len(norms)))
    every = np.arange(len(norms))
    for k, anchor in enumerate(nodes):
        span = window(anchor)
        if k == 0 or not products.fits:
            which = every
            low[k], high[k] = -np.inf, np.inf
        else:
            a, b = low[parents[k]], high[parents[k]]
            radius = norms * (edges[k] * (1 + 1e-9)) + 1
            low[k], high[k] = a - radius - 1e-14 * np.abs(a), b + radius + 1e-14 * np.abs(b)
            if span is None:
                continue
            which = np.flatnonzero((high[k] >= span[0]) & (low[k] <= span[1]))
        if len(which):
            scores = products.scores(which, anchor)
            if products.fits:
                low[k, which] = high[k, which] = scores
            if span is not None:
                yield anchor, which, scores


class Best:
    """The k best (score, vec_id) of those offered: higher scores first, then smaller ids; repeats count once."""

    def __init__(self, k: int, least: int = -(2**63), most: int = 2**63 - 1):
        self.k, self.least, self.most = k, least, most
        self.ids = self.scores = np.zeros(0, np.int64)

    def floor(self) -> int:
        """The least score that can still enter."""
        return max(self.least, int(self.scores[-1])) if len(self.ids) == self.k else self.least

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = (scores >= self.floor()) & (scores <= self.most)
        if not fit.any():
            return
        ids, scores = np.concatenate([self.ids, ids[fit]]), np.concatenate([self.scores, scores[fit]])
        order = np.lexsort((ids, ~scores))
        ids, scores = ids[order], scores[order]
        fresh = np.append(True, (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1]))
        self.ids, self.scores = ids[fresh][: self.k], scores[fresh][: self.k]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2))


def along(forest: Forest, batches: Iterator[pa.RecordBatch], same: bool, window, take) -> None:
    """Walk every tree over all rows of its label (`same`) or of the other labels."""
    for ids, labels, vectors in blocks_of(batches):
        products, norms = Products(vectors, forest.vectors), np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        for tree in forest.trees:
            mine = np.flatnonzero((labels == tree[0]) == same)
            if len(mine):
                for anchor, which, scores in walk(tree, products.of(mine), norms[mine], window):
                    take(anchor, ids[mine[which]], scores)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = 50, high: int = 95, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by `every`. Their positives are the first
    `positives` other rows of their label, and with each positive go the first `negatives` rows
    of other labels whose score is between `low` and `high` percent of the positive's; all, if
    there are fewer. Scores are integer inner products of floor(256 x), higher ones come first,
    ties by smaller vec_id. The label of a vec_id divisible by 7 is first moved on by one.

    Rows without a vec_id, a label or a vector, with null or non-finite components, or of
    another length than most take no part. Equal rows of one vec_id count once as candidates;
    of different rows under one anchor id the least (label, vector) is the anchor, and all are
    candidates for other anchors. A component or score beyond a long becomes the nearest long.
    An empty table gives no rows; columns of other names do not matter.

    Anchors are a stated set and pass in blocks of about `block` by hash, broadcast with one
    spanning tree per label; rows stay where they are, in two passes per block (positives, then
    negatives within the windows these give). A task keeps the best per anchor and window of
    what it has seen, which also narrows the windows as it goes on.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = usable(vectors)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == size["d"])
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    anchors = scratch.write(anchors.select("vec_id", "a.label", "a.v"))
    parts = []
    for b in range(blocks := -(-anchors.count() // block)):
        chosen = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow().combine_chunks()
        if not len(chosen):
            continue
        ids, labels = (chosen.column(k).combine_chunks().to_numpy() for k in (0, 1))
        forest = spark.sparkContext.broadcast(Forest(ids, labels, matrix(chosen.column(2).combine_chunks())))
        near = first_positives(rows, forest, positives).toArrow().to_pandas()
        windows: dict[int, list[tuple]] = {}
        for anchor, rank, score in zip(near["anchor"], near["rank"], near["score"]):
            windows.setdefault(int(anchor), []).append((int(rank), -(-low * int(score) // 100), high * int(score) // 100))
        shared = spark.sparkContext.broadcast(windows)
        found = scratch.write(windowed(rows, forest, shared, negatives))
        names = spark.createDataFrame(near.assign(anchor_id=ids[near["anchor"]]), "anchor long, place int, positive_id long, positive_score long, anchor_id long")
        parts.append(scratch.write(found.join(F.broadcast(names), ["anchor", "place"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        scratch.drop(anchors, *parts)
        forest.unpersist(), shared.unpersist()
    out = spark.createDataFrame([], RESULT)
    for part in parts:
        out = out.unionByName(part)
    return out


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def first_positives(rows: DataFrame, forest, k: int) -> DataFrame:
    """(anchor, rank, vec_id, score): of each anchor of the broadcast forest the k best other rows of its label."""

    def run(batches):
        trees = forest.value
        best = [Best(k) for _ in trees.ids]

        def take(anchor, ids, scores):
            other = ids != trees.ids[anchor]
            best[anchor].offer(ids[other], scores[other])

        along(trees, batches, True, lambda anchor: (best[anchor].floor(), np.inf), take)
        yield record({"anchor": np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), "vec_id": [b.ids for b in best], "score": [b.scores for b in best]})

    found = ranked(rows.mapInArrow(run, "anchor long, vec_id long, score long"), ["anchor"], k)
    return found.select("anchor", "rank", "vec_id", "score")


def windowed(rows: DataFrame, forest, windows, k: int) -> DataFrame:
    """(anchor, place, rank, vec_id, score): per window of an anchor the k best rows of other labels in it."""

    def run(batches):
        trees = forest.value
        best = {anchor: [(place, Best(k, least, most)) for place, least, most in spans if least <= most] for anchor, spans in windows.value.items()}

        def window(anchor):
            spans = [(b.floor(), b.most) for _, b in best.get(int(anchor), ())]
            return (min(s[0] for s in spans), max(s[1] for s in spans)) if spans else None

        def take(anchor, ids, scores):
            for _, b in best[int(anchor)]:
                b.offer(ids, scores)

        along(trees, batches, False, window, take)
        held = [(anchor, place, b) for anchor, spans in best.items() for place, b in spans]
        sizes = [len(b.ids) for _, _, b in held]
        yield record({
            "anchor": np.repeat(np.array([h[0] for h in held], np.int64), sizes), "place": np.repeat(np.array([h[1] for h in held], np.int32), sizes),
            "vec_id": [b.ids for _, _, b in held], "score": [b.scores for _, _, b in held],
        })

    return ranked(rows.mapInArrow(run, "anchor long, place int, vec_id long, score long"), ["anchor", "place"], k)


def record(columns: dict) -> pa.RecordBatch:
    arrays = [pa.array(c if isinstance(c, np.ndarray) else np.concatenate([np.zeros(0, np.int64), *c])) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
