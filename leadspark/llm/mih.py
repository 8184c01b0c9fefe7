"""Nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.common import Scratch

#: Rows the rotations are learned on, and of those the ones that calibrate the radius.
FIT_ROWS = 8_192
FIT_QUERIES = 256
ROTATIONS = 4
SUBSTRING = 16
#: Share of the calibration neighbours that lie within the radius.
COVER = 0.99
QUERY_BLOCK = 8_192
ROW_BLOCK = 16_384


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Coder:
    """Binary codes: ROTATIONS learned rotations of the centred directions, one bit per axis."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 20, seed: int = 1):
        rng = np.random.default_rng(seed)
        x = unit(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        d = x.shape[1]
        self.turns = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(rounds):  # iterative quantisation: nearest rotation to the signs
                u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
                r = v.T @ u.T
            self.turns.append(r)
        self.bits = -(-d * rotations // 64) * 64

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, bits / 16) substrings of the code as uint16."""
        z = unit(x) - self.mean
        bits = np.concatenate([z @ r >= 0 for r in self.turns], axis=1)
        bits = np.pad(bits, ((0, 0), (0, self.bits - bits.shape[1])))
        return np.packbits(bits, axis=1).view(np.uint16)


def distance(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


class Index:
    """Multi-index over the codes of one block of rows: an inverted list per substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.lists = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, starts = np.unique(codes[order, j], return_index=True)
            self.lists.append((values, np.append(starts, len(order)), order))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within `radius` bits.

        By the pigeonhole principle, with m substrings and radius = m * t + a, such a code
        is within t bits on one of the first a + 1 substrings or within t - 1 on another.
        """
        m = len(self.lists)
        t, a = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j, (values, starts, order) in enumerate(self.lists):
            reach = t if j <= a else t - 1
            if reach < 0:
                continue
            probed = np.bitwise_count(values ^ code[j]) <= reach
            seen[order[np.repeat(probed, np.diff(starts))]] = True
        rows = np.flatnonzero(seen)
        return rows[distance(self.codes[rows], code) <= radius]


def calibrate(coder: Coder, sample: np.ndarray, k: int) -> int:
    """The radius that holds the share COVER of the sample's exact neighbours.

    Neighbours in the sample lie farther than in all rows, so the radius errs on the
    safe side.
    """
    x, codes = unit(sample), coder.codes(sample)
    radii = []
    for q in range(min(FIT_QUERIES, len(x))):
        cosine = x @ x[q]
        cosine[q] = -2
        top = np.argsort(-cosine)[: min(k, len(x) - 1)]
        radii.extend(distance(codes[top], codes[q]))
    return int(np.quantile(radii, COVER)) if radii else coder.bits


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine in double precision; equal vectors get equal values wherever they stand."""
    return np.einsum("ij,j->i", rows, query) / (np.sqrt(np.einsum("ij,ij->i", rows, rows)) * math.sqrt(float(np.dot(query, query))))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding: array<double>) of rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0)
    )


def stacked(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search_block(coder: Coder, radius: int, ids: np.ndarray, rows: np.ndarray, queries: tuple, k: int):
    """The k nearest of a block of rows for each query: (query_id, vec_id, score) arrays.

    Rows of one vec_id count once, by the nearest. The radius grows until k vec_ids other
    than the query's own are found or all rows were seen.
    """
    index = Index(coder.codes(rows))
    out = []
    for query_id, query, code in zip(*queries):
        reach = radius
        while True:
            found = index.within(code, reach)
            found = found[ids[found] != query_id]
            if len(found) >= k and len(np.unique(ids[found])) >= k or reach >= coder.bits:
                break
            reach = min(coder.bits, reach + max(8, coder.bits // 16))
        score = cosines(query, rows[found])
        top = np.lexsort((ids[found], -score))
        top = top[np.sort(np.unique(ids[found][top], return_index=True)[1])[:k]]
        out.append((np.full(len(top), query_id), ids[found][top], score[top]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows with
    another vec_id. Nearness is the cosine in double precision on the given vectors,
    ties go to the smaller vec_id. Vectors that are null, zero, hold null or non-finite
    components, or differ in length from most take no part, nor do rows without a
    vec_id. Repeated rows of one vec_id count once, by
    the nearest. With fewer than k candidates all are
    returned; an empty table gives no rows.

    The rotations and the radius come from a bounded sample. Queries are a stated set:
    they pass in broadcast blocks of at most `query_block` over all rows, which stay
    where they are; a task indexes ROW_BLOCK rows at a time and keeps k per query.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "mih")
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    shape = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == sizes["d"])
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    sample = stacked(chosen.column(1).combine_chunks())
    coder = Coder(sample)
    radius = calibrate(coder, sample, k)

    asked = rows.filter(F.col("vec_id") % every == 0)
    blocks = -(-asked.count() // query_block)
    parts = []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).dropDuplicates(["vec_id"]).toArrow()
        x = stacked(block.column(1).combine_chunks())
        queries = (block.column(0).to_numpy(), x, coder.codes(x)) if len(x) else ([], [], [])
        shared = spark.sparkContext.broadcast((coder, radius, queries))

        def run(batches, shared=shared):
            coder, radius, queries = shared.value
            held: list = []

            def out():
                ids = np.concatenate([h[0] for h in held])
                found = search_block(coder, radius, ids, np.concatenate([h[1] for h in held]), queries, k)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

            for batch in batches:
                if batch.num_rows:
                    held.append((batch.column(0).to_numpy(), stacked(batch.column(1))))
                if sum(len(h[0]) for h in held) >= ROW_BLOCK:
                    yield out()
            if held:
                yield out()

        parts.append(scratch.write(rows.mapInArrow(run, shape)))
        shared.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
