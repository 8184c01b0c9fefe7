"""Hard negatives: bounds, products and whole results against a plain loop over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, count=3):
    found = []
    for vec_id, x, label in rows:
        if vec_id is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
            found.append((vec_id, label, [math.floor(256 * float(np.float32(v))) for v in x]))
    sizes = [len(r[2]) for r in found]
    size = min(set(sizes), key=lambda s: (-sizes.count(s), s), default=0)
    found = [r for r in found if len(r[2]) == size]
    out = []
    for anchor in sorted({r[0] for r in found if r[0] % 50 == 0}):
        _, label, a = min(r for r in found if r[0] == anchor)
        near = sorted({(-sum(p * q for p, q in zip(a, v)), i, k == label) for i, k, v in found if i != anchor})
        for s, positive, _ in [n for n in near if n[2]][:positives]:
            fit = [n for n in near if not n[2] and 50 * -s <= 100 * -n[0] <= 95 * -s][:count]
            out += [(anchor, positive, rank + 1, n[1], -s, -n[0]) for rank, n in enumerate(fit)]
    return sorted(out)


def some(seed, n=400, d=5, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randint(0, 3)) for i in range(-n // 4, n)]
    rows += [(i + 1, list(x), k) for i, x, k in rows[::17]]  # equal vectors and repeated ids
    rows += [rows[3], rows[100], (50, [0.0] * d, 1), (None, [1.0] * d, 1), (1000, None, 1), (1001, [1.0] * d, None)]
    rows += [(1050, [float("nan")] + [0.0] * (d - 1), 2), (1100, [None] + [0.0] * (d - 1), 2), (1150, [1.0] * (d + 1), 2), (1200, [], 1), (1250, [math.inf] * d, 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, spread", [(2048, 1.0), (3, 0.05), (2048, 0.001)])
def test_equals_a_plain_loop(spark, block, spread):
    rows = some(block, spread=spread)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("x", F.lit(1))
    got = sorted(map(tuple, negatives.hard_negatives(df.repartition(3), block=block).collect()))
    assert got == plain(rows) and got


def test_empty_tables(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(3, None, 1), (50, [], 1), (100, [], 1), (7, [], 0)], SCHEMA)).collect() is not None


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (5, 16))
    vectors = (centres[rng.integers(0, 5, 900)] + rng.integers(-3, 4, (900, 16))).astype(np.int64)
    anchors = vectors[::30]
    forest = negatives.Forest(np.arange(len(anchors)), np.zeros(len(anchors), np.int64), anchors)
    (label, nodes, parents, edges), = forest.trees
    assert sorted(nodes) == list(range(len(anchors))) and all(parents[k] < k for k in range(1, len(nodes)))
    assert np.allclose(edges[1:], [np.linalg.norm(anchors[nodes[k]] - anchors[nodes[parents[k]]]) for k in range(1, len(nodes))])
    exact, scored = vectors @ anchors.T, 0
    least = {a: np.sort(exact[:, a])[-5] for a in range(len(anchors))}
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    for anchor, which, scores in negatives.walk(forest.trees[0], negatives.Products(vectors, anchors), norms, lambda a: (least[a], np.inf)):
        assert (scores == exact[which, anchor]).all() and set(np.flatnonzero(exact[:, anchor] >= least[anchor])) <= set(which)
        scored += len(which)
    assert scored < exact.size / 2


@pytest.mark.parametrize("top", [100, 2**29, 2**40])
def test_products_are_exact(top):
    rng = random.Random(top)
    rows, anchors = ([[rng.randint(-top, top) for _ in range(4)] for _ in range(5)] for _ in range(2))
    products = negatives.Products(np.array(rows, np.int64), np.array(anchors, np.int64))
    for k, a in enumerate(anchors):
        want = [max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(r, a)))) for r in rows]
        assert products.scores(np.arange(5), k).tolist() == want
