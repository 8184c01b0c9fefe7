"""Sweeps under a budget, deep trees, the tile cache and its versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leadspark.operators import scan, tiles
from leadspark.sources.snapshots import Snapshot
from leadspark.sources.stage import fresh_path

ROOT = dict(sw_lat=0.0, sw_lng=0.0, ne_lat=1.0, ne_lng=1.0)
POINTS = "term string, lat double, lng double"


def cost(n):
    return max(1, math.ceil(min(n, 60) / 20))


def sweep(points, max_depth, budget, ceiling=60):
    """The recursive sweep with calls counted: nodes in order, calls, whether a visit was refused."""
    state, nodes = {"calls": 0, "halted": False}, []

    def visit(inside, depth, gy, gx):
        if state["halted"] or state["calls"] >= budget:
            state["halted"] = True
            return
        pages = min(cost(len(inside)), budget - state["calls"])
        state["calls"] += pages
        cut = pages < cost(len(inside))
        full, why = cut or len(inside) >= ceiling, None
        if full:
            why = "maxDepth" if depth >= max_depth else "halted" if state["calls"] >= budget else None
        nodes.append((depth, gy, gx, pages * 20 if cut else len(inside), full, full and why is None, why, pages))
        if full and why is None:
            for dy in (0, 1):
                for dx in (0, 1):
                    y, x = gy * 2 + dy, gx * 2 + dx
                    part = [p for p in inside if int(p[0] * 2 ** (depth + 1)) == y and int(p[1] * 2 ** (depth + 1)) == x]
                    visit(part, depth + 1, y, x)

    return visit, nodes, state


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 7, 20, 61, 150, 10_000])
def test_a_budget_halts_the_sweep(spark, budget):
    rnd = random.Random(5)
    data = {t: [(rnd.random() ** 3, rnd.random() ** 3) for _ in range(n)] for t, n in (("a", 900), ("b", 45), ("c", 700))}
    df = spark.createDataFrame([(t, *p) for t, ps in data.items() for p in ps], POINTS)
    got = tiles.budgeted_sweep(tiles.quadtree_tiles(df, ROOT, 4), budget, ROOT, 4)
    spent, want, halted = 0, [], {}
    for term in data:
        visit, nodes, state = sweep(data[term], 4, budget - spent)
        visit(data[term], 0, 0, 0)
        spent, halted[term] = spent + state["calls"], state["halted"]
        want += [(term, *n) for n in nodes]
    rows = got.collect()
    searched = sorted((r for r in rows if r.searched), key=lambda r: (r.term, r.path))
    assert [(r.term, r.depth, r.gy, r.gx, r.item_count, r.truncated, r.split, r.split_blocked_by, r.calls) for r in searched] == want
    assert all(r.calls is None and r.split is None for r in rows if not r.searched)
    assert {r.term: r.halted for r in tiles.sweep_summary(got, ("term",)).collect()} == halted
    total = 0
    for r in searched:
        assert r.calls_before == total
        total += r.calls


def test_cached_tiles_cost_nothing(spark):
    df = spark.createDataFrame([("a", 0.1 * k / 100, 0.1) for k in range(100)], POINTS)
    tree = tiles.quadtree_tiles(df, ROOT, 2)
    keys = tiles.with_corners(tree, ROOT).filter("depth < 2").select("tile_key")
    rows = tiles.budgeted_sweep(tree, 4, ROOT, 2, cached=keys).filter("searched").collect()
    assert sum(r.calls for r in rows) == 4 and {r.calls for r in rows if r.depth < 2} == {0}


def test_deep_trees_go_down_where_points_cluster(spark):
    cluster = [("t", 0.3 + k * 2.0**-44, 0.7) for k in range(70)]
    df = spark.createDataFrame(cluster + [("t", 0.9, 0.9), ("u", 0.5, 0.5)], POINTS)
    deep = tiles.quadtree_tiles(df, ROOT, 40, terms=spark.createDataFrame([("t",), ("v",), ("v",)], "term string")).collect()
    by = {t: [r for r in deep if r.term == t] for t in "tuv"}
    assert len(by["t"]) == 1 + 4 * 40 or max(r.depth for r in by["t"]) < 40
    assert len(by["u"]) == 1 and [(r.depth, r.item_count, r.split) for r in by["v"]] == [(0, 0, False)]
    for r in by["t"]:
        inside = [p for p in [*cluster, ("t", 0.9, 0.9)] if int(p[1] * 2**r.depth) == r.gy and int(p[2] * 2**r.depth) == r.gx]
        assert r.item_count == len(inside)
    for stride in (1, 3, 40):
        other = tiles.quadtree_tiles(df.filter("term = 't'"), ROOT, 40, stride=stride).collect()
        assert sorted(map(str, other)) == sorted(map(str, by["t"]))


def test_blocked_by_precision(spark):
    low = 39.867
    hair = dict(sw_lat=low, sw_lng=-75.28, ne_lat=math.nextafter(low, 90), ne_lng=math.nextafter(-75.28, 0))
    df = spark.createDataFrame([("t", low, -75.28)] * 60, POINTS)
    rows = tiles.quadtree_tiles(df, hair, 40).collect()
    assert [(r.depth, r.truncated, r.split, r.split_blocked_by) for r in rows] == [(0, True, False, "precision")]
    same = spark.createDataFrame([("t", 0.3, 0.3)] * 60, POINTS)
    near = dict(sw_lat=0.25, sw_lng=0.25, ne_lat=0.25 + 2.0**-50, ne_lng=0.5)
    assert tiles.quadtree_tiles(same.withColumn("lat", F.lit(0.25)), near, 40).filter("truncated AND NOT split").first().split_blocked_by == "precision"
    with pytest.raises(ValueError):
        tiles.quadtree_tiles(df, ROOT, -1)


def test_empty_points(spark):
    none = spark.createDataFrame([], POINTS)
    assert tiles.quadtree_tiles(none, ROOT, 3).count() == 0
    assert tiles.budgeted_sweep(tiles.quadtree_tiles(none, ROOT, 3), 5, ROOT, 3).count() == 0


def test_running_total_with_nulls_and_many_ranges(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), k, rnd.choice([None, 1, 2, 5])) for k in range(500)]
    df = spark.createDataFrame(rows, "term string, k int, n int").repartition(7)
    want, total = {}, 0
    for term, k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        want[k], total = total, total + (n or 0)
    assert {r.k: r.before for r in scan.running_total(df, ["term", "k"], "n").collect()} == want


NOW = "2026-08-08 00:00:00"
ANSWERS = "tile_key string, places array<struct<id: string>>, truncated boolean"


def now():
    return F.lit(NOW).cast("timestamp")


def answers(spark, rows):
    return spark.createDataFrame([(k, [(p,) for p in ps], t) for k, ps, t in rows], ANSWERS)


def test_cache_is_replayed_and_written(spark):
    cache = answers(spark, [("a", ["p1", "p2"], True), ("b", ["old"], False), ("c", ["bad"], None), ("d", [], None), ("a", ["p0"], False)])
    at = F.when(F.col("tile_key") == "b", "2026-01-01T00:00:00Z").when(F.col("tile_key") == "c", "junk")
    at = at.when(F.try_element_at("places", F.lit(1))["id"] == "p0", "2026-08-06T00:00:00Z").otherwise("2026-08-07T00:00:00Z")
    cache = cache.withColumn("at", at)
    planned = spark.createDataFrame([("t", k) for k in "abcdef"], "term string, tile_key string")
    fetched = answers(spark, [("b", ["n1"], True), ("c", [], False), ("a", ["never"], False), ("e", ["n2", "n3"], None)])
    replay = tiles.cache_replay(planned, cache, fetched, now())
    got = {r.tile_key: (r.source, r.truncated, [p.id for p in r.places] if r.places is not None else None) for r in replay.collect()}
    assert got == {"a": ("cached", True, ["p1", "p2"]), "b": ("paid", True, ["n1"]), "c": ("paid", False, []), "d": ("cached", False, []),
                   "e": ("paid", False, ["n2", "n3"]), "f": (None, None, None)}
    assert tuple(tiles.cache_use(replay).collect()[0]) == ("t", 2, 3, 1)
    assert sorted((r.tile_key, r.pos, r.place.id) for r in tiles.replayed_batches(replay).collect()) == [
        ("a", 0, "p1"), ("a", 1, "p2"), ("b", 0, "n1"), ("e", 0, "n2"), ("e", 1, "n3")]
    after = {r.tile_key: (r.at[:10], r.truncated, len(r.places)) for r in tiles.cache_next(cache, fetched.filter("tile_key <> 'a'"), now()).collect()}
    assert after["b"] == ("2026-08-08", True, 1) and after["c"] == ("2026-08-08", False, 0) and after["d"] == ("2026-08-07", False, 0)


def test_a_second_run_pays_nothing(spark):
    folder = fresh_path(spark, "tile-cache")
    planned = spark.createDataFrame([("t", f"k{i}") for i in range(200)], "term string, tile_key string")
    paid = answers(spark, [(f"k{i}", [f"p{i}"], i % 3 == 0) for i in range(200)])
    first = tiles.flush_cache(spark, folder, paid, now(), "run-1")
    assert first.count() == 200 and first.filter("truncated").count() == 67
    assert tiles.tiles_to_pay(planned, first, now()).count() == 0
    one = tiles.flush_cache(spark, folder, answers(spark, [("k5", ["new"], True)]), now(), "run-2")
    version = Snapshot(spark, folder, "tile_key").version()
    assert len({p["path"].split("/")[1] for p in version["parts"].values()}) == 2 and version["number"] == 2
    assert sum("0000000002-" in p["path"] for p in version["parts"].values()) == 1
    assert one.filter("tile_key = 'k5'").first().places[0].id == "new" and one.count() == 200
    assert tiles.flush_cache(spark, folder, answers(spark, [("k5", ["again"], True)]), now(), "run-2").filter("places[0].id = 'again'").count() == 0
    later = F.lit("2026-09-08 00:00:00").cast("timestamp")
    assert tiles.flush_cache(spark, folder, answers(spark, [("k1", ["x"], False)]), later, "run-3").count() == 1


def test_versions_share_and_clash(spark):
    folder = fresh_path(spark, "snapshot")
    table = Snapshot(spark, folder, "id", 4)
    assert table.read() is None and table.rows() == 0
    rows = spark.range(100).withColumn("v", F.lit("old"))
    assert table.commit(rows, None, "a") and not table.commit(rows, None, "a")
    touched = table.buckets_of(spark.createDataFrame([(7,)], "id long"))
    part = table.read(touched).withColumn("v", F.lit("new"))
    before = table.version()
    assert table.commit(part, touched, "b") and table.rows() == 100
    assert table.read().filter("v = 'new'").count() == part.count() == table.rows() - table.rows(touched)
    with pytest.raises(ValueError):
        table.commit(rows, touched)
    stale = Snapshot(spark, folder, "id", 4)
    stale.version = lambda: before
    with pytest.raises(FileExistsError):
        stale.commit(part, touched, "c")
    table.vacuum()
    assert table.read().count() == 100 and table.commit(rows.limit(0), touched) and table.read().count() == table.rows() == 100 - part_rows(rows, table, touched)


def part_rows(rows, table, touched):
    return rows.filter(table.bucket().isin(touched)).count()
