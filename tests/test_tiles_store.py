import random

import pytest
from pyspark.sql import functions as F

from leadspark.functions import fixed as V
from leadspark.operators import store, tiles
from leadspark.plans import pipelines
from leadspark.sources import files
from leadspark.sources.stage import fresh_path

ROOT = dict(sw_lat=0.0, sw_lng=0.0, ne_lat=1.0, ne_lng=1.0)


def sweep(points, depth, gy, gx, max_depth, ceiling, out):
    here = [p for p in points if int(p[0] * 2**depth) == gy and int(p[1] * 2**depth) == gx]
    full = len(here) >= ceiling
    out.append((depth, gy, gx, len(here), full, full and depth < max_depth))
    if full and depth < max_depth:
        for dy in (0, 1):
            for dx in (0, 1):
                sweep(points, depth + 1, gy * 2 + dy, gx * 2 + dx, max_depth, ceiling, out)


def test_quadtree_equals_recursion(spark):
    rnd = random.Random(3)
    points = [(rnd.random() ** 3, rnd.random() ** 3) for _ in range(800)]
    want = []
    sweep(points, 0, 0, 0, 4, 40, want)
    df = spark.createDataFrame([("t", *p) for p in points], "term string, lat double, lng double")
    got = tiles.quadtree_tiles(df, ROOT, 4, ceiling=40)
    assert sorted((r.depth, r.gy, r.gx, r.item_count, r.truncated, r.split) for r in got.collect()) == sorted(want)
    row = tiles.sweep_summary(got).collect()[0]
    assert row.tiles_searched == len(want) and row.tiles_split * 4 + 1 == len(want)
    assert row.truncated_leaves == sum(1 for t in want if t[4] and not t[5])


def test_edges_belong_to_one_cell(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.0, 1.0), (0.0, 0.0), (1.1, 0.5)], "lat double, lng double")
    got = [(r.lat, r.gy, r.gx) for r in tiles.point_in_tile(df, ROOT, 1).collect()]
    assert got == [(0.5, 1, 1), (1.0, 1, 1), (0.0, 0, 0)]


def test_cache_age_is_strict(spark):
    rows = [("a", "2026-08-01T00:00:00Z", ["x"]), ("b", "2026-08-01T00:00:01Z", ["x"]), ("c", "junk", ["x"]), ("d", None, ["x"]), ("e", "2026-08-05T00:00:00Z", None)]
    cache = spark.createDataFrame(rows, "tile_key string, at string, places array<string>")
    now = F.lit("2026-08-08 00:00:00").cast("timestamp")
    assert [r.tile_key for r in tiles.fresh(cache, now).collect()] == ["b"]
    assert {r.tile_key for r in tiles.tiles_to_pay(cache.select("tile_key"), cache, now).collect()} == {"a", "c", "d", "e"}


def stored(spark, ids):
    cols = {c: F.lit("old").alias(c) for c in V.STORED_COLUMNS}
    return spark.createDataFrame([(i, f"p{i}") for i in ids], "ord long, place_id string").select(
        "ord", F.lit(0).alias("generation"), *["place_id" if c == "place_id" else cols[c] for c in V.STORED_COLUMNS])


def incoming(spark, rows):
    df = spark.createDataFrame(rows, "ord long, place_id string, name string")
    return df.select("ord", "place_id", "name", *[F.lit("new").alias(c) for c in store.MACHINE_COLUMNS if c not in ("name", "last_seen")])


def now():
    return F.lit("now")


def test_upsert_touches_only_its_own_columns(spark):
    batch = incoming(spark, [(1, "p1", "first"), (2, "p9", "one"), (3, "p9", "two"), (4, "", "blank"), (5, "p1", "second")])
    table = store.upsert_leads(stored(spark, [1, 2]), batch, now())
    rows = {r.place_id: r for r in table.collect()}
    assert set(rows) == {"p1", "p2", "p9"}
    assert (rows["p1"].name, rows["p1"].first_listed, rows["p1"].last_seen, rows["p1"].notes) == ("second", "old", "now", "old")
    assert (rows["p9"].name, rows["p9"].first_listed, rows["p9"].review_status, rows["p9"].notes) == ("two", "now", "unreviewed", "")
    assert (rows["p2"].name, rows["p2"].last_seen) == ("old", "old")
    assert tuple(store.upsert_counts(stored(spark, [1, 2]), batch).collect()[0]) == (1, 2, 3)
    again = store.upsert_leads(table, batch, now())
    assert sorted(map(str, again.drop("generation", "ord").collect())) == sorted(map(str, table.drop("generation", "ord").collect()))


def patches(spark, rows):
    return spark.createDataFrame(rows, "ord int, place_id string, `column` string, value string")


def test_patches_see_the_ones_before_them(spark):
    p = patches(spark, [(1, "p1", "phone", "a"), (2, "p1", "phone", "a"), (3, "p1", "notes", None)])
    log = store.patch_log(stored(spark, [1, 2]), p).orderBy("ord").collect()
    assert [(r.before, r.after, r.changed) for r in log] == [("old", "a", True), ("a", "a", False), ("old", "", True)]
    rows = {r.place_id: r for r in store.patch_cells(stored(spark, [1, 2]), p).collect()}
    assert (rows["p1"].phone, rows["p1"].notes, rows["p1"].last_seen, rows["p2"].phone) == ("a", "", "old", "old")


@pytest.mark.parametrize("bad", [[(9, "", "phone", "x")], [(9, "p1", "score", "x")], [(9, "p7", "phone", "x")],
                                 [(i, "p1", "phone", "x") for i in range(10, 511)]])
def test_one_bad_patch_refuses_the_batch(spark, bad):
    p = patches(spark, [(1, "p1", "phone", "a"), *bad])
    assert store.patch_violations(stored(spark, [1]), p).count() >= 1
    assert store.patch_cells(stored(spark, [1]), p).collect()[0].phone == "old"
    assert store.patch_log(stored(spark, [1]), p).count() == 0


def test_pages_are_clamped(spark):
    table = stored(spark, range(1, 1201))
    assert store.page_newest(table).count() == 500
    assert store.page_newest(table, 5000).count() == 1000
    assert [r.ord for r in store.page_newest(table, 2, 1).collect()] == [1199, 1198]


ROWS = [("p1", 'Smith, "Jones" & Co', "line one\nline two", "4.5"), ("p2", "  spaced  ", "", "n/a"), ("p3", "Ünï", "x", "")]


def text_rows(spark):
    df = spark.createDataFrame(ROWS, "place_id string, name string, address string, rating string")
    return df.select(*[c if c in df.columns else F.lit("").alias(c) for c in V.ENRICHED_COLUMNS])


def test_csv_round_trip(spark):
    path = fresh_path(spark, "csv") + "/20260826-104812_camden-nj_law-firm.csv"
    files.write_csv(text_rows(spark).coalesce(1), path)
    raw = spark.sparkContext.binaryFiles(path + "/part-*").collect()[0][1]
    assert raw.startswith("﻿place_id,".encode()) and raw.split(b"\r\n")[0].endswith(b",score")
    back = files.read_csv_text(spark, path, V.ENRICHED_COLUMNS)
    assert sorted((r.place_id, r.name, r.address, r.rating) for r in back.collect()) == ROWS
    leads = {r.place_id: r for r in files.scan_lead_csv(spark, path).collect()}
    assert leads["p1"].rating == 4.5 and leads["p2"].rating is None and leads["p3"].audited is False
    label = files.file_labels(back.limit(1)).collect()[0]
    assert (str(label.run_at), label.run_location, label.run_niche) == ("2026-08-26 10:48:12", "camden nj", "law firm")


def test_older_and_foreign_files(spark):
    old, foreign = fresh_path(spark, "old"), fresh_path(spark, "foreign")
    text_rows(spark).select("name", "place_id").write.csv(old, header=True)
    text_rows(spark).select("name").write.csv(foreign, header=True)
    assert {r.address for r in files.read_csv_text(spark, old, V.ENRICHED_COLUMNS).collect()} == {""}
    assert files.read_csv_text(spark, foreign, V.ENRICHED_COLUMNS).count() == 0


def test_saved_runs_are_pushed_oldest_first(spark):
    folder = fresh_path(spark, "runs")
    for name, who in [("20260101-000000_a_gym", "early"), ("20260201-000000_b_gym", "late"), ("unlabelled", "refused")]:
        files.write_csv(text_rows(spark).limit(1).withColumn("name", F.lit(who)), f"{folder}/{name}.csv")
    table, refused = pipelines.push_saved_runs(spark, f"{folder}/*.csv", stored(spark, []), now())
    assert [(r.place_id, r.name, r.search_location) for r in table.collect()] == [("p1", "late", "b")]
    assert [r.file for r in refused.collect()] == ["unlabelled.csv"]


def test_a_run_never_overwrites_another(spark):
    folder = fresh_path(spark, "unique")
    assert files.write_unique(text_rows(spark), folder, "run").endswith("/run.csv")
    assert files.write_unique(text_rows(spark), folder, "run").endswith("/run-2.csv")
