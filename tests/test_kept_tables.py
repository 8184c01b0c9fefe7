"""The working table in buckets, its pages by range, and the ledger of runs."""

import pytest
from pyspark.sql import functions as F
from test_tiles_store import incoming, now, patches, stored

from leadspark.functions import fixed as V
from leadspark.operators import contacts, gates, store
from leadspark.sources.stage import fresh_path


def rows_of(df):
    return sorted(map(str, df.drop("generation").collect()))


def test_a_batch_writes_only_its_buckets(spark):
    before = stored(spark, range(1, 301))
    table = store.working_table(spark, fresh_path(spark, "kept"), 32)
    table.commit(before, None, "start")
    batch = incoming(spark, [(1, "p1", "first"), (2, "p999", "one"), (3, "p999", "two"), (4, "", "blank"), (5, "p1", "second")])
    assert tuple(store.upsert_table(table, batch, now(), "b1").collect()[0]) == (1, 2, 301)
    written = [p["path"] for p in table.version()["parts"].values()]
    assert 1 <= sum("/0000000002-" in p for p in written) <= 2 and len(written) >= 30
    assert rows_of(table.read()) == rows_of(store.upsert_leads(before, batch, now()))
    number = table.version()["number"]
    assert tuple(store.upsert_table(table, batch, now(), "b1").collect()[0]) == (0, 0, 301) and table.version()["number"] == number
    assert tuple(store.upsert_table(table, batch.limit(0), now(), "none").collect()[0]) == (0, 0, 301)
    store.upsert_table(table, incoming(spark, [(1, "p1000", "later")]), now(), "b2")
    newest = store.page_newest(table.read(), 2).collect()
    assert [r.place_id for r in newest] == ["p1000", "p999"] and newest[0].generation > newest[1].generation > 0


def test_patches_write_only_their_buckets_or_nothing(spark):
    table = store.working_table(spark, fresh_path(spark, "kept"), 16)
    table.commit(stored(spark, range(1, 101)), None, "start")
    log = store.patch_table(table, patches(spark, [(1, "p1", "phone", "a"), (2, "p1", "notes", None)]), "e1").collect()
    assert len(log) == 2 and table.read().filter("place_id = 'p1'").first().phone == "a" and table.rows() == 100
    assert store.patch_table(table, patches(spark, [(1, "p1", "phone", "b"), (2, "p7777", "phone", "x")]), "e2").count() == 0
    assert table.version()["number"] == 2 and store.patch_table(table, patches(spark, [(1, "p1", "phone", "b")]).limit(0), "e3").count() == 0


def test_a_first_batch_into_no_table(spark):
    table = store.working_table(spark, fresh_path(spark, "kept"), 8)
    batch = incoming(spark, [(1, "p1", "x"), (2, "p2", "y")])
    whole = batch.select("ord", *[F.col(c) if c in batch.columns else F.lit("").alias(c) for c in V.STORED_COLUMNS])
    assert tuple(store.upsert_table(table, whole, now(), "b").collect()[0]) == (2, 0, 2) and table.read().count() == 2


@pytest.mark.parametrize("limit, offset", [(7, 0), (20, 95), (500, 60), (3, 998), (5, 5000), (None, None)])
def test_any_page_reads_only_its_ranges(spark, limit, offset):
    table = stored(spark, range(1, 1001)).withColumn("generation", (F.col("ord") % 3).cast("int"))
    folder = fresh_path(spark, "pages")
    store.write_pages(table, folder, 100)
    page = store.read_page(spark, folder, limit, offset)
    assert [r.place_id for r in page.collect()] == [r.place_id for r in store.page_newest(table, limit, offset).collect()]
    files = {f.split("_range=")[1].split("/")[0] for f in page.inputFiles()} if page.count() else set()
    assert len(files) <= -(-(limit or 500) // 60) + 2


def test_a_larger_table_has_larger_ranges_and_is_made_once(spark, monkeypatch):
    monkeypatch.setattr(store, "RANGES", 4)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    rows = stored(spark, range(1, 1001)).withColumn("generation", (F.col("ord") % 3).cast("int"))
    folder = fresh_path(spark, "pages")
    store.write_pages(rows.mapInPandas(counted, rows.schema), folder, 10)
    assert made.value == 1000
    assert 2 <= spark.read.parquet(f"{folder}/ranges").count() <= 4
    page = [r.place_id for r in store.read_page(spark, folder, 30, 480).collect()]
    assert page == [r.place_id for r in store.page_newest(rows, 30, 480).collect()]


def test_pages_follow_one_another_by_key(spark):
    table = stored(spark, range(1, 301)).withColumn("generation", (F.col("ord") % 2).cast("int"))
    seen, last = [], None
    while rows := store.page_after(table, last, 70).collect():
        seen += [r.place_id for r in rows]
        last = (rows[-1].generation, rows[-1].ord, rows[-1].place_id)
    assert seen == [r.place_id for r in table.orderBy(*store.newest_first()).collect()]
    assert store.page_after(table.limit(0)).count() == 0


def test_two_appends_and_a_retry_give_two_batches(spark):
    run = spark.createDataFrame([("f1.csv", ["a", "b"], True, None)], "file string, terms array<string>, halted boolean, aborted boolean")
    run = run.select(*[F.col(c) if c in run.columns else F.lit(1).alias(c) for c in V.RUN_COLUMNS])
    folder = fresh_path(spark, "runs")
    store.append_run(run, folder, "one")
    for _ in range(2):
        ledger = store.append_run(run.withColumn("file", F.lit("f2.csv")), folder, "two")
    assert sorted((r.file, r.terms, r.halted, r.aborted) for r in ledger.collect()) == [("f1.csv", "a b", "yes", "no"), ("f2.csv", "a b", "yes", "no")]


def test_stale_rows_are_listed_or_left_out(spark):
    rows = [("old", "2026-06-20T00:00:00Z"), ("edge", "2026-07-05T00:00:00Z"), ("junk", "soon"), ("none", None)]
    table = spark.createDataFrame(rows, "place_id string, google_refreshed_at string")
    at = F.lit("2026-08-04 00:00:00").cast("timestamp")
    assert [(r.place_id, r.age_days) for r in gates.stale_list(table, at).collect()] == [("old", 45)]
    assert sorted(r.place_id for r in gates.without_stale(table, at).collect()) == ["edge", "junk", "none"]


def test_the_contact_table_of_no_leads(spark):
    checks = spark.createDataFrame([], "channel string, kind string")
    lines = contacts.contact_table(checks, spark.createDataFrame([], "ord long"), F.lit("2026-08-04")).orderBy("line_no").collect()
    assert lines[0].line == "# Contact verification — 0 leads" and lines[4].line == "| Website loads | Actually fetched | 0 | **0** |"
