"""Captured pages and saved runs: nothing vanishes, order and headers are kept."""

import threading

import pytest
from pyspark.sql import functions as F

from leadspark.functions import fixed as V
from leadspark.operators import ingest, market, skew
from leadspark.plans import pipelines
from leadspark.sources import files, stage

GOOD = '{"id":"%s","displayName":{"text":"n"},"location":{"latitude":1.5,"longitude":2.5}}'


def pages(spark, rows):
    return spark.createDataFrame(rows, "term string, tile_key string, page_no int, body string, next_token string")


def test_unreadable_pages_are_rejected_and_truncate_their_tile(spark):
    one = '{"places":[' + GOOD % "a" + "]}"
    rows = [
        ("t", "whole", 1, one, None), ("t", "empty", 1, "{}", None), ("t", "gap", 1, one, "x"), ("t", "gap", 3, one, None),
        ("t", "broken", 1, '{"places":[', None), ("t", "object", 1, '{"places":{"id":"a"}}', None), ("t", "null", 1, None, None),
        ("t", "text", 1, '{"places":"[]x"}', None), ("t", "twice", 1, one, "x"), ("t", "twice", 1, one, "x"), ("t", "twice", 2, one, None),
        ("t", "array", 1, "[]", None),
    ]
    df = pages(spark, rows)
    rejected = {(r.tile_key, r.pos, r.error) for r in ingest.rejected_places(df).collect()}
    unread = ["broken", "object", "null", "array"]
    assert {(k, -1, "unreadable page") for k in unread} <= rejected
    tiles = spark.createDataFrame([("t", k) for k in {r[1] for r in rows} | {"none"}], "term string, tile_key string")
    done = {r.tile_key: (r.truncated, r.raw_returned, r.pages_fetched) for r in ingest.tile_completeness(tiles, df).collect()}
    assert done["whole"] == (False, 1, 1) and done["empty"] == (False, 0, 1) and done["twice"] == (False, 2, 2)
    assert done["gap"] == (True, 2, 2) and done["none"] == (True, 0, 0)
    assert all(done[k][0] for k in unread)
    assert ingest.ingest_places(df).count() == 6


def test_each_record_is_parsed_once(spark):
    out = ingest.ingest_places(pages(spark, [("t", "k", 1, '{"places":[]}', None)]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert not any("parse" in line.lower() for line in filters)


def run_rows(spark, ids, **more):
    base = {c: F.lit("") for c in V.ENRICHED_COLUMNS} | {"reachable": F.lit("yes")} | {k: F.lit(v) for k, v in more.items()}
    df = spark.createDataFrame([(i,) for i in ids], "place_id string")
    return df.select(*[F.col("place_id") if c == "place_id" else base[c].alias(c) for c in V.ENRICHED_COLUMNS])


def test_runs_of_three_header_generations_give_one_table(spark, tmp_path):
    folder = str(tmp_path)
    first = run_rows(spark, [f"p{k}" for k in range(40)], name="old").repartition(4)
    files.write_csv(first.drop("audit_error"), f"{folder}/20260801-100000_town_gym.csv")
    files.write_csv(run_rows(spark, ["p1", "p2", "p1"], name="mid").coalesce(1).withColumn("extra", F.lit("x")), f"{folder}/20260802-100000_town_gym.csv")
    files.write_csv(run_rows(spark, ["p2"], name="new").coalesce(1), f"{folder}/20260803-100000_town_gym.csv")
    files.write_csv(spark.createDataFrame([("x",)], "name string"), f"{folder}/20260804-100000_town_gym.csv")
    files.write_csv(run_rows(spark, ["q"]).coalesce(1), f"{folder}/notes.csv")
    stored = spark.createDataFrame([], "generation int, ord long, " + ", ".join(f"{c} string" for c in V.STORED_COLUMNS))
    table, refused = pipelines.push_saved_runs(spark, f"{folder}/*.csv", stored, F.lit("now"))
    rows = {r.place_id: r for r in table.collect()}
    assert len(rows) == 40 and len({r.ord for r in rows.values()}) == 40
    assert (rows["p2"].name, rows["p1"].name, rows["p3"].name) == ("new", "mid", "old")
    assert [r.file for r in refused.collect()] == ["notes.csv"]


def test_two_writers_never_share_a_name(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "place_id string")
    names, faults = [], []

    def write():
        try:
            names.append(files.write_unique(rows, str(tmp_path), "run"))
        except Exception as error:  # noqa: BLE001
            faults.append(error)

    threads = [threading.Thread(target=write) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    names.append(files.write_unique(rows, str(tmp_path), "run"))
    assert len(set(names)) == len(names) and names[-1] != f"{tmp_path}/run.csv"


def test_null_keys_are_joined_or_spread(spark):
    rows = spark.createDataFrame([(k, None if k % 2 else "a") for k in range(200)], "i int, k string")
    dim = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    safe = skew.join_by_key(rows, dim, ["k"], "i", rows_per_task=10, null_safe=True)
    assert {(r.k, r.v) for r in safe.collect()} == {("a", 1), (None, 2)} and safe.count() == 200
    plain = skew.join_by_key(rows, dim, ["k"], "i", rows_per_task=10)
    assert {(r.k, r.v) for r in plain.collect()} == {("a", 1), (None, None)} and plain.count() == 200
    leads = spark.createDataFrame(
        [(f"p{k}", None, "n", "yes", "yes", "yes", 100) for k in range(3)],
        "place_id string, market string, niche string, reachable string, viewport string, https string, ttfb_ms int",
    )
    assert all(r.corpus.n == 3 for r in market.join_corpus(leads).collect())


class Remote:
    """A session whose executors are elsewhere."""

    def __init__(self, folder):
        self.folder = folder
        self.sparkContext = type("Context", (), {"master": "spark://host:7077"})

    @property
    def conf(self):
        return {"spark.checkpoint.dir": self.folder} if self.folder else {}


def test_a_cluster_must_name_its_shared_folder(spark):
    with pytest.raises(ValueError):
        stage.shared_dir(Remote(None))
    assert stage.shared_dir(Remote("hdfs://x/y/")) == "hdfs://x/y"


def test_staged_tables_are_released(spark):
    kept = stage.staged(spark.range(5).toDF("n"))
    assert kept.count() == 5
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    stage.release(spark)
    import os

    assert not os.path.exists(path)
