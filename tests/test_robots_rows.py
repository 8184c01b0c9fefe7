"""Robots rules as rows: the verdict of each path equals the rules read as one list."""

import random

from pyspark.sql import functions as F

from leadspark.functions import robots as R
from leadspark.operators import audit
from leadspark.schemas import ROBOTS_CAPTURE_SCHEMA


def capture(spark, files):
    rows = [(origin, 200, "text/plain", "User-agent: *\n" + "\n".join(lines)) for origin, lines in files.items()]
    return spark.createDataFrame(rows, ROBOTS_CAPTURE_SCHEMA)


def test_rows_equal_lists(spark):
    rng = random.Random(2)
    piece = lambda: rng.choice(["/a", "/b", "*", "/", "x", "$", ".html", "é"])
    files = {f"https://h{k}": [f"{rng.choice(['Allow', 'Disallow'])}: {''.join(piece() for _ in range(rng.randint(1, 4)))}" for _ in range(12)] for k in range(6)}
    files["https://none"] = []
    paths = [(k, f"https://h{rng.randrange(8)}", "/" + "".join(rng.choice(["a", "b/", "x", ".html", "é", "$", "*"]) for _ in range(rng.randint(0, 6)))) for k in range(400)]
    paths += [(1000, None, "/a"), (1001, "https://h1", None), (1002, "https://none", "/a"), (1003, "https://h2", ""), *[(2000 + k, "https://h1", "/a") for k in range(50)]]
    robots = capture(spark, files)
    df = spark.createDataFrame(paths, "id int, origin string, path string")
    got = {r.id: r.allowed for r in audit.robots_match(df, robots, "id", rows_per_task=20).collect()}
    lists = audit.parse_robots(robots)
    verdict = R.allowed(F.col("disallow"), F.col("allow"), F.col("path"))
    want = {r.id: True if r.ok is None else r.ok for r in df.join(lists, "origin", "left").select("id", verdict.alias("ok")).collect()}
    assert got == want and not all(got.values())


def test_many_rules_and_many_paths_of_one_origin(spark):
    lines = [f"Disallow: /shop/{k}/" for k in range(20_000)] + ["Allow: /shop/7/open", "Disallow: /*.pdf$"]
    df = spark.createDataFrame([(k, "https://big", f"/shop/{k}/{'open' if k == 7 else 'x'}" if k % 2 else f"/free/{k}.{'pdf' if k % 4 else 'htm'}") for k in range(2_000)], "id int, origin string, path string")
    got = {r.id: r.allowed for r in audit.robots_match(df, capture(spark, {"https://big": lines}), "id").collect()}
    assert got == {k: k == 7 if k % 2 else k % 4 == 0 for k in range(2_000)}
    assert audit.robots_match(df.limit(0), capture(spark, {"https://big": lines}), "id").count() == 0
    assert audit.robots_match(df, spark.createDataFrame([], ROBOTS_CAPTURE_SCHEMA), "id").filter("NOT allowed").count() == 0
