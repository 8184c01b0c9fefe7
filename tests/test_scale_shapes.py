"""Hot keys, plan shapes and independence of row order."""

import random

from pyspark.sql import functions as F

from leadspark.operators import dedupe
from leadspark.operators.skew import join_by_key


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(5000).select(
        F.concat(F.lit("r"), "id").alias("rid"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"))
    dim = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    salted = join_by_key(rows, dim, ["k"], "rid", rows_per_task=100).select("rid", "k", "v")
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, rows.join(dim, "k", "left").select("rid", "k", "v").collect()), key=str)


def test_first_per_key_limits_before_the_shuffle(spark):
    b = spark.range(1000).select(
        F.concat(F.lit("p"), F.col("id") % 2).alias("place_id"), (F.col("id") % 5).alias("batch"), F.col("id").alias("pos"))
    text = plan(dedupe.dedupe_first(b))
    assert "Partial" in text and text.count("WindowGroupLimit") == 2
    for parts in (1, 7):
        got = dedupe.dedupe_first(b.repartition(parts)).collect()
        assert sorted((r.place_id, r.batch, r.pos) for r in got) == [("p0", 0, 0), ("p1", 0, 5)]


def brute(leads):
    claimed, out = set(), []
    for name in ("email", "phone", "website"):
        groups = {}
        for lead in leads:
            if lead[name]:
                groups.setdefault(lead[name], []).append(lead)
        for value, group in groups.items():
            fresh = [g for g in group if g["place_id"] not in claimed]
            if len(fresh) >= 2:
                claimed |= {g["place_id"] for g in fresh}
                out += [(name, value, len(fresh), g["place_id"]) for g in fresh]
    return sorted(out)


def test_duplicate_groups_match_brute_force_with_hot_keys(spark):
    rnd = random.Random(5)
    leads = []
    for i in range(600):
        leads.append(dict(
            place_id=f"p{i}", ord=i, email="hot@x.com" if rnd.random() < 0.35 else rnd.choice(["", f"e{rnd.randrange(150)}@x.com"]),
            phone=rnd.choice(["", "5550000", str(1000000 + rnd.randrange(200))]), total=rnd.randrange(5)))
    for lead in leads:
        lead["website"] = rnd.choice(["", f"firm{rnd.randrange(40)}.com"])
    df = spark.createDataFrame(leads).select(
        "ord", "place_id", "email", "phone", F.when(F.col("website") != "", F.concat(F.lit("https://www."), "website", F.lit("/x"))).otherwise("").alias("website"),
        F.regexp_replace("website", "[.]com", "").alias("name"), F.struct("total").alias("score"))
    found = dedupe.find_duplicates(df.repartition(5), rows_per_task=20)
    assert sorted((r.shared_by, r.value, r.size, r.place_id) for r in found.collect()) == brute(leads)
    kept = {r.place_id for r in dedupe.drop_duplicates_anti(df, found).collect()}
    groups = {}
    for name, value, _, pid in brute(leads):
        groups.setdefault((name, value), []).append(leads[int(pid[1:])])
    losers = set()
    for members in groups.values():
        best = max(members, key=lambda m: (m["total"], -m["ord"]))
        losers |= {m["place_id"] for m in members} - {best["place_id"]}
    assert kept == {lead["place_id"] for lead in leads} - losers


def test_cap_counts_distinct_ids_before_any_filter(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "c"), (2, 3, "a"), (3, 1, "d")]
    b = spark.createDataFrame(rows, "batch int, pos int, place_id string")
    assert [r.place_id for r in dedupe.result_cap(b, 3).orderBy("batch", "pos").collect()] == ["a", "b", "c"]
    assert dedupe.cap_reached(b, 3).collect()[0].result_cap_reached is True
    assert dedupe.cap_reached(b, 5).collect()[0].result_cap_reached is False
    assert dedupe.duplicates_dropped(b).collect()[0].duplicates_dropped == 2
