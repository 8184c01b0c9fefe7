"""First/last occurrence per id, the result cap, and shared contact routes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.derive import blank
from ..functions.keys import host_key, owns_domain, phone_key
from ..sources.stage import staged
from .skew import ROWS_PER_TASK, join_by_key


def _first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key. The rank filter is applied before the shuffle as well, so
    a key with very many copies sends one row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedupe_first(batches: DataFrame, key: str = "place_id") -> DataFrame:
    """First occurrence in (batch, pos) order wins."""
    return _first_per(batches, [key], F.asc("batch"), F.asc("pos"))


def duplicates_dropped(batches: DataFrame, key: str = "place_id") -> DataFrame:
    per_id = batches.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.count(F.lit(1)).alias("unique_rows"),
        F.sum(F.col("n") - 1).alias("duplicates_dropped"),
    )


def dedupe_latest(rows: DataFrame, key: str = "place_id") -> DataFrame:
    """Later file wins, then the later row of it."""
    return _first_per(rows, [key], F.desc("file"), F.desc("ord"))


def result_cap(batches: DataFrame, max_results: int = 100, key: str = "place_id") -> DataFrame:
    """The first `max_results` distinct ids in collection order.

    The cap is the feature: 1..5000, applied before any quality filter.
    """
    cap = max(1, min(5000, max_results))
    return dedupe_first(batches, key).orderBy("batch", "pos").limit(cap)


def cap_reached(batches: DataFrame, max_results: int = 100, key: str = "place_id") -> DataFrame:
    cap = max(1, min(5000, max_results))
    return batches.agg(
        F.least(F.count_distinct(key), F.lit(cap)).alias("collected"),
        (F.count_distinct(key) >= cap).alias("result_cap_reached"),
    )


def contact_keys(leads: DataFrame) -> DataFrame:
    """E-mail, phone and own-domain key of every lead; NULL where there is none.

    A host that is not the firm's own, such as a shared platform, gets no key, so
    the heaviest hosts never reach a shuffle.
    """
    host = host_key(F.col("website"))
    own = ~blank("website") & (host != "") & owns_domain(F.col("name"), host)
    return leads.select(
        "ord",
        "place_id",
        F.col("score.total").alias("total"),
        F.when(~blank("email"), F.lower("email")).alias("email_key"),
        phone_key(F.col("phone")).alias("phone_key"),
        F.when(own, host).alias("website_key"),
    )


def find_duplicates(leads: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Leads that reach the same contact, one row per member.

    E-mail groups come first, then phone groups among the leads left over, then
    own-domain groups among those. A group may be arbitrarily large, so it stays
    in rows: its size and its first member's `ord` are on every one of them.
    """
    unclaimed = F.col("shared_by").isNull()
    rows = contact_keys(leads).select(
        "*",
        F.lit(None).cast("string").alias("shared_by"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("long").alias("group_ord"),
        F.lit(None).cast("long").alias("size"),
    )
    for name in ("email", "phone", "website"):
        rows = staged(rows, f"contact-{name}")
        # Claimed leads and leads without this key get a key of their own, which
        # matches nothing and spreads evenly.
        alone = F.concat(F.lit("\u0000"), F.col("place_id"))
        free = unclaimed & F.col(f"{name}_key").isNotNull()
        keyed = rows.withColumn("_key", F.when(free, F.col(f"{name}_key")).otherwise(alone))
        groups = (
            keyed.filter(free)
            .groupBy("_key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
            .filter("n >= 2")
        )
        joined = join_by_key(
            keyed, groups, ["_key"], "place_id", counts=groups, rows_per_task=rows_per_task
        )
        claims = F.col("n").isNotNull()
        rows = joined.select(
            "ord", "place_id", "total", "email_key", "phone_key", "website_key",
            F.when(claims, F.lit(name)).otherwise(F.col("shared_by")).alias("shared_by"),
            F.when(claims, F.col("_key")).otherwise(F.col("value")).alias("value"),
            F.coalesce("first_ord", "group_ord").alias("group_ord"),
            F.coalesce("n", "size").alias("size"),
        )
    return rows.filter("shared_by IS NOT NULL").drop("email_key", "phone_key", "website_key")


def duplicate_savings(members: DataFrame) -> DataFrame:
    """Groups and the sends they save, from group members."""
    groups = members.groupBy("shared_by", "value").agg(F.count(F.lit(1)).alias("size"))
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("duplicate_sends"),
    )


def cluster_survivor(members: DataFrame) -> DataFrame:
    """The highest total of each group, the earlier lead on ties."""
    return _first_per(members, ["shared_by", "value"], F.desc("total"), F.asc("ord"))


def drop_duplicates_anti(leads: DataFrame, members: DataFrame) -> DataFrame:
    """The list as a campaign should send it: survivors and ungrouped leads."""
    survivors = cluster_survivor(members).select("place_id")
    losers = members.select("place_id").join(survivors, "place_id", "left_anti")
    return leads.join(losers, "place_id", "left_anti")
