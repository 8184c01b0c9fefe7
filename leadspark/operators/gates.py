"""Filters that name their reason, and the reports on what they removed."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.derive import blank, first_match


def drop_reason(
    min_rating: float | None = None,
    min_reviews: int | None = None,
    require_website: bool = False,
    keep_unrated: bool = False,
) -> Column:
    """First failing rule of the gate before the audit, or NULL."""
    none = F.lit(None).cast("string")
    rules = []
    if require_website:
        rules.append((blank("website"), F.lit("no website")))
    if min_rating is not None:
        if not keep_unrated:
            rules.append((F.col("rating").isNull(), F.lit("unrated")))
        rules.append((F.col("rating") < min_rating, F.lit("rating below minimum")))
    if min_reviews is not None:
        few = F.coalesce("reviews", F.lit(0)) < min_reviews
        rules.append((few, F.lit("too few reviews")))
    return first_match(rules, none) if rules else none


def filter_places(places: DataFrame, **rules) -> DataFrame:
    return places.filter(drop_reason(**rules).isNull())


def filter_leads(leads: DataFrame, require_email: bool = False) -> DataFrame:
    return leads.filter(~blank("email")) if require_email else leads


def drop_report(places: DataFrame, leads: DataFrame, require_email: bool = False, **rules) -> DataFrame:
    """Both gates in one report: per reason its count, beside considered and kept.

    `places` is what the first gate saw, `leads` what the second one saw. The
    row with a NULL reason carries the totals even when nothing was dropped.
    """
    before = places.groupBy(drop_reason(**rules).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )
    gone = F.lit("no email found") if require_email else F.lit(None).cast("string")
    after = leads.groupBy(F.when(blank("email"), gone).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )
    both = before.select("reason", "n", F.lit(0).alias("kept")).unionByName(
        after.select(
            "reason",
            F.when(F.col("reason").isNotNull(), F.col("n")).otherwise(0).alias("n"),
            F.when(F.col("reason").isNull(), F.col("n")).otherwise(0).alias("kept"),
        )
    )
    return (
        both.groupBy("reason")
        .agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
        .select(
            F.coalesce("reason", F.lit("(kept)")).alias("reason"),
            F.when(F.col("reason").isNull(), F.col("kept")).otherwise(F.col("n")).alias("count"),
        )
        .orderBy(F.desc("count"), "reason")
    )


def require_email_rows(rows: DataFrame) -> DataFrame:
    """Rows with an address, and the number withheld beside them."""
    return rows.groupBy().agg(
        F.count_if(~blank("email")).alias("written"), F.count_if(blank("email")).alias("withheld")
    )


def sendable_segment(rows: DataFrame) -> DataFrame:
    """Only rows with something measured to say."""
    return rows.filter(~blank("hook"))


def box_checks(boxes: DataFrame) -> DataFrame:
    """Adds `valid`, `too_small`, `wide_note` to boxes given by two corners."""
    corners = [F.col(c) for c in ("sw_lat", "sw_lng", "ne_lat", "ne_lng")]
    sw_lat, sw_lng, ne_lat, ne_lng = corners
    finite = reduce(
        lambda a, b: a & b,
        [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in corners],
    )
    valid = (
        finite
        & (sw_lat >= -90) & (ne_lat <= 90) & (sw_lng >= -180) & (ne_lng <= 180)
        & (sw_lat < ne_lat) & (sw_lng < ne_lng)
    )
    lat_span, lng_span = ne_lat - sw_lat, ne_lng - sw_lng
    small = (lat_span < V.MIN_SWEEP_SPAN_DEG) & (lng_span < V.MIN_SWEEP_SPAN_DEG)
    km = F.floor(lat_span * V.KM_PER_DEGREE + 0.5)
    return boxes.select(
        "*",
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.coalesce(valid & small, F.lit(False)).alias("too_small"),
        F.when(valid & (km > V.WIDE_BOX_KM), km.cast("int")).alias("wide_km"),
    )


def valid_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes that can be swept."""
    return box_checks(boxes).filter("valid AND NOT too_small").drop("valid", "too_small")


def _stale(now: Column, days: int) -> Column:
    old = F.try_to_timestamp("google_refreshed_at") < now - F.expr(f"INTERVAL {days} DAYS")
    return F.coalesce(old, F.lit(False))


def stale_list(stored: DataFrame, now: Column, days: int = V.STALE_AFTER_DAYS) -> DataFrame:
    """The rows whose cached listing is too old, with its age in whole days."""
    age = F.floor((F.unix_seconds(now) - F.unix_seconds(F.try_to_timestamp("google_refreshed_at"))) / 86400)
    return stored.filter(_stale(now, days)).withColumn("age_days", age)


def without_stale(stored: DataFrame, now: Column, days: int = V.STALE_AFTER_DAYS) -> DataFrame:
    """The rows whose cached listing may still be used; one without a readable time stays."""
    return stored.filter(~_stale(now, days))


def stale_fields(stored: DataFrame, now: Column, days: int = V.STALE_AFTER_DAYS) -> DataFrame:
    """Blank the cached listing columns of stale rows, keep everything derived."""
    stale = _stale(now, days)
    cached = ["name", "address", "phone", "rating", "reviews"]
    return stored.select(
        *[
            F.when(~stale, F.col(c)).alias(c) if c in cached else F.col(c)
            for c in stored.columns
        ],
        stale.alias("stale"),
    )


def disqualify(leads: DataFrame) -> DataFrame:
    """Adds `disqualified`: the first reason, or NULL. Rows are kept."""

    def named(words):
        name = F.lower(F.coalesce("name", F.lit("")))
        return reduce(lambda a, b: a | b, [F.contains(name, F.lit(w.lower())) for w in words])

    reason = first_match(
        [
            (F.coalesce("business_status", F.lit("")) != "OPERATIONAL", F.lit("not operational")),
            (named(V.BRANDS), F.lit("national brand")),
            (named(V.PORTALS), F.lit("software vendor or portal")),
            (blank("phone") & blank("website"), F.lit("no phone and no website")),
        ],
        F.lit(None).cast("string"),
    )
    return leads.withColumn("disqualified", reason)
