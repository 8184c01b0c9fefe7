"""Listings and audits into scored leads, and the totals over them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import derive, fixed as V
from ..functions.derive import blank, has_signal
from ..functions.keys import lead_host


def with_signals(facts: DataFrame) -> DataFrame:
    return facts.withColumn("signals", derive.signals())


def with_score(leads: DataFrame) -> DataFrame:
    return leads.withColumn("score", derive.score())


def with_derived(facts: DataFrame) -> DataFrame:
    """Signals first, then the score that reads them."""
    return with_score(with_signals(facts))


def join_place_audit(places: DataFrame, audits: DataFrame) -> DataFrame:
    """Every place once, with its audit where one exists."""
    return places.join(audits.withColumn("has_audit", F.lit(True)), "place_id", "left")


def to_lead(places: DataFrame, audits: DataFrame) -> DataFrame:
    """Lead facts with their defaults; `audited` means an audit exists."""
    site = F.coalesce("website", F.lit(""))
    emails = F.coalesce("emails", F.array().cast("array<string>"))

    def text(name, default=""):
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    audit_columns = {"emails", "reachable", "https", "ttfb_ms", "viewport", "contact_form",
                     "final_url", "audit_error", "has_audit"}
    known = {"name", "address", "phone", "website", "business_status", "primary_type"}
    kept = [c for c in places.columns if c not in known | audit_columns]
    return join_place_audit(places, audits).select(
        *kept,
        text("name", "(unnamed)"),
        text("address"),
        text("phone"),
        site.alias("website"),
        lead_host(F.col("website")).alias("host"),
        F.coalesce(F.try_element_at(emails, F.lit(1)), F.lit("")).alias("email"),
        F.slice(emails, 2, F.greatest(F.size(emails), F.lit(1))).alias("email_alt"),
        text("business_status"),
        text("primary_type"),
        text("reachable", "unknown"),
        text("https", "unknown"),
        "ttfb_ms",
        text("viewport", "unknown"),
        text("contact_form", "unknown"),
        text("final_url"),
        text("audit_error"),
        F.coalesce("has_audit", F.lit(False)).alias("audited"),
    )


def summarise(leads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The run totals, overall or per group."""

    def hits(name):
        return F.count_if(has_signal(name))

    avg = F.avg("rating")
    return leads.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("prospects"),
        F.count_if(~blank("email")).alias("with_email"),
        F.count_if(blank("website")).alias("no_site"),
        hits("down").alias("down"),
        hits("insecure").alias("insecure"),
        hits("no-viewport").alias("no_viewport"),
        hits("slow").alias("slow"),
        hits("no-contact-form").alias("no_contact_form"),
        hits("low-rating").alias("low_rating"),
        hits("thin-reviews").alias("thin_reviews"),
        F.count_if(F.col("contact_form") == "yes").alias("contact_form"),
        F.count_if(~blank("phone")).alias("with_phone"),
        F.count_if(F.size("signals") == 0).alias("clean"),
        F.when(avg.isNotNull(), F.format_string("%.2f", F.round(avg, 2))).otherwise("—").alias("avg_rating"),
    )


def band_counts(leads: DataFrame) -> DataFrame:
    """Leads per band and how many of them can be e-mailed."""
    return leads.groupBy(F.col("score.band").alias("band")).agg(
        F.count(F.lit(1)).alias("leads"), F.count_if(~blank("email")).alias("emailable")
    )


def rank_leads(leads: DataFrame, n: int = 20) -> DataFrame:
    """The n leads to work first; equal scores keep their input order."""
    return leads.orderBy(F.desc("score.total"), "ord").limit(n)


def run_cost(runs: DataFrame, by: list[str]) -> DataFrame:
    """Calls and their estimated price."""
    calls = F.sum("calls_used")
    return runs.groupBy(*by).agg(
        calls.alias("calls_used"),
        (calls * V.USD_PER_1000_CALLS / F.lit(1000)).alias("estimated_cost_usd"),
    )


def audit_summary(audits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What a pass over the sites found; medians are the upper median."""
    n = F.count(F.lit(1))
    with_email = F.count_if(F.size("emails") > 0)
    return audits.groupBy(*(by or [])).agg(
        n.alias("sites"),
        with_email.alias("with_email"),
        F.round(with_email * 100 / n, 0).cast("int").alias("with_email_pct"),
        F.count_if(F.col("reachable") == "yes").alias("reachable"),
        F.count_if(F.col("reachable") == "no").alias("unreachable"),
        F.count_if("robots_blocked").alias("robots_blocked"),
        F.count_if(F.col("https") == "yes").alias("https_yes"),
        F.count_if(F.col("https") == "no").alias("https_no"),
        F.count_if(F.col("viewport") == "no").alias("no_viewport"),
        F.count_if(F.col("contact_form") == "yes").alias("contact_form"),
        upper_median("ttfb_ms").alias("median_ttfb_ms"),
        F.max("ttfb_ms").alias("slowest_ms"),
    )


def upper_median(name: str, where=None):
    """sorted[floor(n/2)]: the middle value, the upper one of two.

    The aggregate keeps one counter per distinct millisecond, so its state is
    bounded by the request time-out and partial results merge before the shuffle.
    """
    filtered = f" FILTER (WHERE {where})" if where else ""
    return F.expr(
        f"CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC){filtered} AS INT)"
    )
