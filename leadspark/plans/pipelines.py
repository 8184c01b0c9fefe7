"""Whole jobs: search, harvest summary, saved runs into the working table, letters."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..operators import contacts, dedupe, gates, ingest, leads as L, market, store
from ..operators.scan import running_total
from ..sources import files
from ..sources.stage import staged


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Per-phrase results one after another, repeats included."""
    return reduce(DataFrame.unionByName, batches)


def search(
    batches: DataFrame,
    places: DataFrame,
    audits: DataFrame,
    max_results: int = 100,
    require_email: bool = False,
    **rules,
) -> DataFrame:
    """Collected batches into scored leads: first occurrence, cap, gate before the
    audit, audit, signals and score, gate after it."""
    capped = dedupe.result_cap(batches, max_results).select("place_id", "batch", "pos")
    collected = places.join(F.broadcast(capped), "place_id")
    leads = L.with_derived(L.to_lead(gates.filter_places(collected, **rules), audits))
    return gates.filter_leads(leads, require_email)


def harvest_summary(
    batches: DataFrame, api_pages: DataFrame, max_results: int = 100, **rules
) -> DataFrame:
    """The totals of a harvest in one row."""
    kept = gates.filter_places(dedupe.result_cap(batches, max_results), **rules)
    totals = kept.agg(
        F.count(F.lit(1)).alias("prospects"),
        F.count("website").alias("with_website"),
        F.count("phone").alias("with_phone"),
    )
    dropped = dedupe.duplicates_dropped(batches)
    reached = dedupe.cap_reached(batches, max_results)
    rejected = ingest.rejected_places(api_pages).agg(F.count(F.lit(1)))
    return totals.select(
        "*",
        dropped.select("unique_rows").scalar().alias("unique_found"),
        dropped.select("duplicates_dropped").scalar().alias("duplicates_dropped"),
        rejected.scalar().alias("malformed_records"),
        reached.select("result_cap_reached").scalar().alias("partial"),
    )


def push_saved_runs(
    spark: SparkSession, path: str, stored: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Saved runs into the working table: (new snapshot, refused files).

    Older runs come first in the batch, then files by name, then part files, and rows of
    a file keep their order, so an id seen by several runs ends with the latest reading.
    Files whose name carries no date, place and niche are refused as a whole.
    """
    text = files.file_labels(files.read_csv_text(spark, path, V.ENRICHED_COLUMNS, parts=True))
    refreshed = F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    place = ["run_at", "file", "part", "block", "seq"]
    kept = text.filter("NOT refused AND place_id <> ''").withColumn("one", F.lit(1).cast("long"))
    placed = running_total(kept, place, "one", "place")
    ordered = placed.withColumn("ord", F.unix_seconds("run_at") * (1 << 31) + F.col("place"))
    accepted = staged(ordered.drop("one", "place", "part", "block", "seq"), "saved-rows")
    leads = staged(files.leads_from_csv(accepted), "saved-leads")
    outgoing = store.project_sheet(leads, F.col("run_niche"), F.col("run_location"), refreshed)
    refused = text.filter("refused").select("file").distinct()
    return store.upsert_leads(stored, outgoing, now), refused


def letters(leads: DataFrame, slots: dict | None = None) -> DataFrame:
    """Leads into ordered letters, each compared with its own market."""
    hooked = market.with_hook(L.with_derived(leads))
    compared = market.with_benchmark(market.join_corpus(hooked))
    return market.letters_ordered(market.letters(compared, slots))


def verify_contacts(leads: DataFrame, probes: DataFrame, mx_results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and the one-row report."""
    checks = contacts.contact_checks(leads, probes, mx_results)
    return checks.filter("kind IS NOT NULL"), contacts.contact_report(checks)


def rank(saved: DataFrame, n: int = 20) -> DataFrame:
    """Latest reading per lead over all saved runs, best first."""
    return L.rank_leads(dedupe.dedupe_latest(saved), n)
