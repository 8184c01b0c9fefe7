"""Lead files: CSV in and out, run names, run metadata."""

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.derive import finite
from ..functions.keys import lead_host
from ..operators.leads import summarise, with_derived, with_score
from ..operators.skew import join_by_key
from .records import BOM, records
from .snapshots import renamed


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def harvest_rows(places: DataFrame, refreshed_at: Column) -> DataFrame:
    """The 12 harvest columns as text."""
    renamed = {"review_count": "reviews", "latitude": "lat", "longitude": "lng"}
    return places.select(
        *[
            refreshed_at.cast("string").alias(c)
            if c == "google_refreshed_at"
            else _text(renamed.get(c, c)).alias(c)
            for c in V.HARVEST_COLUMNS
        ]
    )


def enriched_rows(leads: DataFrame, refreshed_at: Column) -> DataFrame:
    """Harvest columns plus audit facts and the score, as text.

    Columns are taken by name, so the shape is the same whatever else `leads`
    carries.
    """
    renamed = {
        "review_count": "reviews", "latitude": "lat", "longitude": "lng", "mobile_viewport": "viewport",
    }

    def column(c):
        if c == "google_refreshed_at":
            return refreshed_at.cast("string").alias(c)
        if c == "email_alt":
            return F.when(_text("email") != "", F.array_join("email_alt", " ")).otherwise("").alias(c)
        if c == "score":
            return F.col("score.total").cast("string").alias(c)
        return _text(renamed.get(c, c)).alias(c)

    return leads.select(*[column(c) for c in V.ENRICHED_COLUMNS])


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quoted where needed, CRLF line ends, byte-order mark in front of each file."""
    first, *rest = rows.columns
    rows.withColumnRenamed(first, BOM + first).select(BOM + first, *rest).write.mode(mode).csv(
        path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_harvest(places: DataFrame, path: str, refreshed_at: Column) -> None:
    write_csv(harvest_rows(places, refreshed_at), path)


def write_enriched(leads: DataFrame, path: str, refreshed_at: Column) -> None:
    write_csv(enriched_rows(leads, refreshed_at), path)


def write_unique(rows: DataFrame, folder: str, base: str) -> str:
    """Write under the next free name, base, base-2, ... base-100; never overwrite.

    The rows are written under a hidden name first and then renamed, which fails where
    the name is taken, so of two writers each gets a name of its own.
    """
    spark = rows.sparkSession
    draft = f"{folder}/.{base}-{uuid4().hex}"
    write_csv(rows, draft)
    for n in range(1, 101):
        path = f"{folder}/{base}" + ("" if n == 1 else f"-{n}") + ".csv"
        if renamed(spark, draft, path):
            return path
    raise FileExistsError(f"no free name for {base} after 100 attempts; the rows are in {draft}")


def read_csv_text(spark: SparkSession, path: str, columns: list[str], parts: bool = False) -> DataFrame:
    """The files under `path` as text columns and `file`; with `parts` also part, block and seq.

    Those name the file and the place of a row in it. Columns are bound by the header of the
    row's own file; one that the header lacks reads as blank, one that is not asked for is
    ignored, and a file without a place_id column has no rows. Files are read in splits
    (`records`), whatever line breaks their cells hold; blank rows go.
    """
    found = records(spark, path)
    headers = found.filter("first").groupBy("file").agg(F.min_by("cells", F.struct("block", "seq")).alias("header"), F.min(F.struct("block", "seq")).alias("top"))
    headers = headers.filter(F.array_contains("header", "place_id"))
    rows = join_by_key(found.drop("first"), headers, ["file"], "seq").filter("header IS NOT NULL")
    rows = rows.filter((F.col("block") != F.col("top.block")) | (F.col("seq") != F.col("top.seq")))

    def cell(name):
        place = F.array_position("header", name).cast("int")
        value = F.try_element_at("cells", F.when(place > 0, place).otherwise(1))
        return F.when(place > 0, F.coalesce(value, F.lit(""))).otherwise("").alias(name)

    more = [F.col("file").alias("part"), "block", "seq"] if parts else []
    return rows.select(*[cell(c) for c in columns], run_file(F.col("file")).alias("file"), *more)


def run_file(path: Column) -> Column:
    """The run's .csv name in a path, whether it is a file or a folder of parts."""
    return F.regexp_extract(path, r"([^/]*?\.csv)(?:/part-[^/]*)?$", 1)


def leads_from_csv(rows: DataFrame) -> DataFrame:
    """Text rows of an enriched file as leads, signals and score computed anew."""

    def or_else(name, default):
        return F.when(F.col(name) == "", F.lit(default)).otherwise(F.col(name))

    kept = [c for c in rows.columns if c not in V.ENRICHED_COLUMNS]
    facts = rows.select(
        *kept,
        "place_id",
        or_else("name", "(unnamed)").alias("name"),
        "address", "phone", "website",
        lead_host(F.col("website")).alias("host"),
        "email",
        F.filter(F.split("email_alt", " "), lambda w: w != "").alias("email_alt"),
        finite(F.col("rating"), "double").alias("rating"),
        finite(F.col("review_count"), "int").alias("reviews"),
        "business_status", "primary_type",
        finite(F.col("latitude"), "double").alias("lat"),
        finite(F.col("longitude"), "double").alias("lng"),
        or_else("reachable", "unknown").alias("reachable"),
        or_else("https", "unknown").alias("https"),
        finite(F.col("ttfb_ms"), "int").alias("ttfb_ms"),
        or_else("mobile_viewport", "unknown").alias("viewport"),
        or_else("contact_form", "unknown").alias("contact_form"),
        "final_url", "audit_error",
        (
            ~F.col("reachable").isin("", "unknown") | (F.col("final_url") != "") | (F.col("email") != "")
        ).alias("audited"),
    )
    return with_derived(facts)


def scan_lead_csv(spark: SparkSession, path: str) -> DataFrame:
    return leads_from_csv(read_csv_text(spark, path, V.ENRICHED_COLUMNS))


def file_labels(files: DataFrame, name: str = "file") -> DataFrame:
    """When, location and niche in a run's file name; `refused` when unreadable."""
    base = F.regexp_replace(F.regexp_replace(F.col(name), r"(?i)\.(csv|json)$", ""), r"-\d+$", "")
    shape = r"^(\d{8})-(\d{6})_([^_]*)_(.*)$"
    known = base.rlike(shape)
    stamp = F.concat(F.regexp_extract(base, shape, 1), F.regexp_extract(base, shape, 2))

    def words(group):
        text = F.trim(F.regexp_replace(F.regexp_extract(base, shape, group), "-", " "))
        return F.when(known, text)

    return files.select(
        "*",
        F.when(known, F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))).alias("run_at"),
        words(3).alias("run_location"),
        words(4).alias("run_niche"),
        (~known).alias("refused"),
    )


def write_sidecar(runs: DataFrame, path: str) -> None:
    """Run facts, totals and filter report as JSON beside the lead files."""
    runs.write.mode("append").json(path)


def join_sidecar(files: DataFrame, sidecars: DataFrame, newest: int = 40) -> DataFrame:
    """Saved files, newest first, with metadata where it exists and the labels in
    the name where it does not. The listing shows 40 files."""
    labelled = file_labels(files.orderBy(F.desc("file")).limit(newest))
    return labelled.join(sidecars, "file", "left").select(
        "file",
        F.coalesce("location", "run_location", "file").alias("location"),
        F.coalesce("niche", "run_niche", F.lit("")).alias("niche"),
        F.coalesce(F.to_timestamp("finished_at"), "run_at").alias("finished_at"),
        "prospects",
        "calls_used",
        "estimated_cost_usd",
    )


def reopen_run(leads: DataFrame, file: str, sidecars: DataFrame) -> DataFrame:
    """One saved run's totals, recomputed, beside what was stored with it."""
    rows = leads.filter(F.col("file") == file)
    audited = rows.agg(F.coalesce(F.bool_or("audited"), F.lit(False)))
    facts = [c for c in sidecars.columns if c != "file"]
    stored = sidecars.filter(F.col("file") == file).agg(F.max(F.struct(*facts)))
    return (
        file_labels(summarise(rows).withColumn("file", F.lit(file)))
        .withColumn("any_audited", audited.scalar())
        .withColumn("_stored", stored.scalar())
        .select(
            "*",
            *[F.col(f"_stored.{c}").alias(c) for c in facts],
            F.col("_stored").isNull().alias("reopened_without_run"),
        )
        .drop("_stored")
    )
