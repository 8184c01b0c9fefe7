"""The working table: outgoing rows, upsert, hand edits, runs, pages."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.clock import check_date
from ..functions.derive import blank, finite
from ..functions.keys import lead_host
from ..sources.snapshots import Snapshot
from ..sources.stage import staged
from .leads import with_score
from .market import hook

RUN_BUCKETS = 16
#: A table is kept in at most RANGES ranges until each has ROWS_PER_RANGE rows.
RANGES = 256
ROWS_PER_RANGE = 100_000
# first_listed and the people's columns are written once and never overwritten.
MACHINE_COLUMNS = [
    c for c in V.STORED_COLUMNS if c not in ["place_id", "first_listed", *V.PEOPLE_COLUMNS]
]


def project_sheet(leads: DataFrame, niche: Column, location: Column, refreshed_at: Column) -> DataFrame:
    """Scored leads plus their run's context as outgoing rows."""
    h = F.col("_hook")
    return leads.withColumn("_hook", hook(niche, check_date(refreshed_at))).select(
        "ord", "place_id", "name", "address", "phone", "email",
        F.array_join("email_alt", " ").alias("email_alt"),
        "website", "rating", "reviews",
        F.array_join("signals", " ").alias("signals"),
        "reachable", "https", "ttfb_ms",
        F.col("viewport").alias("mobile_viewport"),
        "contact_form", "business_status", "primary_type",
        F.col("lat").alias("latitude"),
        F.col("lng").alias("longitude"),
        "final_url", "audit_error",
        niche.alias("niche"),
        location.alias("search_location"),
        refreshed_at.alias("google_refreshed_at"),
        h["text"].alias("hook"),
        F.when(h["text"] != "", h["basis"]).otherwise(F.coalesce(h["reason"], F.lit("none"))).alias("hook_basis"),
        F.col("score.total").alias("score"),
        F.col("score.band").alias("score_band"),
        F.array_join("score.reasons", "; ").alias("score_why"),
    )


def _keyed(incoming: DataFrame) -> DataFrame:
    return incoming.filter(~blank("place_id"))


def upsert_leads(
    stored: DataFrame, incoming: DataFrame, now: Column, generation: int | None = None
) -> DataFrame:
    """The new snapshot of the working table.

    Incoming rows replace the machine columns of their id and leave the rest; an
    unknown id becomes a new row. The last row of an id in the batch wins: picked
    with a rank limit that runs before the shuffle too. Both sides then hold one
    row per id, so the full join has no hot key. `ord` keeps the table's order:
    new rows follow the existing ones in batch order. With `generation`, new rows are
    of that one and the others keep theirs, so that several batches stay in order.
    """
    last = Window.partitionBy("place_id").orderBy(F.desc("ord"))
    # Read twice below; deriving it once also keeps the plan short.
    batch = staged(_keyed(incoming), "upsert-batch")
    newest = batch.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    arrival = batch.groupBy("place_id").agg(F.min("ord").alias("arrival"))
    newest = newest.drop("ord").join(arrival, "place_id")
    fresh = newest.withColumn("last_seen", now).select(
        "place_id", "arrival", F.struct(*MACHINE_COLUMNS).alias("new")
    )
    old = stored.select("place_id", F.struct("ord", *stored.drop("ord").columns).alias("old"))
    both = old.join(fresh, "place_id", "full_outer")
    is_new, touched = F.col("old").isNull(), F.col("new").isNotNull()

    def column(name):
        if name == "place_id":
            return F.col("place_id")
        if name == "first_listed":
            return F.when(is_new, now).otherwise(F.col("old.first_listed")).alias(name)
        if name == "review_status":
            return F.when(is_new, F.lit("unreviewed")).otherwise(F.col(f"old.{name}")).alias(name)
        if name == "notes":
            return F.when(is_new, F.lit("")).otherwise(F.col(f"old.{name}")).alias(name)
        return F.when(touched, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return both.select(
        F.when(is_new, F.lit(1 if generation is None else generation))
        .otherwise(F.lit(0) if generation is None else F.col("old.generation"))
        .alias("generation"),
        F.coalesce("old.ord", "arrival").alias("ord"),
        *[column(c) for c in V.STORED_COLUMNS],
    )


def upsert_counts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """inserted, updated, total. Every incoming row of a known id is an update."""
    per_id = _keyed(incoming).groupBy("place_id").agg(F.count(F.lit(1)).alias("rows"))
    known = stored.select("place_id", F.lit(True).alias("known"))
    both = known.join(per_id, "place_id", "full_outer")
    old, came = F.coalesce("known", F.lit(False)), F.col("rows").isNotNull()
    return both.agg(
        F.count_if(~old & came).alias("inserted"),
        F.coalesce(F.sum(F.when(old & came, F.col("rows"))), F.lit(0)).alias("updated"),
        F.count(F.lit(1)).alias("total"),
    )


def working_table(spark: SparkSession, folder: str, buckets: int = 256) -> Snapshot:
    """The working table kept at `folder`, in buckets by place_id."""
    return Snapshot(spark, folder, "place_id", buckets)


def upsert_table(table: Snapshot, incoming: DataFrame, now: Column, batch: str) -> DataFrame:
    """Merge a batch into the working table; inserted, updated and total, in one row.

    Only the buckets that the batch falls into are read, joined and written again. A batch
    name that was merged before changes nothing, so a run that is not sure may repeat it;
    then the counts are 0 and 0.
    """
    spark = table.spark
    rows = staged(_keyed(incoming), "upsert-rows")
    version = table.version()
    if batch in version["batches"]:
        return spark.createDataFrame([(0, 0, table.rows())], "inserted long, updated long, total long")
    touched = table.buckets_of(rows)
    held = table.read(touched)
    if held is None:
        none = [F.lit(None).cast("string").alias(c) if c not in rows.columns else F.col(c) for c in V.STORED_COLUMNS]
        held = rows.limit(0).select(F.lit(0).alias("generation"), "ord", *none)
    counts = staged(upsert_counts(held, rows), "upsert-counts")
    if touched:
        table.commit(upsert_leads(held, rows, now, version["number"] + 1), touched, batch)
    others = table.rows(touched)
    return counts.withColumn("total", F.col("total") + others)


def patch_table(table: Snapshot, patches: DataFrame, batch: str) -> DataFrame:
    """Apply hand edits to the working table, all or none; the log of what was changed.

    A batch is small by contract, so it touches few buckets, and no other is written.
    """
    asked = patches.limit(V.MAX_PATCHES + 1)
    touched = table.buckets_of(asked.select("place_id"))
    held = table.read(touched)
    log = staged(patch_log(held, asked), "patch-log")
    if not log.isEmpty():
        table.commit(patch_cells(held, asked), touched, batch)
    return log


# ---------------------------------------------------------------- patches


def patch_violations(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """Every reason the batch must be refused; empty when it may be applied.

    `patches` has ord, place_id, column, value. The batch is small by contract:
    beyond MAX_PATCHES rows it is refused as a whole.
    """
    size = patches.agg(F.count(F.lit(1)).alias("n"))
    wrong_size = size.filter((F.col("n") == 0) | (F.col("n") > V.MAX_PATCHES)).select(
        F.lit(None).cast("long").alias("ord"),
        F.when(F.col("n") == 0, F.lit("no patches supplied"))
        .otherwise(F.lit(f"too many patches in one call (max {V.MAX_PATCHES})"))
        .alias("error"),
    )
    bad_cell = patches.select(
        F.col("ord").cast("long").alias("ord"),
        F.when(blank("place_id"), F.lit("no place_id"))
        .when(~F.coalesce(F.col("column").isin(V.PATCHABLE_COLUMNS), F.lit(False)), F.lit("column is not patchable"))
        .alias("error"),
    ).filter("error IS NOT NULL")
    # Small enough to look up: the ids of an oversized batch are not.
    small = patches.filter(size.scalar() <= V.MAX_PATCHES).limit(V.MAX_PATCHES)
    asked = F.broadcast(small.select("place_id").distinct())
    known = F.broadcast(stored.select("place_id").join(asked, "place_id", "left_semi"))
    unknown = small.filter(~blank("place_id")).join(known, "place_id", "left_anti").select(
        F.col("ord").cast("long").alias("ord"), F.lit("no lead with this place_id").alias("error")
    )
    return wrong_size.unionByName(bad_cell).unionByName(unknown)


def _accepted(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """The batch when it passes as a whole, else no rows at all."""
    faults = patch_violations(stored, patches).agg(F.count(F.lit(1)))
    return patches.filter(faults.scalar() == 0).limit(V.MAX_PATCHES)


def _before(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """Accepted patches with the value their cell holds when its turn comes."""
    cells = F.create_map(
        *[x for c in V.PATCHABLE_COLUMNS for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    )
    asked = F.broadcast(_accepted(stored, patches))
    held = asked.join(stored.select("place_id", cells.alias("cells")), "place_id")
    turn = Window.partitionBy("place_id", "column").orderBy("ord")
    value = F.coalesce("value", F.lit(""))
    return held.select(
        "ord", "place_id", "column",
        F.coalesce(F.lag(value).over(turn), F.element_at("cells", F.col("column"))).alias("before"),
        value.alias("after"),
    )


def patch_log(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """before / after / changed per patch; a later patch sees the earlier ones."""
    return _before(stored, patches).withColumn("changed", F.col("before") != F.col("after"))


def patch_cells(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """The working table with the batch applied, or as it was if any patch is bad."""
    edits = (
        _accepted(stored, patches)
        .groupBy("place_id", "column")
        .agg(F.max_by(F.coalesce("value", F.lit("")), "ord").alias("value"))
        .groupBy("place_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("edits"))
    )
    edited = stored.join(F.broadcast(edits), "place_id", "left")

    def cell(name):
        if name not in V.PATCHABLE_COLUMNS:
            return F.col(name)
        return F.coalesce(F.try_element_at("edits", F.lit(name)), F.col(name)).alias(name)

    return edited.select(*[cell(c) for c in stored.columns])


# ---------------------------------------------------------------- reading back


def scan_stored(rows: DataFrame) -> DataFrame:
    """Text rows of the working table, bound by name, as leads.

    A missing column reads as blank, a row without a key is dropped, signals are
    taken as they stand and the score is computed anew.
    """
    have = set(rows.columns)

    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in have else F.lit("")

    def number(name, kind="double"):
        return finite(text(name), kind).alias(name)

    def words(name):
        return F.filter(F.split(text(name), r"\s+"), lambda w: w != "")

    leads = rows.select(
        *(["ord"] if "ord" in have else []),
        text("place_id").alias("place_id"),
        *[text(c).alias(c) for c in ("name", "address", "phone", "website", "email")],
        lead_host(text("website")).alias("host"),
        words("email_alt").alias("email_alt"),
        number("rating"),
        number("reviews", "int"),
        *[text(c).alias(c) for c in ("business_status", "primary_type")],
        number("latitude").alias("lat"),
        number("longitude").alias("lng"),
        text("reachable").alias("reachable"),
        text("https").alias("https"),
        number("ttfb_ms", "int"),
        text("mobile_viewport").alias("viewport"),
        *[text(c).alias(c) for c in ("contact_form", "final_url", "audit_error")],
        words("signals").alias("signals"),
        (text("reachable") != "").alias("audited"),
        text("first_listed").alias("collected_at"),
        *[text(c).alias(c) for c in ("last_seen", "review_status", "notes", "hook", "hook_basis")],
    )
    return with_score(leads.filter(F.col("place_id") != ""))


def _page(limit: float | None, offset: float | None) -> tuple[int, int]:
    return int(max(1, min(1000, limit or 500))), int(max(0, offset or 0))


def newest_first() -> list[Column]:
    return [F.desc("generation"), F.desc("ord"), F.desc("place_id")]


def page_newest(stored: DataFrame, limit: float | None = None, offset: float | None = None) -> DataFrame:
    """One page of the working table, newest rows first; 1..1000 rows, 500 by default."""
    size, skip = _page(limit, offset)
    return stored.orderBy(*newest_first()).offset(skip).limit(size)


def page_after(stored: DataFrame, last: tuple | None = None, limit: float | None = None) -> DataFrame:
    """The page behind a row (generation, ord, place_id), or the first one.

    The rows before it are filtered by their key, which reaches the scan, and only as many
    as a page holds are kept per task.
    """
    rows = stored
    if last is not None:
        generation, order, place = last
        same = F.col("generation") == generation
        older = (F.col("ord") < order) | ((F.col("ord") == order) & (F.col("place_id") < place))
        rows = stored.filter((F.col("generation") < generation) | (same & older))
    return rows.orderBy(*newest_first()).limit(_page(limit, None)[0])


def write_pages(stored: DataFrame, folder: str, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Write the table in ranges of its reading order, with a row per range: its first place and its rows.

    A range is a task and a file, so ranges of few rows are for small tables: those of
    larger ones grow up to ROWS_PER_RANGE rows.
    """
    spark = stored.sparkSession
    # Read three times below: counted, sampled for the bounds, and cut.
    table = staged(stored, "pages-table")
    rows = table.count()
    size = max(rows_per_range, min(ROWS_PER_RANGE, -(-rows // RANGES)))
    ranges = max(1, -(-rows // size))
    cut = table.repartitionByRange(ranges, *newest_first()).withColumn("_range", F.spark_partition_id())
    cut.sortWithinPartitions("_range", *newest_first()).write.partitionBy("_range").parquet(f"{folder}/rows")
    counts = spark.read.parquet(f"{folder}/rows").groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts.coalesce(1).write.parquet(f"{folder}/ranges")


def read_page(spark: SparkSession, folder: str, limit: float | None = None, offset: float | None = None) -> DataFrame:
    """The same page as `page_newest`, read from the ranges that hold it and no others."""
    size, skip = _page(limit, offset)
    ranges = spark.read.parquet(f"{folder}/ranges")
    # at most one range per row of the page
    hit = ranges.filter((F.col("start") < skip + size) & (F.col("start") + F.col("n") > skip)).orderBy("start").collect()
    if not hit:
        return spark.read.parquet(f"{folder}/rows").drop("_range").limit(0)
    rows = spark.read.parquet(*[f"{folder}/rows/_range={r['_range']}" for r in hit])
    return rows.orderBy(*newest_first()).offset(skip - hit[0]["start"]).limit(size)


def run_rows(runs: DataFrame) -> DataFrame:
    """Run facts as ledger rows."""

    def flag(name):
        return F.when(F.coalesce(name, F.lit(False)), F.lit("yes")).otherwise(F.lit("no")).alias(name)

    terms = F.array_join("terms", " ").alias("terms")
    special = {"terms": terms, "halted": flag("halted"), "aborted": flag("aborted")}
    return runs.select(*[special.get(c, F.col(c)) for c in V.RUN_COLUMNS])


def append_run(runs: DataFrame, path: str, batch: str) -> DataFrame:
    """Append run rows to the ledger at `path` and return the whole ledger.

    `batch` names the append: one that was written before adds nothing, and of two writers
    at a time one must start again.
    """
    ledger = Snapshot(runs.sparkSession, path, "file", RUN_BUCKETS)
    rows = staged(run_rows(runs), "run-rows")
    touched = ledger.buckets_of(rows)
    held = ledger.read(touched)
    ledger.commit(rows if held is None else held.unionByName(rows), touched, batch)
    return ledger.read()
