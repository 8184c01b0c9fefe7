"""One runnable query per operator over the benchmark tables."""

from pyspark.sql import functions as F

from ..functions import clock, derive, fixed as V, html as H, keys as K, wording as W
from ..operators import audit, contacts, dedupe, gates, ingest, ledger, market, store, tiles
from ..operators import leads as L
from ..plans import pipelines
from ..sources import files
from ..sources.snapshots import Snapshot
from ..sources.stage import fresh_path, staged
from ..streaming.budget import budget_stream as stream_budget
from .tables import MAX_CALLS, NOW, ROOT, Tables

QUERIES = {}
GATE = dict(min_rating=3.0, min_reviews=10, require_website=True)


def query(fn):
    QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
    return fn


def joined(name, sep=" "):
    return F.array_join(name, sep).alias(name)


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# ---------------------------------------------------------------- scans


@query
def ingest_places(t):
    return ingest.ingest_places(t.api_pages).select(
        "term", "tile_key", "page_no", F.col("id").alias("place_id"),
        F.col("displayName.text").alias("name"), F.col("formattedAddress").alias("address"),
        F.col("nationalPhoneNumber").alias("phone"), F.col("websiteUri").alias("website"),
        "rating", F.col("userRatingCount").alias("reviews"),
        F.col("businessStatus").alias("business_status"), F.col("primaryType").alias("primary_type"),
        F.col("location.latitude").alias("lat"), F.col("location.longitude").alias("lng"),
    )


@query
def ingest_rejected(t):
    return ingest.rejected_places(t.api_pages).select("term", "tile_key", "page_no", "pos", "error")


@query
def tile_completeness(t):
    return ingest.tile_completeness(t.planned_tiles, t.gapped_pages)


@query
def scan_lead_csv(t):
    path = fresh_path(t.spark, "enriched")
    files.write_enriched(t.derived, f"{path}/20260801-142726_town_dentist.csv", F.col("checked_at"))
    leads = files.scan_lead_csv(t.spark, f"{path}/20260801-142726_town_dentist.csv")
    return leads.select(
        "place_id", "name", "address", "phone", "website", "host", "email", joined("email_alt"),
        "rating", "reviews", "lat", "lng", "reachable", "ttfb_ms", "final_url", "audit_error",
        "audited", joined("signals"), F.col("score.total").alias("total"), "file",
    )


@query
def file_labels(t):
    return files.file_labels(t.view("leads").select("ord", F.col("run_file").alias("file"))).select(
        "ord", "file", stamp("run_at"), "run_location", "run_niche", "refused"
    )


@query
def file_labels_refused(t):
    """Names that carry no date, location and niche are refused, not defaulted."""
    named = t.view("documents").select("doc_id", F.concat("source", F.lit("_"), "lang", F.lit(".csv")).alias("file"))
    labels = files.file_labels(named)
    return labels.groupBy("refused").agg(F.count(F.lit(1)).alias("files"), F.count("run_niche").alias("labelled"))


def _stored(t, leads=None):
    """Leads as the working table holds them, with people's columns filled."""
    rows = store.project_sheet(t.derived if leads is None else leads, F.col("niche"), F.col("market"), F.col("checked_at"))
    human = {
        "first_listed": F.lit("2026-07-01 00:00:00"),
        "last_seen": F.lit("2026-07-15 00:00:00"),
        "review_status": F.when(F.col("ord") % 4 == 0, F.lit("contacted")).otherwise(F.lit("unreviewed")),
        "notes": F.when(F.col("ord") % 6 == 0, F.lit("call back, after 5")).otherwise(F.lit("")),
    }
    return rows.withColumns(human).select("ord", F.lit(0).alias("generation"), *V.STORED_COLUMNS)


def _before(t):
    """The table before the batch: every other lead, so that the batch updates and inserts."""
    return _stored(t, t.derived.filter("ord % 2 = 0"))


def _batch(t):
    """Every third lead with fresher readings, every ninth one twice."""
    third = L.with_derived(t.leads.filter("ord % 3 = 0").withColumn("reviews", F.col("reviews") + 1))
    rows = store.project_sheet(third, F.col("niche"), F.col("market"), F.lit("2026-08-20T08:00:00Z"))
    again = rows.filter("ord % 9 = 0").withColumns(
        {"ord": F.col("ord") + 1_000_000_000, "phone": F.lit("(215) 555-0199")}
    )
    return rows.unionByName(again)


@query
def scan_stored(t):
    text = _stored(t).select("ord", *[F.col(c).cast("string").alias(c) for c in V.STORED_COLUMNS if c != "https"])
    return store.scan_stored(text).select(
        "ord", "place_id", "host", "rating", "reviews", "ttfb_ms", "https", "audited", joined("email_alt"),
        joined("signals"), "collected_at", "review_status", "notes", "hook_basis",
        F.col("score.total").alias("total"), F.col("score.band").alias("band"),
    )


@query
def scan_page_captures(t):
    return audit.scan_page_captures(t.view("page_captures")).select(
        "place_id", "role", "http_status", F.col("html").alias("body")
    )


@query
def scan_mx(t):
    return contacts.scan_mx(t.view("mx_results"))


@query
def term_expand(t):
    niches = t.view("leads").groupBy("niche").agg(F.count(F.lit(1)).alias("leads"))
    return ingest.term_expand(niches)


@query
def term_expand_first(t):
    niches = t.view("leads").groupBy("niche").agg(F.count(F.lit(1)).alias("leads"))
    return ingest.term_expand(niches, 2)


@query
def dims_signal_labels(t):
    """Leads per signal beside the label of the signal."""
    labels = F.broadcast(t.spark.createDataFrame(V.SIGNAL_LABELS, "signal string, label string, severity string"))
    raised = t.derived.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("leads"))
    return raised.join(labels, "signal")


@query
def dims_niches(t):
    """Suggested niches with the leads that name one of them."""
    dim = F.broadcast(t.spark.createDataFrame(V.NICHE_SUGGESTIONS, "suggestion string, featured boolean"))
    named = t.view("leads").groupBy(W.spaced(F.col("niche")).alias("suggestion")).agg(F.count(F.lit(1)).alias("leads"))
    return dim.join(named, "suggestion", "left").select("suggestion", "featured", F.coalesce("leads", F.lit(0)).alias("leads"))


@query
def dims_markets(t):
    """Curated markets with the leads of their niche inside their box."""
    dim = t.spark.createDataFrame(V.CURATED_MARKETS, "niche string, market string, label string, sw_lat double, sw_lng double, ne_lat double, ne_lng double")
    inside = F.col("lat").between(F.col("sw_lat"), F.col("ne_lat")) & F.col("lng").between(F.col("sw_lng"), F.col("ne_lng"))
    points = t.view("leads").select("lat", "lng", F.col("niche").alias("lead_niche"))
    return (
        points.join(F.broadcast(dim), inside & (F.col("lead_niche") == F.col("niche")))
        .groupBy("market", "label").agg(F.count(F.lit(1)).alias("leads"))
    )


@query
def dims_locations(t):
    """Starting locations with the leads whose address names them."""
    dim = F.broadcast(t.spark.createDataFrame(V.LOCATION_SEEDS, "place string, region string"))
    names = F.array(*[F.lit(place) for place, _ in V.LOCATION_SEEDS])
    named = t.view("leads").select(
        F.explode(F.filter(names, lambda place: F.contains(F.col("address"), place))).alias("place")
    )
    counts = named.groupBy("place").agg(F.count(F.lit(1)).alias("leads"))
    return counts.join(dim, "place")


# ---------------------------------------------------------------- sinks


@query
def write_harvest(t):
    path = fresh_path(t.spark, "harvest")
    files.write_harvest(t.view("places"), f"{path}/20260801-142726_town_gym.csv", F.lit("2026-08-01T14:27:26.000Z"))
    return files.read_csv_text(t.spark, f"{path}/20260801-142726_town_gym.csv", V.HARVEST_COLUMNS).withColumns(
        {c: F.col(c).try_cast("double") for c in ("rating", "latitude", "longitude")}
    )


@query
def write_enriched(t):
    path = fresh_path(t.spark, "enriched")
    files.write_enriched(t.derived, f"{path}/20260801-142726_town_gym.csv", F.col("checked_at"))
    return files.read_csv_text(t.spark, f"{path}/20260801-142726_town_gym.csv", V.ENRICHED_COLUMNS).withColumns(
        {c: F.col(c).try_cast("double") for c in ("rating", "latitude", "longitude")}
    ).drop("file")


@query
def project_sheet(t):
    return store.project_sheet(t.derived, F.col("niche"), F.col("market"), F.col("checked_at"))


def _shown(table):
    return table.select(
        "place_id", "first_listed", "last_seen", "name", "phone", "email", "reviews", "signals", "review_status",
        "notes", "hook_basis", "score", "score_band", "google_refreshed_at",
    )


@query
def upsert_leads(t):
    return _shown(store.upsert_leads(_before(t), _batch(t), F.lit(NOW)))


@query
def upsert_counts(t):
    return store.upsert_counts(_before(t), _batch(t))


def _kept_table(t):
    table = store.working_table(t.spark, fresh_path(t.spark, "working-table"), 64)
    table.commit(_before(t), None, "before")
    return table


@query
def upsert_table(t):
    """The same merge into a table kept in buckets; the repeated batch changes nothing."""
    table = _kept_table(t)
    for _ in range(2):
        store.upsert_table(table, _batch(t), F.lit(NOW), "batch")
    return _shown(table.read())


@query
def upsert_table_counts(t):
    return store.upsert_table(_kept_table(t), _batch(t), F.lit(NOW), "batch")


def _patches(t):
    """Hand edits: four cells per nation, two of them on the same cell."""
    cell = F.inline(
        F.array(
            F.struct(F.lit(1).alias("k"), F.lit("phone").alias("column"), F.lit("(215) 555-0100").alias("value")),
            F.struct(F.lit(2).alias("k"), F.lit("notes").alias("column"), F.lit("call back, after 5").alias("value")),
            F.struct(F.lit(3).alias("k"), F.lit("phone").alias("column"), F.lit("").alias("value")),
            F.struct(F.lit(4).alias("k"), F.lit("review_status").alias("column"), F.lit("contacted").alias("value")),
        )
    )
    edits = t.view("nation").select("n_nationkey", cell)
    return edits.select(
        (F.col("k") * 100 + F.col("n_nationkey")).alias("ord"),
        F.concat(F.lit("p"), (F.col("n_nationkey") * 2).cast("string")).alias("place_id"), "column", "value",
    )


@query
def patch_cells(t):
    return store.patch_cells(_stored(t), _patches(t)).select(
        "place_id", "name", "phone", "notes", "review_status", "last_seen", "google_refreshed_at"
    )


@query
def patch_log(t):
    return store.patch_log(_stored(t), _patches(t))


@query
def patch_violations(t):
    """A batch with bad rows: an id that is not stored, columns that are not open."""
    bad = _patches(t).withColumns(
        {
            "place_id": F.when(F.col("ord") % 3 == 0, F.lit("nobody")).otherwise(F.col("place_id")),
            "column": F.when(F.col("ord") % 4 == 0, F.lit("score")).otherwise(F.col("column")),
        }
    )
    refused = store.patch_cells(_stored(t), bad)
    untouched = refused.filter("phone = '(215) 555-0100'").agg(F.count(F.lit(1)))
    return store.patch_violations(_stored(t), bad).groupBy("error").agg(
        F.count(F.lit(1)).alias("patches"), F.max(untouched.scalar()).alias("cells_written")
    )


def _run_facts(t):
    """Run facts per market and niche: leads, and the sweep of the niche's two phrases."""
    niche = F.regexp_replace("term", " company$", "").alias("niche")
    sweep = t.halted_sweep.groupBy(niche).agg(
        F.count_if("searched").alias("tiles"), F.count_if(F.col("searched") & F.col("split")).alias("tiles_split"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls_used"), F.bool_or(~F.col("searched")).alias("halted"),
    )
    found = t.view("tile_batches").groupBy(niche).agg(
        (F.count(F.lit(1)) - F.count_distinct("place_id")).alias("duplicates_dropped")
    )
    leads = t.derived.groupBy("market", "niche").agg(
        F.max("checked_at").alias("finished_at"), F.count(F.lit(1)).alias("prospects"),
        F.count_if(~derive.blank("email")).alias("with_email"), F.max("run_file").alias("file"),
        (F.count_if("audited") == 0).alias("aborted"),
    )
    return leads.join(sweep, "niche", "left").join(found, "niche", "left").select(
        "finished_at", F.col("market").alias("location"), "niche", W.terms_for(F.col("niche")).alias("terms"),
        "prospects", "with_email", "tiles", "tiles_split", "calls_used", F.lit(MAX_CALLS).alias("max_calls"),
        (F.col("calls_used") * V.USD_PER_1000_CALLS / 1000).cast("double").alias("estimated_cost_usd"),
        "duplicates_dropped", "halted", "aborted", "file",
    )


@query
def append_run(t):
    """Two appends, of which the second is tried twice."""
    runs, folder = staged(_run_facts(t), "run-facts"), fresh_path(t.spark, "runs")
    one = F.col("niche") < "d"
    store.append_run(runs.filter(one), folder, "first")
    for _ in range(2):
        ledger_ = store.append_run(runs.filter(~one), folder, "second")
    return ledger_


@query
def write_unique(t):
    """The same run saved twice ends up under two names."""
    folder = fresh_path(t.spark, "unique")
    rows = files.harvest_rows(t.view("places"), F.lit("2026-08-01T14:27:26.000Z"))
    paths = [files.write_unique(rows, folder, "20260801-142726_town_gym") for _ in range(2)]
    saved = files.read_csv_text(t.spark, f"{folder}/*.csv", V.HARVEST_COLUMNS)
    assert len(set(paths)) == 2
    return saved.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("place_id").alias("places"))


@query
def run_sidecar(t):
    path = fresh_path(t.spark, "sidecar")
    by = ["run_file", "market", "niche"]
    totals = L.summarise(t.derived, by)
    runs = totals.select(
        F.col("run_file").alias("file"),
        F.struct(F.col("market").alias("location"), "niche").alias("run"),
        F.struct("prospects", "with_email", "down", "avg_rating").alias("totals"),
    )
    files.write_sidecar(runs, path)
    back = t.spark.read.schema(runs.schema).json(path)
    return back.select("file", "run.location", "run.niche", "totals.prospects", "totals.with_email", "totals.down", "totals.avg_rating")


# ---------------------------------------------------------------- filters


@query
def to_lead(t):
    return L.to_lead(t.view("places"), t.audits).select(
        "ord", "place_id", "name", "address", "phone", "website", "host", "email", joined("email_alt"), "rating",
        "reviews", "business_status", "reachable", "https", "ttfb_ms", "viewport", "contact_form", "final_url",
        "audit_error", "audited",
    )


@query
def filter_places(t):
    return gates.filter_places(t.view("places"), **GATE).select("ord", "place_id", "rating", "reviews", "website")


@query
def filter_leads(t):
    return gates.filter_leads(t.leads, require_email=True).select("ord", "place_id", "email")


@query
def drop_report(t):
    places = t.view("places")
    survivors = L.to_lead(gates.filter_places(places, **GATE), t.audits)
    return gates.drop_report(places, survivors, require_email=True, **GATE)


@query
def require_email_rows(t):
    """The rows to write, each beside the number withheld."""
    withheld = gates.require_email_rows(t.leads).select("withheld").scalar()
    return gates.filter_leads(t.leads, True).select("ord", "place_id", "email", withheld.alias("withheld"))


@query
def sendable_segment(t):
    rows = store.project_sheet(t.derived, F.col("niche"), F.col("market"), F.col("checked_at"))
    return gates.sendable_segment(rows).select("ord", "place_id", "hook_basis", "hook")


@query
def valid_boxes(t):
    return gates.valid_boxes(t.view("boxes"))


@query
def box_checks(t):
    return gates.box_checks(t.view("boxes")).select("ord", "valid", "too_small", "wide_km")


@query
def stale_fields(t):
    aged = _stored(t).withColumn(
        "google_refreshed_at",
        F.when(F.col("ord") % 4 == 0, F.lit("2026-06-20T00:00:00Z")).otherwise(F.col("google_refreshed_at")),
    )
    return gates.stale_fields(aged, t.now).select(
        "ord", "place_id", "name", "phone", "rating", "reviews", "score", "hook_basis", "stale"
    )


def _aged(t):
    refreshed = F.when(F.col("ord") % 4 == 0, F.lit("2026-06-20T00:00:00Z")).otherwise(F.col("google_refreshed_at"))
    return _stored(t).withColumn("google_refreshed_at", refreshed)


@query
def stale_list(t):
    return gates.stale_list(_aged(t), t.now).select("ord", "place_id", "name", "age_days")


@query
def stale_excluded(t):
    return gates.without_stale(_aged(t), t.now).select("ord", "place_id", "name")


@query
def disqualify(t):
    branded = t.leads.withColumn(
        "name",
        F.when(F.col("ord") % 33 == 0, F.concat(F.lit("JLL "), "name"))
        .when(F.col("ord") % 34 == 0, F.concat("name", F.lit(" on zillow")))
        .otherwise(F.col("name")),
    )
    return gates.disqualify(branded).select("ord", "place_id", "name", "disqualified")


# ---------------------------------------------------------------- joins


@query
def join_place_audit(t):
    return L.join_place_audit(t.view("places"), t.audits).select(
        "ord", "place_id", "website", "reachable", joined("emails"), "has_audit"
    )


@query
def join_probe(t):
    return contacts.join_probe(t.leads, t.view("probes")).select("ord", "place_id", "kind", "detail")


@query
def join_mx(t):
    checked = contacts.join_mx(contacts.addresses(t.leads), contacts.scan_mx(t.view("mx_results")))
    return checked.select("ord", "place_id", "email", "domain", "shaped", "verdict")


@query
def join_corpus(t):
    return market.join_corpus(t.leads).select(
        "ord", "place_id", "market", "niche", "corpus.n", "corpus.up", "corpus.down", "corpus.median_ttfb_ms",
        "corpus.viewport_bad", "corpus.https_ok",
    )


def _runs_files(t):
    runs = t.view("runs").select(
        "run_no",
        F.concat(
            F.date_format("finished_at", "yyyyMMdd-HHmmss"), F.lit("_"), F.regexp_replace("location", " ", "-"),
            F.lit("_"), F.regexp_replace("niche", "[^a-z0-9]+", "-"), F.lit("-"), F.col("run_no").cast("string"), F.lit(".csv"),
        ).alias("file"),
        "location", "niche", F.col("finished_at").cast("string").alias("finished_at"), "prospects", "calls_used",
        (F.col("calls_used") * V.USD_PER_1000_CALLS / 1000).cast("double").alias("estimated_cost_usd"),
    )
    return runs.select("file"), runs.filter("run_no % 3 <> 0").drop("run_no")


@query
def join_sidecar(t):
    saved, sidecars = _runs_files(t)
    return files.join_sidecar(saved, sidecars).withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss"))


@query
def reopen_run(t):
    leads = t.derived.withColumn("file", F.col("run_file"))
    sidecars = t.view("leads").groupBy(F.col("run_file").alias("file")).agg(F.max("market").alias("location"))
    kept = sidecars.filter(~F.col("file").endswith("-2.csv"))
    one = files.reopen_run(leads, "20260801-142726_town-0-pa_building.csv", kept)
    two = files.reopen_run(leads, "20260802-142726_town-1-pa_building-2.csv", kept)
    cols = ["file", "prospects", "with_email", "down", "avg_rating", "run_location", "location", "any_audited", "reopened_without_run"]
    return one.select(cols).unionByName(two.select(cols))


def _planned(t):
    return t.keyed_tiles.select("term", "depth", "gy", "gx", "tile_key")


@query
def tiles_to_pay(t):
    return tiles.tiles_to_pay(_planned(t), t.tile_cache, t.now)


@query
def cache_hits(t):
    return tiles.cache_hits(_planned(t), t.tile_cache, t.now)


def _fetched(t):
    """Answers of the tiles above the finest level: the budget ends before the others."""
    return tiles.tiles_to_pay(t.tile_answers, t.tile_cache, t.now).filter("depth < 3").select("tile_key", "places", "truncated")


@query
def cache_replay(t):
    replayed = tiles.cache_replay(_planned(t), t.filled_cache, _fetched(t), t.now)
    return tiles.replayed_batches(replayed).select("term", "depth", "gy", "gx", "source", "pos", F.col("place.id").alias("place_id"))


@query
def cache_use(t):
    return tiles.cache_use(tiles.cache_replay(_planned(t), t.filled_cache, _fetched(t), t.now))


@query
def cache_next(t):
    """The cache as kept in buckets, after a run has written its answers into it."""
    folder = fresh_path(t.spark, "tile-cache")
    Snapshot(t.spark, folder, "tile_key", tiles.CACHE_BUCKETS).commit(t.filled_cache, None, "before")
    return tiles.flush_cache(t.spark, folder, _fetched(t), t.now, "run").select(
        "tile_key", "at", "truncated", F.size("places").alias("places")
    )


def _paths(t):
    url = H.parse_url(F.col("url"))
    return t.view("pages").select("page_id", "url", url.alias("u")).select(
        "page_id", F.col("u.origin").alias("origin"), F.col("u.path").alias("path")
    )


@query
def robots_match(t):
    return audit.robots_match(_paths(t), t.view("robots_captures"), "page_id")


@query
def point_in_tile(t):
    return tiles.point_in_tile(t.leads, ROOT, 4).select("ord", "place_id", "gy", "gx")


@query
def drop_duplicates_anti(t):
    kept = dedupe.drop_duplicates_anti(t.derived, dedupe.find_duplicates(t.derived))
    return kept.select("ord", "place_id", F.col("score.total").alias("total"))


# ---------------------------------------------------------------- aggregations


@query
def summarise(t):
    return L.summarise(t.derived)


@query
def summarise_by_run(t):
    return L.summarise(t.derived, ["run_file"])


@query
def corpus(t):
    return market.corpus(t.leads)


@query
def ttfb_median(t):
    return market.ttfb_median(t.leads)


@query
def slowest(t):
    return market.slowest(t.leads)


@query
def sweep_summary(t):
    return tiles.sweep_summary(t.halted_sweep, ("term",))


@query
def sweep_summary_complete(t):
    """The same without a limit on calls."""
    return tiles.sweep_summary(t.tiles, ("term",))


@query
def hook_coverage(t):
    return market.hook_coverage(t.hooked)


@query
def band_counts(t):
    return L.band_counts(t.derived)


@query
def audit_summary(t):
    return L.audit_summary(t.audits)


@query
def contact_report(t):
    return contacts.contact_report(contacts.contact_checks(t.leads, t.view("probes"), t.view("mx_results")))


@query
def letter_coverage(t):
    return market.letter_coverage(t.hooked)


@query
def harvest_summary(t):
    return pipelines.harvest_summary(t.view("tile_batches"), t.api_pages, max_results=500, **GATE)


@query
def duplicate_savings(t):
    return dedupe.duplicate_savings(dedupe.find_duplicates(t.derived))


@query
def run_cost(t):
    months = t.view("runs").withColumn("month", F.date_format("finished_at", "yyyy-MM"))
    return L.run_cost(months, ["month"]).withColumn("estimated_cost_usd", F.round(F.col("estimated_cost_usd").cast("double"), 3))


# ---------------------------------------------------------------- windows


@query
def dedupe_first(t):
    return dedupe.dedupe_first(t.view("tile_batches")).select("place_id", "batch", "pos", "term")


@query
def duplicates_dropped(t):
    return dedupe.duplicates_dropped(t.view("tile_batches"))


@query
def dedupe_latest(t):
    rows = t.view("orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("place_id"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("file"), F.col("o_orderkey").alias("ord"),
        F.col("o_totalprice").alias("reading"),
    )
    return dedupe.dedupe_latest(rows)


@query
def result_cap(t):
    return dedupe.result_cap(t.view("tile_batches"), 700).select("place_id", "batch", "pos")


@query
def cap_reached(t):
    return dedupe.cap_reached(t.view("tile_batches"), 700)


@query
def budget_grant(t):
    grants = ledger.budget_grant(t.view("budget_requests"), month_cap=700, day_cap=30)
    return grants.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("resets_at", "day_resets_at")}).drop("ts")


@query
def budget_settle(t):
    return t.ledger_steps.drop("ts")


@query
def budget_peek(t):
    now = F.lit("2024-01-30 20:00:00").cast("timestamp")
    peek = ledger.budget_peek(t.ledger_steps, now, month_cap=500, day_cap=30)
    return peek.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("resets_at", "day_resets_at")})


@query
def budget_stream(t):
    return stream_budget(t.view("ledger_events"), month_cap=500, day_cap=30).drop("ts", "want")


@query
def cluster_survivor(t):
    return dedupe.cluster_survivor(dedupe.find_duplicates(t.derived)).select(
        "shared_by", "value", "size", "group_ord", "place_id", "total"
    )


@query
def find_duplicates(t):
    return dedupe.find_duplicates(t.derived)


# ---------------------------------------------------------------- top-k


@query
def rank_leads(t):
    return L.rank_leads(t.derived).select(
        "ord", "place_id", "name", F.col("score.total").alias("total"), F.col("score.band").alias("band"),
        F.array_join("score.reasons", "; ").alias("reasons"),
    )


@query
def page_newest(t):
    folder = fresh_path(t.spark, "pages")
    store.write_pages(store.upsert_leads(_before(t), _batch(t), F.lit(NOW)), folder, 100)
    return store.read_page(t.spark, folder, 200, 40).select("place_id", "generation", "ord", "name")


@query
def page_after(t):
    """The second page of 100, asked for by the last row of the first."""
    table = staged(store.upsert_leads(_before(t), _batch(t), F.lit(NOW)), "table")
    last = store.page_after(table, limit=100).collect()[-1]
    return store.page_after(table, (last["generation"], last["ord"], last["place_id"]), 100).select("place_id", "generation", "ord", "name")


@query
def letters_ordered(t):
    return market.letters_ordered(market.letters(t.compared)).select("ord", "place_id", "basis", "basis_rank", "subject")


@query
def emails_top3(t):
    pages = audit.extract_emails(t.view("site_pages"))
    return pages.select("page_id", F.posexplode(F.slice("emails", 1, 3)).alias("pos", "email"))


@query
def links_top2(t):
    return audit.contact_links(t.view("site_pages")).select("page_id", F.posexplode("links").alias("pos", "link"))


# ---------------------------------------------------------------- set operations


@query
def union_batches(t):
    b = t.view("tile_batches")
    first, second = b.filter("batch = 1"), b.filter("batch = 2")
    return pipelines.union_batches([first, second]).select("term", "batch", "pos", "place_id")


@query
def union_findings(t):
    checks = contacts.contact_checks(t.leads, t.view("probes"), t.view("mx_results"))
    return checks.select("ord", "place_id", "channel", "kind")


@query
def distinct_emails(t):
    return t.view("site_pages").select("page_id", F.explode(H.email_candidates(F.col("html"))).alias("email"))


# ---------------------------------------------------------------- functions


@query
def signals(t):
    return t.derived.select("ord", "place_id", joined("signals"))


@query
def score_opportunity(t):
    return t.derived.select("ord", "place_id", F.col("score.opportunity").alias("opportunity"))


@query
def score_reach(t):
    return t.derived.select("ord", "place_id", F.col("score.reach").alias("reach"))


@query
def score_value(t):
    return t.derived.select("ord", "place_id", F.col("score.value").alias("value"))


@query
def score_total(t):
    return t.derived.select(
        "ord", "place_id", F.col("score.total").alias("total"), F.col("score.band").alias("band"),
        F.array_join("score.reasons", "; ").alias("reasons"),
    )


@query
def phone_key(t):
    return t.leads.select("ord", "phone", K.phone_key(F.col("phone")).alias("phone_key"))


@query
def host_key(t):
    return t.view("pages").select("page_id", K.host_key(F.concat(F.upper(F.substring("url", 1, 12)), F.expr("substring(url, 13)"))).alias("host_key"))


@query
def owns_domain(t):
    return t.leads.select("ord", "name", K.owns_domain(F.col("name"), K.host_key(F.col("website"))).alias("owns"))


@query
def extract_emails(t):
    pages = audit.extract_emails(t.view("site_pages"))
    return pages.select("page_id", F.size("emails").alias("found"), joined("emails"))


@query
def email_plausible(t):
    found = t.view("site_pages").select("page_id", F.explode(H.email_candidates(F.col("html"))).alias("email"))
    return found.select("page_id", "email", H.email_plausible(F.col("email")).alias("plausible"))


@query
def email_belongs(t):
    found = t.view("site_pages").select("page_id", "site_host", F.explode(H.email_candidates(F.col("html"))).alias("email"))
    site = H.bare_host(F.col("site_host"))
    return found.select("page_id", "email", H.email_belongs(F.col("email"), site).alias("belongs"))


@query
def email_rank(t):
    found = t.view("site_pages").select("page_id", "site_host", F.explode(H.email_candidates(F.col("html"))).alias("email"))
    site = H.bare_host(F.col("site_host"))
    return found.select("page_id", "email", H.email_score(F.col("email"), site).cast("int").alias("points"))


@query
def contact_links(t):
    return audit.contact_links(t.view("site_pages"), None).select("page_id", F.size("links").alias("found"), joined("links"))


@query
def audit_page(t):
    return audit.audit_page(t.view("page_captures")).select(
        "place_id", "role", "url", "http_status", "reachable", "https", "ttfb_ms", "viewport", "contact_form"
    )


@query
def audit_site(t):
    return t.site_audits.select(
        "place_id", "input_url", "final_url", "reachable", "https", "ttfb_ms", "viewport", "contact_form",
        joined("emails"), "pages_fetched", "http_status", "error", "robots_blocked",
    )


@query
def parse_robots(t):
    return audit.robots_rules_long(t.view("robots_captures"))


@query
def robots_allowed(t):
    checked = audit.robots_match(_paths(t), t.view("robots_captures"), "page_id")
    return checked.select("page_id", "allowed")


@query
def phone_problem(t):
    problem = K.phone_problem(F.col("phone"), K.is_ph(F.col("address")))
    return t.leads.select("ord", "phone", problem.alias("problem"))


@query
def market_rule(t):
    return t.leads.select("ord", K.is_ph(F.col("address")).alias("is_ph"))


@query
def email_shape(t):
    return t.leads.select("ord", "email", K.present(F.col("email")).alias("present"), K.email_shaped(F.col("email")).alias("shaped"))


@query
def contact_findings(t):
    found = contacts.contact_findings(t.leads, t.view("probes"), t.view("mx_results"))
    return found.select("ord", "place_id", "kind", "detail")


@query
def contact_markdown(t):
    return contacts.contact_markdown(contacts.contact_findings(t.leads, t.view("probes"), t.view("mx_results")))


@query
def contact_table(t):
    checks = contacts.contact_checks(t.leads, t.view("probes"), t.view("mx_results"))
    return contacts.contact_table(checks, t.leads, F.date_format(t.now, "yyyy-MM-dd"))


@query
def contact_headings(t):
    return contacts.contact_headings(contacts.contact_checks(t.leads, t.view("probes"), t.view("mx_results")))


@query
def audience(t):
    return t.leads.select("ord", "niche", W.audience(F.col("niche")).alias("audience"))


@query
def hook(t):
    return t.hooked.select("ord", "place_id", "hook.text", "hook.audience", "hook.basis", "hook.reason")


@query
def check_date(t):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00Z"))
    broken = F.when(F.col("o_orderkey") % 9 == 0, F.lit("soon")).otherwise(iso)
    return t.view("orders").select("o_orderkey", clock.check_date(broken).alias("checked_on"))


@query
def benchmark(t):
    return t.compared.select("ord", "place_id", "benchmark")


@query
def market_findings(t):
    return market.corpus(t.leads).select("market", "niche", market.market_findings().alias("findings"))


@query
def letters(t):
    return market.letters(t.compared)


@query
def campaign_letter(t):
    return market.campaign_letter(t.leads)


@query
def campaign_refusals(t):
    by_status = F.concat_ws(" ", "market", F.nullif(F.lower("business_status"), F.lit("")))
    return market.campaign_refusals(t.leads.withColumn("market", by_status))


@query
def niche_words(t):
    ends = ["", "-management", " Agency", " box", " law", " dental_clinic", " daycare"]
    tail = F.element_at(F.array(*map(F.lit, ends)), (F.col("p_partkey") % len(ends) + 1).cast("int"))
    niche = F.concat("p_name", tail)
    return t.view("part").select(
        "p_partkey", W.countable_niche(niche).alias("countable"), W.plural_niche(niche).alias("plural"),
        W.looker(niche).alias("looker"),
    )


@query
def market_label(t):
    slug = F.concat(F.lower("source"), F.when(F.col("doc_id") % 3 == 0, F.lit("-nj-usa")).when(F.col("doc_id") % 3 == 1, F.lit("_pa")).otherwise(F.lit("-us")))
    return t.view("documents").select("doc_id", W.market_label(slug).alias("label"))


@query
def slug(t):
    return t.view("documents").select("doc_id", W.slug(F.col("text")).alias("slug"), F.length("text").alias("chars"))


@query
def run_name(t):
    return t.view("runs").select("run_no", W.run_name(F.col("finished_at"), F.col("location"), F.col("niche")).alias("run_name"))


@query
def tile_key(t):
    return tiles.with_corners(t.tiles, ROOT).select("term", "depth", "gy", "gx", "tile_key")


@query
def fresh(t):
    return tiles.fresh(t.tile_cache, t.now).select("tile_key", "at")


@query
def calendar_keys(t):
    ts = F.col("ts").cast("timestamp")
    return t.view("events").select("event_id", clock.month_key(ts).alias("month_key"), clock.day_key(ts).alias("day_key"))


@query
def next_resets(t):
    ts = F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR") * (F.col("o_orderkey") % 24)
    return t.view("orders").select(
        "o_orderkey", F.date_format(clock.next_month_reset(ts), "yyyy-MM-dd HH:mm:ss").alias("month_reset"),
        F.date_format(clock.next_day_reset(ts), "yyyy-MM-dd HH:mm:ss").alias("day_reset"),
    )


@query
def quota_class(t):
    body, status = F.col("body"), F.col("status")
    return t.view("quota_errors").select(
        "event_id", K.quota_kind(body).alias("kind"), K.quota_limit_name(body).alias("limit_name"),
        K.quota_fatal(status, body).alias("fatal"),
    )


@query
def quadrants(t):
    boxes = gates.box_checks(t.view("boxes")).filter("valid").select("ord", "sw_lat", "sw_lng", "ne_lat", "ne_lng")
    return tiles.quadrants(boxes)


@query
def quadtree_tiles(t):
    return t.tiles


@query
def tile_plan(t):
    return tiles.tile_plan(t.tiles)


@query
def sweep_halted(t):
    return t.halted_sweep.filter("searched").drop("searched", "path")


# ---------------------------------------------------------------- whole jobs


@query
def job_letters(t):
    return pipelines.letters(t.leads).select("ord", "place_id", "basis", "basis_rank", "subject")


@query
def job_verify(t):
    found, _ = pipelines.verify_contacts(t.leads, t.view("probes"), t.view("mx_results"))
    return found.select("ord", "place_id", "kind", "detail")


@query
def job_rank(t):
    """The best 20 leads over two saved runs: every lead, and every third with later readings."""
    third = L.with_derived(t.leads.filter("ord % 3 = 0").withColumn("reviews", F.col("reviews") + 1))
    saved = t.derived.withColumn("file", F.lit("20260801.csv")).unionByName(third.withColumn("file", F.lit("20260802.csv")))
    return pipelines.rank(saved).select("ord", "place_id", F.col("score.total").alias("total"), "file")


@query
def job_search(t):
    """Batches to scored, filtered leads in one plan."""
    places = t.view("places")
    done = pipelines.search(t.view("tile_batches"), places, t.audits, max_results=700, require_email=True, **GATE)
    return done.select("place_id", "batch", "pos", joined("signals"), F.col("score.total").alias("total"))
