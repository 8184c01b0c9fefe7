"""The derived tables a query starts from, built lazily per data folder."""

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..operators import audit, ledger, market, tiles
from ..operators import leads as L
from ..sources.driver_views import VIEWS
from ..sources.stage import staged

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
# The curated core market: the root box of every sweep here.
ROOT = dict(zip(("sw_lat", "sw_lng", "ne_lat", "ne_lng"), V.CURATED_MARKETS[0][3:]))
NOW = "2026-08-04 00:00:00"
# Calls that a halted sweep may spend.
MAX_CALLS = 100


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._made: set[str] = set()

    def view(self, name: str) -> DataFrame:
        """A base table or a derived view by name."""
        self._register(name)
        return self.spark.table(f"ls_{name}")

    def _register(self, name: str) -> None:
        if name in self._made:
            return
        self._made.add(name)
        if name in VIEWS:
            text = VIEWS[name]
            for other in [*BASE, *VIEWS]:
                if other != name and _uses(text, other):
                    self._register(other)
                    text = _rename(text, other)
            self.spark.sql(text).createOrReplaceTempView(f"ls_{name}")
        else:
            path = f"{self.folder}/{name}.parquet"
            self.spark.read.parquet(path).createOrReplaceTempView(f"ls_{name}")

    @property
    def now(self):
        return F.lit(NOW).cast("timestamp")

    @cached_property
    def leads(self) -> DataFrame:
        return self.view("leads").withColumn("email_alt", _words("email_alt"))

    @cached_property
    def derived(self) -> DataFrame:
        return L.with_derived(self.leads)

    @cached_property
    def hooked(self) -> DataFrame:
        return market.with_hook(self.derived)

    @cached_property
    def compared(self) -> DataFrame:
        return market.with_benchmark(market.join_corpus(self.hooked))

    @cached_property
    def audits(self) -> DataFrame:
        return self.view("audits").withColumn("emails", _words("emails_text")).drop("emails_text")

    @cached_property
    def api_pages(self) -> DataFrame:
        """Search pages of up to 20 listings as JSON, a few records malformed."""
        p = self.view("places")
        ord_ = F.col("ord")
        record = F.to_json(
            F.struct(
                F.when(ord_ % 31 != 0, F.col("place_id")).otherwise("").alias("id"),
                F.struct(F.col("name").alias("text")).alias("displayName"),
                F.col("address").alias("formattedAddress"),
                F.col("phone").alias("nationalPhoneNumber"),
                F.col("website").alias("websiteUri"),
                "rating",
                F.when(ord_ % 29 == 0, F.lit(-5)).otherwise(F.col("reviews")).alias("userRatingCount"),
                F.when(ord_ % 23 == 0, F.lit("CLOSED_FOREVER"))
                .otherwise(F.col("business_status"))
                .alias("businessStatus"),
                F.col("primary_type").alias("primaryType"),
                F.struct(
                    F.col("lat").alias("latitude"),
                    F.when(ord_ % 47 != 0, F.col("lng")).alias("longitude"),
                ).alias("location"),
            )
        )
        quoted = F.regexp_replace(record, '"rating":([0-9.]+)', '"rating":"$1"')
        nameless = F.regexp_replace(record, r'"displayName":\{\},', "")
        record = F.when(ord_ % 37 == 0, quoted).otherwise(nameless)
        sheet = F.floor(ord_ / 20)
        chain = F.floor(sheet / 3)
        page_no = (sheet % 3 + 1).cast("int")
        return (
            p.select(sheet.alias("sheet"), chain.alias("chain"), page_no.alias("page_no"), "ord", record.alias("record"))
            .groupBy("sheet", "chain", "page_no")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "record"))), lambda r: r["record"]), ",").alias("records"))
            .select(
                F.format_string("term %s", F.col("chain") % 4).alias("term"),
                F.format_string("tile-%s", F.col("chain")).alias("tile_key"),
                "page_no",
                F.concat(F.lit('{"places":['), F.col("records"), F.lit("]}")).alias("body"),
                F.when((F.col("page_no") < 3) | (F.col("chain") % 4 == 0), F.lit("token")).alias("next_token"),
            )
        )

    @cached_property
    def gapped_pages(self) -> DataFrame:
        """The same pages with every seventeenth missing, as a broken sweep leaves them."""
        sheet = F.substring_index("tile_key", "-", -1).cast("long") * 3 + F.col("page_no") - 1
        return self.api_pages.filter(sheet % 17 != 16)

    @cached_property
    def planned_tiles(self) -> DataFrame:
        chain = F.floor(F.col("ord") / 60)
        return self.view("places").select(
            F.format_string("term %s", chain % 4).alias("term"),
            F.format_string("tile-%s", chain).alias("tile_key"),
        ).distinct()

    @cached_property
    def tiles(self) -> DataFrame:
        """Adaptive tiles of both search phrases, to depth 3."""
        return tiles.quadtree_tiles(self.view("tile_batches"), ROOT, 3)

    @cached_property
    def keyed_tiles(self) -> DataFrame:
        """The same tiles with their corners, as the saved plan of a sweep."""
        return staged(tiles.with_corners(self.tiles, ROOT), "tiles")

    @cached_property
    def tile_cache(self) -> DataFrame:
        """Cached answers for part of the planned tiles, fresh, old or broken."""
        keyed = self.keyed_tiles.filter("(gy + gx + depth) % 3 <> 0")
        day = F.concat(F.lit("2026-07-"), F.lpad((F.col("gx") + 27).cast("string"), 2, "0"))
        return keyed.select(
            "tile_key",
            F.when(F.col("gy") + F.col("gx") == 2, F.lit("not a date")).otherwise(F.concat(day, F.lit("T06:00:00Z"))).alias("at"),
            F.when((F.col("gx") == 3) & (F.col("gy") == 0), F.lit(None)).otherwise(F.array(F.lit("place"))).alias("places"),
            "truncated",
        )

    @cached_property
    def halted_sweep(self) -> DataFrame:
        """The same sweep with MAX_CALLS calls to spend."""
        return tiles.budgeted_sweep(self.tiles, MAX_CALLS, ROOT, 3)

    @cached_property
    def tile_answers(self) -> DataFrame:
        """What a search of each planned tile returns: its first 60 places."""
        tile = ["term", "depth", "gy", "gx"]
        at = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("depth")
        points = tiles.point_in_tile(self.view("tile_batches"), ROOT, 3).select("term", "place_id", "pos", "gy", "gx", at)
        shifted = {c: F.expr(f"shiftright({c}, 3 - depth)") for c in ("gy", "gx")}
        first = points.withColumns(shifted).withColumn("_r", F.row_number().over(Window.partitionBy(*tile).orderBy("pos")))
        lists = first.filter(F.col("_r") <= V.RESULT_CEILING).groupBy(*tile).agg(
            F.array_sort(F.collect_list(F.struct("pos", "place_id"))).alias("found")
        )
        places = F.transform("found", lambda p: F.struct(p["place_id"].alias("id")))
        none = F.array().cast("array<struct<id: string>>")
        return self.keyed_tiles.join(lists, tile, "left").select(
            *tile, "tile_key", F.coalesce(places, none).alias("places"), "truncated"
        )

    @cached_property
    def filled_cache(self) -> DataFrame:
        """The cache of answered tiles with the places they returned."""
        held = self.tile_cache.withColumn("broken", F.col("places").isNull()).drop("places", "truncated")
        return held.join(self.tile_answers, "tile_key").select(
            "tile_key", "at", F.when(~F.col("broken"), F.col("places")).alias("places"), "truncated"
        )

    @cached_property
    def site_audits(self) -> DataFrame:
        sites = self.view("site_pages").select("place_id", F.col("url").alias("website"))
        return audit.audit_site(sites, self.view("page_captures"), self.view("robots_captures"))

    @cached_property
    def ledger_steps(self) -> DataFrame:
        return ledger.budget_settle(self.view("ledger_events"), month_cap=500, day_cap=30)


def _uses(text: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) is not None


def _rename(text: str, name: str) -> str:
    return re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2ls_{name}", text)


def _words(name: str):
    return F.filter(F.split(F.col(name), " "), lambda w: w != "")
