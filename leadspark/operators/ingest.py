"""Listings out of captured search pages, with a quarantine for bad records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.derive import any_of
from ..functions.wording import terms_for
from ..schemas import PLACE_SCHEMA


def _typed(path: str, kind: str):
    """Absent is fine; present with another JSON type is a fault."""
    raw = F.try_variant_get("v", f"$.{path}", "variant")
    return raw.isNotNull() & ~F.schema_of_variant(raw).rlike(kind)


def _records(body: Column) -> Column:
    """The raw records of a page; NULL when its places are no array."""
    listed = F.get_json_object(body, "$.places")
    return F.when(F.startswith(F.ltrim(listed), F.lit("[")), F.from_json(listed, "array<string>"))


def _unreadable(body: Column, records: Column) -> Column:
    """Neither an object without places nor one with an array of them."""
    page = F.try_parse_json(body)
    no_places = F.coalesce(F.schema_of_variant(page).startswith("OBJECT"), F.lit(False)) & F.try_variant_get(
        page, "$.places", "variant"
    ).isNull()
    return records.isNull() & ~no_places


def parse_places(api_pages: DataFrame) -> DataFrame:
    """One row per raw record with the parsed `place` and `error` (NULL if valid).

    Records are split out as text first, so one malformed record never costs the
    other records of its page. A page that cannot be read is one row of its own, at
    position -1 with its body as the raw text.
    """
    kept = [c for c in api_pages.columns if c != "body"]
    found = _records(F.col("body"))
    whole = F.struct(F.lit(-1).alias("pos"), F.col("body").alias("raw"))
    each = F.transform(found, lambda raw, pos: F.struct(pos.alias("pos"), raw.alias("raw")))
    records = api_pages.select(
        *kept, F.explode(F.when(_unreadable(F.col("body"), found), F.array(whole)).otherwise(each)).alias("record")
    ).select(*kept, "record.*")
    place = F.from_json("raw", PLACE_SCHEMA)
    number, text = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "^STRING"
    count = F.try_variant_get("v", "$.userRatingCount", "double")
    status = F.try_variant_get("v", "$.businessStatus", "string")
    faults = {
        "id": _typed("id", text) | (F.coalesce(F.try_variant_get("v", "$.id", "string"), F.lit("")) == ""),
        "displayName": _typed("displayName", "^OBJECT"),
        "displayName.text": _typed("displayName.text", text)
        | (
            F.try_variant_get("v", "$.displayName", "variant").isNotNull()
            & F.try_variant_get("v", "$.displayName.text", "variant").isNull()
        ),
        "formattedAddress": _typed("formattedAddress", text),
        "nationalPhoneNumber": _typed("nationalPhoneNumber", text),
        "websiteUri": _typed("websiteUri", text),
        "rating": _typed("rating", number),
        "userRatingCount": _typed("userRatingCount", number)
        | F.coalesce((count < 0) | (count != F.floor(count)), F.lit(False)),
        "businessStatus": _typed("businessStatus", text)
        | F.coalesce(~status.isin(V.BUSINESS_STATUSES), F.lit(False)),
        "primaryType": _typed("primaryType", text),
        "types": _typed("types", "^ARRAY<(STRING|VOID)>"),
        "location": _typed("location", "^OBJECT"),
        "location.latitude": _located("latitude", number),
        "location.longitude": _located("longitude", number),
    }
    bad = [F.when(cond, F.lit(name)) for name, cond in faults.items()]
    unreadable = F.col("v").isNull()
    error = (
        F.when(F.col("pos") < 0, F.lit("unreadable page"))
        .when(unreadable, F.lit("not an object"))
        .when(any_of(faults.values()), F.concat_ws("; ", *bad))
    )
    judged = F.struct(place.alias("place"), error.alias("error"))
    # The one-element array is a barrier: a filter on `error` is not pushed below it, where
    # it would repeat the parsing for every field it looks at.
    return records.withColumn("v", F.try_parse_json("raw")).select(
        *records.columns, F.explode(F.array(judged)).alias("judged")
    ).select(*records.columns, "judged.*")


def _located(field: str, number: str):
    here = F.try_variant_get("v", "$.location", "variant").isNotNull()
    value = F.try_variant_get("v", f"$.location.{field}", "variant")
    return here & (value.isNull() | ~F.schema_of_variant(value).rlike(number))


def ingest_places(api_pages: DataFrame) -> DataFrame:
    """Valid listings."""
    rows = parse_places(api_pages).filter(F.col("error").isNull())
    return rows.select(*[c for c in rows.columns if c not in ("place", "raw", "error")], "place.*")


def rejected_places(api_pages: DataFrame) -> DataFrame:
    """The quarantine: raw text and the faulty fields."""
    return parse_places(api_pages).filter(F.col("error").isNotNull()).drop("place")


def tile_completeness(tiles: DataFrame, api_pages: DataFrame) -> DataFrame:
    """Whether each planned (term, tile) was answered in full.

    Truncated when the last page still offers a token, when no page came back at
    all, when a page before the last one is missing or a page cannot be read, or when
    the raw count, rejects included, reaches the ceiling. A page captured more than
    once counts once, by its fullest capture.
    """
    found = _records(F.col("body"))
    captured = api_pages.filter(F.col("page_no") <= V.MAX_PAGES).select(
        "term", "tile_key", "page_no", F.coalesce(F.col("next_token"), F.lit("")).alias("token"),
        F.coalesce(F.size(found), F.lit(0)).alias("raw"),
        (~_unreadable(F.col("body"), found)).alias("readable"),
    )
    each_page = captured.groupBy("term", "tile_key", "page_no").agg(
        F.max("raw").alias("raw"), F.max("token").alias("token"), F.max("readable").alias("readable")
    )
    seen = each_page.groupBy("term", "tile_key").agg(
        F.sum("raw").alias("raw_returned"),
        F.count(F.lit(1)).alias("pages_fetched"),
        F.max("page_no").alias("last_page"),
        F.min("readable").alias("all_readable"),
        F.max_by(F.struct(F.nullif("token", F.lit("")).alias("next_token")), "page_no").alias("last"),
    )
    pages = F.coalesce("pages_fetched", F.lit(0))
    truncated = (
        (pages == 0)
        | F.coalesce(F.col("last_page") > pages, F.lit(False))
        | F.coalesce(~F.col("all_readable"), F.lit(False))
        | F.coalesce(F.col("last.next_token") != "", F.lit(False))
        | F.coalesce(F.col("raw_returned") >= V.RESULT_CEILING, F.lit(False))
    )
    return tiles.join(seen, ["term", "tile_key"], "left").select(
        "term",
        "tile_key",
        F.coalesce("raw_returned", F.lit(0)).cast("long").alias("raw_returned"),
        pages.cast("long").alias("pages_fetched"),
        truncated.alias("truncated"),
    )


def term_expand(niches: DataFrame, first_n: float | None = None) -> DataFrame:
    """Search phrases per niche in order; `terms_available` counts them all."""
    terms = niches.select("*", terms_for(F.col("niche")).alias("terms"))
    if first_n is not None and 0 < first_n < float("inf"):
        kept = F.slice("terms", 1, int(first_n))
    else:
        kept = F.col("terms")
    return terms.select(
        *niches.columns,
        F.size("terms").alias("terms_available"),
        F.posexplode(kept).alias("pos", "term"),
    )
