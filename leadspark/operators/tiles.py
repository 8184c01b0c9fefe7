"""Adaptive tiles over points, their plan, and the cache of answered tiles."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.clock import age_below
from ..functions.wording import tile_key
from ..sources.snapshots import Snapshot
from ..sources.stage import staged
from .scan import running_total


def quadrants(boxes: DataFrame) -> DataFrame:
    """The four children of every box that can still be halved, SW SE NW NE."""
    mid_lat = (F.col("sw_lat") + F.col("ne_lat")) / 2
    mid_lng = (F.col("sw_lng") + F.col("ne_lng")) / 2
    splittable = (
        (mid_lat > F.col("sw_lat")) & (mid_lat < F.col("ne_lat"))
        & (mid_lng > F.col("sw_lng")) & (mid_lng < F.col("ne_lng"))
    )

    def child(i, name, lat0, lng0, lat1, lng1):
        return F.struct(
            F.lit(i).alias("child_no"), F.lit(name).alias("child"),
            lat0.alias("c_sw_lat"), lng0.alias("c_sw_lng"), lat1.alias("c_ne_lat"), lng1.alias("c_ne_lng"),
        )

    s, n = F.col("sw_lat"), F.col("ne_lat")
    w, e = F.col("sw_lng"), F.col("ne_lng")
    children = F.array(
        child(0, "SW", s, w, mid_lat, mid_lng),
        child(1, "SE", s, mid_lng, mid_lat, e),
        child(2, "NW", mid_lat, w, n, mid_lng),
        child(3, "NE", mid_lat, mid_lng, n, e),
    )
    return boxes.filter(splittable).select("*", F.inline(children))


CACHE_BUCKETS = 64
# Levels counted in one pass over the points.
STRIDE = 8
# Cell numbers fit an int up to this depth, and a double's fraction up to the other.
INT_DEPTH, MAX_DEPTH = 30, 52


def _index(value: Column, low: float, high: float, depth: int) -> Column:
    cells = 1 << depth
    index = F.floor((value - F.lit(low)) / F.lit(high - low) * cells)
    return F.least(index, F.lit(cells - 1))


def cell(value: Column, low: float, high: float, depth: int) -> Column:
    """Half-open cell index at `depth`; the far edge belongs to the last cell."""
    return _index(value, low, high, depth).cast("int" if depth <= INT_DEPTH else "long")


def in_root(root: dict) -> Column:
    lat, lng = F.col("lat"), F.col("lng")
    return lat.between(root["sw_lat"], root["ne_lat"]) & lng.between(root["sw_lng"], root["ne_lng"])


def point_in_tile(points: DataFrame, root: dict, depth: int) -> DataFrame:
    """Each point inside the root beside the one cell of `depth` that holds it."""
    return points.filter(in_root(root)).select(
        "*",
        cell(F.col("lat"), root["sw_lat"], root["ne_lat"], depth).alias("gy"),
        cell(F.col("lng"), root["sw_lng"], root["ne_lng"], depth).alias("gx"),
    )


def can_split(root: dict) -> Column:
    """Whether a tile's middle still lies strictly between its corners."""

    def apart(low, high, at):
        side = F.pow(F.lit(2.0), F.col("depth"))
        step = F.lit(high - low) / side
        a, b = F.lit(low) + F.col(at) * step, F.lit(low) + (F.col(at) + 1) * step
        middle = (a + b) / 2
        return (middle > a) & (middle < b)

    return apart(root["sw_lat"], root["ne_lat"], "gy") & apart(root["sw_lng"], root["ne_lng"], "gx")


def blocker(root: dict, max_depth: int) -> Column:
    """Why a truncated tile cannot be split, NULL where it can."""
    return F.when(F.col("depth") >= max_depth, F.lit("maxDepth")).when(~can_split(root), F.lit("precision"))


def quadtree_tiles(
    points: DataFrame,
    root: dict,
    max_depth: int,
    by: tuple[str, ...] = ("term",),
    ceiling: int = V.RESULT_CEILING,
    terms: DataFrame | None = None,
    stride: int = STRIDE,
) -> DataFrame:
    """Every tile a sweep visits, with its count, split flag and blocker.

    A pass counts the points once, at its finest level, and sums those counts upwards
    over at most `stride` levels. Where a tile at its finest level is truncated and may
    still be split, the next pass goes on with the points under such tiles only, so the
    depth costs passes where points cluster and nothing elsewhere. A tile is visited
    when every tile above it was split. `terms` names the keys that are searched even
    where they have no point. Without points and `terms` there are no tiles.
    """
    if not 0 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be between 0 and {MAX_DEPTH}, got {max_depth}")
    keys = list(by)
    left = points.filter(in_root(root)).select(*keys, "lat", "lng")
    tiles, open_, base = None, None, 0
    while True:
        top = min(base + stride, max_depth)
        counts = _counts(left, root, keys, base, top)
        if base == 0:
            roots = counts.filter("depth = 0")
            if terms is not None:
                none = terms.select(*keys).distinct().join(roots, keys, "left_anti")
                roots = roots.unionByName(none.select(*keys, *_place(0, max_depth), F.lit(0).cast("long").alias("n")))
            found = roots.unionByName(_children(counts, roots, root, keys, base, top, max_depth, ceiling))
        else:
            found = _children(counts, open_, root, keys, base, top, max_depth, ceiling)
        found = found if base == 0 and top == max_depth else staged(found, "tiles")
        tiles = found if tiles is None else tiles.unionByName(found)
        if top == max_depth:
            break
        open_ = found.filter((F.col("depth") == top) & _split(root, max_depth, ceiling))
        if open_.isEmpty():
            break
        base = top
        here = [_cell_at(top, c, root, max_depth).alias(f"_{c}") for c in ("gy", "gx")]
        under = open_.select(*keys, F.col("gy").alias("_gy"), F.col("gx").alias("_gx"))
        left = staged(left.select("*", *here).join(under, [*keys, "_gy", "_gx"], "left_semi").drop("_gy", "_gx"), "points")
    truncated = F.col("n") >= ceiling
    why = F.when(truncated, blocker(root, max_depth))
    return tiles.select(
        *keys, "depth", "gy", "gx",
        F.col("n").alias("item_count"),
        truncated.alias("truncated"),
        (truncated & why.isNull()).alias("split"),
        why.alias("split_blocked_by"),
    )


def _kind(max_depth: int) -> str:
    return "int" if max_depth <= INT_DEPTH else "long"


def _place(at: int, max_depth: int) -> list[Column]:
    kind = _kind(max_depth)
    return [F.lit(at).cast("int").alias("depth"), F.lit(0).cast(kind).alias("gy"), F.lit(0).cast(kind).alias("gx")]


def _cell_at(depth: int, name: str, root: dict, max_depth: int) -> Column:
    side = "lat" if name == "gy" else "lng"
    return _index(F.col(side), root[f"sw_{side}"], root[f"ne_{side}"], depth).cast(_kind(max_depth))


def _counts(points: DataFrame, root: dict, keys: list[str], base: int, top: int) -> DataFrame:
    """Points per cell of the levels `base` to `top`."""
    cells = [_cell_at(top, c, root, top).alias(c) for c in ("gy", "gx")]
    finest = points.select(*keys, *cells).groupBy(*keys, "gy", "gx").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")
    shifted = [F.expr(f"shiftright({c}, {top} - depth)").alias(c) for c in ("gy", "gx")]
    every = finest.select(*keys, "gy", "gx", "n", levels).select(*keys, "depth", *shifted, "n")
    return every.groupBy(*keys, "depth", "gy", "gx").agg(F.sum("n").alias("n"))


def _split(root: dict, max_depth: int, ceiling: int) -> Column:
    return (F.col("n") >= ceiling) & blocker(root, max_depth).isNull()


def _children(
    counts: DataFrame, tops: DataFrame, root: dict, keys: list[str], base: int, top: int, max_depth: int, ceiling: int
) -> DataFrame:
    """The four children of every split tile from `tops`, at level `base`, down to level `top`.

    Empty ones are included. A tile above holds at least the points of a tile below it, and
    a tile that cannot be split has none below that can, so a parent to split means that
    every ancestor was split as well.
    """
    kind = _kind(max_depth)
    cell_of = [*keys, "depth", "gy", "gx"]
    counts = counts.select(*keys, "depth", *[F.col(c).cast(kind).alias(c) for c in ("gy", "gx")], "n")
    parents = counts.filter(F.col("depth") > base).unionByName(tops.select(*cell_of, "n"))
    split = parents.filter(_split(root, max_depth, ceiling) & (F.col("depth") < top))
    children = F.inline(
        F.array(
            *[
                F.struct((F.col("gy") * 2 + dy).alias("gy"), (F.col("gx") * 2 + dx).alias("gx"))
                for dy in (0, 1)
                for dx in (0, 1)
            ]
        )
    )
    below = split.select(*keys, (F.col("depth") + 1).alias("depth"), children)
    return below.join(counts, cell_of, "left").select(
        *keys, "depth", *[F.col(c).cast(kind).alias(c) for c in ("gy", "gx")], F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def call_cost() -> Column:
    """Calls to read a tile: a page per 20 results up to 60, one page for an empty tile."""
    pages = F.ceil(F.least("item_count", F.lit(V.RESULT_CEILING)) / V.PAGE_SIZE)
    return F.greatest(pages, F.lit(1)).cast("long")


def sweep_path() -> Column:
    """The quadrants from the root to a tile as digits; a parent sorts before its children.

    Compared as text this is the order of a sweep: a tile, then its south-west,
    south-east, north-west and north-east quarters, each with all below it.
    """
    digits = F.transform(
        F.sequence(F.lit(1), F.greatest("depth", F.lit(1))),
        lambda k: F.getbit(F.col("gy"), F.col("depth") - k) * 2 + F.getbit(F.col("gx"), F.col("depth") - k),
    )
    return F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(digits.cast("array<string>"), ""))


def budgeted_sweep(
    tiles: DataFrame, max_calls: int, root: dict, max_depth: int, cached: DataFrame | None = None
) -> DataFrame:
    """What is left of a sweep when it stops as soon as `max_calls` are spent.

    Terms go in order of their name, each through its tree. A tile is searched if calls
    are left when its turn comes; the last one gets the pages that are left, and is
    truncated when those are not all of its own. It is no longer split, for that takes
    calls (`halted`, unless something else forbids it already). Tiles whose keys `cached`
    holds cost nothing. The result has every tile that the sweep searched, and with
    `searched` false those it was on its way to; nothing below them is known.
    """
    at = ["term", "depth", "gy", "gx"]
    costed = tiles.withColumn("calls", call_cost())
    if cached is not None:
        keyed = with_corners(costed, root).select(*costed.columns, "tile_key")
        hit = cached.select("tile_key").distinct().withColumn("_hit", F.lit(True))
        costed = keyed.join(hit, "tile_key", "left").withColumn("calls", F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("calls"))).drop("_hit", "tile_key")
    placed = running_total(costed.withColumn("path", sweep_path()), ["term", "path"], "calls", "calls_before")
    granted = F.least("calls", F.greatest(F.lit(max_calls) - F.col("calls_before"), F.lit(0)))
    searched = F.col("calls_before") < max_calls
    placed = placed.select(*tiles.columns, "path", "calls", "calls_before", granted.alias("granted"), searched.alias("searched"))
    cut = F.col("granted") < F.col("calls")
    spent = F.col("calls_before") + F.col("granted") >= max_calls
    truncated = F.col("truncated") | (F.col("searched") & cut)
    why = F.when(truncated, F.coalesce(blocker(root, max_depth), F.when(spent, F.lit("halted"))))
    placed = staged(
        placed.select(
            *at, F.when(cut, F.col("granted") * V.PAGE_SIZE).otherwise(F.col("item_count")).alias("item_count"),
            truncated.alias("truncated"), (truncated & why.isNull()).alias("split"), why.alias("split_blocked_by"),
            "path", F.col("granted").alias("calls"), "calls_before", "searched",
        ),
        "sweep",
    )
    # a tile that was not searched was due if its parent was searched and split
    parents = placed.filter("searched AND split").select(
        "term", (F.col("depth") + 1).alias("depth"), F.col("gy").alias("_gy"), F.col("gx").alias("_gx")
    )
    refused = placed.filter("NOT searched AND depth > 0").withColumns({"_gy": F.shiftright("gy", 1), "_gx": F.shiftright("gx", 1)})
    due = refused.join(parents, ["term", "depth", "_gy", "_gx"], "left_semi").drop("_gy", "_gx")
    unknown = {c: F.lit(None).cast(t) for c, t in placed.dtypes if c in ("item_count", "truncated", "split", "calls")}
    waiting = due.unionByName(placed.filter("NOT searched AND depth = 0")).withColumns(unknown).withColumn("split_blocked_by", F.lit(None).cast("string"))
    return placed.filter("searched").unionByName(waiting.select(placed.columns))


def with_corners(tiles: DataFrame, root: dict) -> DataFrame:
    """Corner coordinates and the cache key of every tile."""
    side = F.pow(F.lit(2.0), F.col("depth"))
    step_lat = F.lit(root["ne_lat"] - root["sw_lat"]) / side
    step_lng = F.lit(root["ne_lng"] - root["sw_lng"]) / side
    boxed = tiles.select(
        "*",
        (F.lit(root["sw_lat"]) + F.col("gy") * step_lat).alias("sw_lat"),
        (F.lit(root["sw_lng"]) + F.col("gx") * step_lng).alias("sw_lng"),
        (F.lit(root["sw_lat"]) + (F.col("gy") + 1) * step_lat).alias("ne_lat"),
        (F.lit(root["sw_lng"]) + (F.col("gx") + 1) * step_lng).alias("ne_lng"),
    )
    key = tile_key(F.col("term"), *[F.col(c) for c in ("sw_lat", "sw_lng", "ne_lat", "ne_lng")])
    return boxed.withColumn("tile_key", key)


def sweep_summary(tiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Tiles searched and split, deepest level, blind spots, and whether it was halted.

    A sweep was halted if a tile was due and not searched (`searched` of `budgeted_sweep`).
    """
    searched = F.col("searched") if "searched" in tiles.columns else F.lit(True)
    return tiles.groupBy(*by).agg(
        F.count_if(searched).alias("tiles_searched"),
        F.count_if(searched & F.col("split")).alias("tiles_split"),
        F.coalesce(F.max(F.when(searched, F.col("depth"))), F.lit(0)).alias("deepest"),
        F.count_if(searched & F.col("truncated") & ~F.col("split")).alias("truncated_leaves"),
        F.bool_or(~searched).alias("halted"),
    )


def tile_plan(tiles: DataFrame, by: tuple[str, ...] = ("term",)) -> DataFrame:
    """Calls a sweep costs: pages per visited tile, one for an empty one."""
    calls = F.sum(call_cost())
    return tiles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tiles"),
        calls.cast("long").alias("calls"),
        (calls * V.USD_PER_1000_CALLS / 1000).cast("double").alias("estimated_cost_usd"),
    )


def usable_cache(cache: DataFrame) -> DataFrame:
    """Cache entries with both a time and a list of places."""
    return cache.filter("at IS NOT NULL AND places IS NOT NULL")


def fresh(cache: DataFrame, now: Column, ttl_days: int = V.CACHE_TTL_DAYS) -> DataFrame:
    """Entries younger than the limit; an unreadable time counts as old."""
    return usable_cache(cache).filter(age_below(F.try_to_timestamp("at"), now, ttl_days))


def cache_hits(planned: DataFrame, cache: DataFrame, now: Column, **ttl) -> DataFrame:
    return planned.join(fresh(cache, now, **ttl).select("tile_key"), "tile_key", "left_semi")


def tiles_to_pay(planned: DataFrame, cache: DataFrame, now: Column, **ttl) -> DataFrame:
    """Planned tiles without a fresh cached answer."""
    return planned.join(fresh(cache, now, **ttl).select("tile_key"), "tile_key", "left_anti")


def _answers(answers: DataFrame, source: str) -> DataFrame:
    """One answer per key (tile_key, places, truncated), the newest where a key has several."""
    newest = F.struct(F.try_to_timestamp("at").alias("at"), F.size("places").alias("n")) if "at" in answers.columns else F.size("places")
    kept = F.struct("places", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    one = answers.groupBy("tile_key").agg(F.max_by(kept, newest).alias("_a"))
    return one.select("tile_key", "_a.places", "_a.truncated", F.lit(source).alias("source"))


def cache_replay(planned: DataFrame, cache: DataFrame, fetched: DataFrame, now: Column, **ttl) -> DataFrame:
    """The answer of every planned tile: `planned` with places, truncated and source.

    A tile with a fresh cache entry is `cached`: its places and whether it was truncated
    are taken from there and it costs no call. Of the others those in `fetched`
    (tile_key, places, truncated) are `paid`; the rest were not reached and have no
    answer (source NULL), so that the next run pays for them.
    """
    held = _answers(fresh(cache, now, **ttl), "cached")
    paid = _answers(fetched, "paid").join(held.select("tile_key"), "tile_key", "left_anti")
    return planned.join(held.unionByName(paid), "tile_key", "left")


def replayed_batches(replayed: DataFrame) -> DataFrame:
    """The places of answered tiles, one row each, in the order of the answer (`pos`)."""
    kept = [c for c in replayed.columns if c not in ("places", "truncated")]
    return replayed.filter("source IS NOT NULL").select(*kept, F.posexplode("places").alias("pos", "place"))


def cache_use(replayed: DataFrame, by: tuple[str, ...] = ("term",)) -> DataFrame:
    """Tiles served from the cache, paid for, and not reached."""
    return replayed.groupBy(*by).agg(
        F.count_if(F.col("source") == "cached").alias("hits"),
        F.count_if(F.col("source") == "paid").alias("misses"),
        F.count_if(F.col("source").isNull()).alias("not_reached"),
    )


def cache_next(cache: DataFrame, fetched: DataFrame, now: Column, **ttl) -> DataFrame:
    """The cache after a run: what is still fresh, and under their keys the new answers.

    Old and broken entries go. `at` is text in ISO form, as it is read back.
    """
    at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    new = _answers(fetched, "paid").select("tile_key", at.alias("at"), "places", "truncated")
    old = fresh(cache, now, **ttl).join(new.select("tile_key"), "tile_key", "left_anti")
    return old.select("tile_key", "at", "places", F.coalesce("truncated", F.lit(False)).alias("truncated")).unionByName(new)


def flush_cache(spark: SparkSession, folder: str, fetched: DataFrame, now: Column, batch: str, **ttl) -> DataFrame:
    """Write a run's answers into the cache kept at `folder` and return it.

    Only the buckets that get an answer or lose an entry are written again; the others
    stay as files of older versions. A run with a batch name seen before changes nothing.
    """
    cache = Snapshot(spark, folder, "tile_key", CACHE_BUCKETS)
    held = cache.read()
    if held is None:
        empty = fetched.select("tile_key", F.lit("").alias("at"), "places", "truncated").limit(0)
        cache.commit(cache_next(empty, fetched, now, **ttl), None, batch)
        return cache.read()
    gone = held.join(fresh(held, now, **ttl).select("tile_key"), "tile_key", "left_anti")
    touched = cache.buckets_of(fetched.select("tile_key").unionByName(gone.select("tile_key")))
    if touched:
        cache.commit(cache_next(cache.read(touched), fetched, now, **ttl), touched, batch)
    return cache.read()
