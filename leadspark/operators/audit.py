"""Site audits from captured pages and robots files."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import html as H
from ..functions.derive import blank, first_match
from ..functions.robots import allowed, longest_match, wildcard_rules
from ..sources.stage import staged
from .skew import ROWS_PER_TASK, join_by_key

def scan_page_captures(captures: DataFrame) -> DataFrame:
    """Captured pages with the body kept only where it is a page."""
    return captures.withColumn("html", H.wanted_body(F.col("html"), F.col("content_type")))


def parse_robots(robots: DataFrame) -> DataFrame:
    """Rules per origin; a file that was not served as text gives none."""
    body = H.wanted_body(F.col("text"), F.col("content_type"), "text")
    usable = F.col("http_status").between(200, 299) & (body != "")
    none = F.array().cast("array<string>")
    return robots.select(
        "origin",
        F.when(usable, wildcard_rules(body, "disallow")).otherwise(none).alias("disallow"),
        F.when(usable, wildcard_rules(body, "allow")).otherwise(none).alias("allow"),
    )


def robots_rules_long(robots: DataFrame) -> DataFrame:
    """The same rules, one per row."""
    rules = parse_robots(robots)
    return rules.select("origin", F.lit("disallow").alias("kind"), F.explode("disallow").alias("rule")).unionByName(
        rules.select("origin", F.lit("allow").alias("kind"), F.explode("allow").alias("rule"))
    )


def _rules_by_head(robots: DataFrame) -> DataFrame:
    """(origin, head, plain_disallow, plain_allow, disallow, allow): rules by the text before their first `*` or final `$`.

    A rule without either is plain: it matches every path that begins with its head. Of the
    others the array holds the rules as written.
    """
    body = F.regexp_replace("rule", r"\$$", "")
    rules = robots_rules_long(robots).distinct().withColumn("head", F.substring_index(body, "*", 1))
    plain = F.col("head") == F.col("rule")

    def any_plain(kind):
        return F.bool_or(plain & (F.col("kind") == kind)).alias(f"plain_{kind}")

    def others(kind):
        return F.collect_list(F.when(~plain & (F.col("kind") == kind), F.col("rule"))).alias(kind)

    return rules.groupBy("origin", "head").agg(any_plain("disallow"), any_plain("allow"), others("disallow"), others("allow"))


def robots_match(
    paths: DataFrame, robots: DataFrame, row_id: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """`paths` (origin, path) with the verdict of its origin's rules.

    Rules are rows keyed by their literal beginning, and each distinct path of an origin
    meets them through its own beginnings of the lengths that occur there, by an equal
    join. So an origin with very many rules is many keys, not one wide row, and only rules
    with a `*` or `$` behind a matching beginning are tried. Keys that very many rows share
    are salted. An origin without a file allows everything; so does a null path.
    """
    dim = staged(_rules_by_head(robots), "robots-rules")
    lengths = dim.groupBy("origin").agg(F.collect_set(F.length("head")).alias("lengths"))
    asked = paths.select("origin", "path").filter("origin IS NOT NULL AND path IS NOT NULL").distinct()
    sized = join_by_key(asked, lengths, ["origin"], "path", rows_per_task=rows_per_task)
    reach = F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")
    probes = sized.select("origin", "path", reach).select("origin", "path", F.left("path", F.col("n")).alias("head"))
    met = join_by_key(probes, dim, ["origin", "head"], "path", rows_per_task=rows_per_task)

    def longest(kind):
        own = F.when(F.col(f"plain_{kind}"), F.length("head")).otherwise(-1)
        return F.max(F.greatest(own, longest_match(F.coalesce(kind, F.array().cast("array<string>")), F.col("path")))).alias(kind)

    verdicts = met.groupBy("origin", "path").agg(longest("disallow"), longest("allow"))
    denied = verdicts.filter("disallow >= 0 AND allow < disallow").select("origin", "path", F.lit(True).alias("denied"))
    joined = join_by_key(paths, denied, ["origin", "path"], row_id, rows_per_task=rows_per_task)
    return joined.withColumn("allowed", F.col("denied").isNull()).drop("denied")


def extract_emails(pages: DataFrame) -> DataFrame:
    """Ranked addresses per page; `site_host` NULL keeps every plausible one."""
    return pages.withColumn("emails", H.extract_emails(F.col("html"), F.col("site_host")))


def contact_links(pages: DataFrame, limit: int | None = 2) -> DataFrame:
    return pages.withColumn("links", H.contact_links(F.col("html"), H.parse_url(F.col("url")), limit))


def audit_page(captures: DataFrame) -> DataFrame:
    """Facts of one captured page on its own."""
    body = H.wanted_body(F.col("html"), F.col("content_type"))
    up = H.reachable(F.col("http_status"))
    judged = (up == "yes") & (body != "")

    def tri(cond):
        return F.when(judged, H.yes_no(cond)).otherwise(F.lit("unknown"))

    return captures.select(
        *[c for c in captures.columns if c not in ("html", "content_type", "ttfb_ms", "error")],
        up.alias("reachable"),
        H.yes_no(F.col("final_url").rlike("(?i)^https:")).alias("https"),
        F.when(up == "yes", F.col("ttfb_ms")).alias("ttfb_ms"),
        tri(H.has_viewport(body)).alias("viewport"),
        F.when(judged & H.has_contact_form(body), F.lit("yes"))
        .otherwise(F.lit("unknown"))
        .alias("contact_form"),
    )


def audit_site(sites: DataFrame, captures: DataFrame, robots: DataFrame) -> DataFrame:
    """Whole-site verdict per place from its captured pages.

    `sites` has one row per place (place_id, website). `captures` holds the pages
    by role: `home`, `home_https` (the retry) and `contact`. A capture without a
    status is a failed connection. The facts of a capture are read in its own row;
    only they, never the page text, are grouped and joined.
    """
    start = _with_rules(
        sites.select("place_id", "website", H.parse_url(F.col("website")).alias("at")), robots
    )
    homes = _home_facts(captures).groupBy("place_id").agg(
        _any_of(F.col("page"), "home").alias("home"), _any_of(F.col("page"), "home_https").alias("home_https")
    )
    seen = start.join(homes, "place_id", "left")

    parseable = F.col("at.href").isNotNull()
    open_here = F.when(F.col("at.scheme") == "https", F.col("open_https")).otherwise(F.col("open_http"))
    tried = parseable & open_here
    direct = tried & F.col("home.http_status").isNotNull()
    retry = (
        tried
        & F.col("home.http_status").isNull()
        & (F.col("at.scheme") == "http")
        & F.col("open_https")
        & F.col("home_https.http_status").isNotNull()
    )
    on_https = retry | (F.col("at.scheme") == "https")
    chosen = F.when(direct, F.col("home")).when(retry, F.col("home_https"))
    rules = F.when(on_https, F.col("https_rules")).otherwise(F.col("http_rules"))
    fetched = seen.select(
        "place_id", "website", open_here.alias("open_here"), parseable.alias("parseable"),
        chosen.alias("page"), F.col("home.error").alias("failure"), rules.alias("rules"),
    )

    status = F.col("page.http_status")
    up = H.reachable(status)
    loaded = (up == "yes") & F.col("page.has_body")
    judged = fetched.select(
        "place_id", "website", "open_here", "parseable", "rules", "failure",
        status.alias("http_status"),
        F.col("page.url").alias("final_url"),
        F.when(F.col("page").isNull(), F.lit("no")).otherwise(up).alias("up"),
        F.coalesce(loaded, F.lit(False)).alias("loaded"),
        F.when(up == "yes", F.col("page.ttfb_ms")).alias("ttfb_ms"),
        F.col("page.site_host").alias("site_host"),
        F.col("page.viewport").alias("viewport"),
        F.col("page.form").alias("form"),
        F.when(loaded, F.col("page.emails")).alias("home_emails"),
        F.when(loaded, F.col("page.links")).alias("links"),
    )
    # Read twice below.
    return _with_contact_pages(staged(judged, "site-audit"), captures)


def _home_facts(captures: DataFrame) -> DataFrame:
    """(place_id, role, link_no, page): what a home capture says, without its text."""
    body = H.wanted_body(F.col("html"), F.col("content_type"))
    read = captures.filter(F.col("role").isin("home", "home_https")).select(
        "place_id", "role", "link_no", "http_status", "ttfb_ms", "error",
        F.coalesce("final_url", "url").alias("url"),
        body.alias("body"),
        H.parse_url(F.coalesce("final_url", "url")).alias("ended"),
    )
    site_host = H.bare_host(F.col("ended.host"))
    facts = F.struct(
        "http_status", "url", "ttfb_ms", "error",
        (F.col("body") != "").alias("has_body"),
        site_host.alias("site_host"),
        H.has_viewport(F.col("body")).alias("viewport"),
        H.has_contact_form(F.col("body")).alias("form"),
        H.rank_emails(H.email_candidates(F.col("body")), site_host).alias("emails"),
        H.contact_links(F.col("body"), F.col("ended")).alias("links"),
    )
    return read.select("place_id", "role", "link_no", facts.alias("page"))


def _any_of(page, role):
    """The capture of a role; the latest numbered one if there are several."""
    return F.max_by(F.when(F.col("role") == role, page), F.when(F.col("role") == role, F.coalesce("link_no", F.lit(0))))


def _with_rules(start: DataFrame, robots: DataFrame) -> DataFrame:
    """Adds the rules of both schemes of a site's host and their verdicts.

    The two origins of one host share a row, so one join serves both.
    """
    rules = F.struct("disallow", "allow")
    secure = F.startswith(F.col("origin"), F.lit("https:"))
    dim = (
        parse_robots(robots)
        .groupBy(F.regexp_replace("origin", "^https?://", "").alias("_host"))
        .agg(F.max(F.when(~secure, rules)).alias("http_rules"), F.max(F.when(secure, rules)).alias("https_rules"))
    )
    spread = F.concat(F.lit("\u0000"), F.col("place_id"))
    host = F.when(
        F.col("at.href").isNotNull(), F.regexp_replace(F.col("at.origin"), "^https?://", "")
    )
    keyed = start.withColumn("_host", F.coalesce(host, spread))
    joined = join_by_key(keyed, dim, ["_host"], "place_id").drop("_host")

    def verdict(name):
        return allowed(F.col(f"{name}.disallow"), F.col(f"{name}.allow"), F.col("at.path"))

    return joined.select(
        "*", verdict("http_rules").alias("open_http"), verdict("https_rules").alias("open_https")
    )


def _with_contact_pages(judged: DataFrame, captures: DataFrame) -> DataFrame:
    """Follow at most two contact links where the home page gave no address."""
    wants = F.col("loaded") & (F.size("home_emails") == 0)
    to_read = judged.filter(wants).select(
        "place_id", "site_host", "rules", F.posexplode("links").alias("link_pos", "link")
    )
    latest = Window.partitionBy("place_id", "link").orderBy(F.desc("link_no"))
    body = H.wanted_body(F.col("html"), F.col("content_type"))
    pages = (
        captures.filter("role = 'contact'")
        .select(
            "place_id",
            H.parse_url(F.col("url"))["href"].alias("link"),
            "link_no",
            F.col("http_status").isNotNull().alias("answered"),
            (body != "").alias("has_body"),
            H.has_form(body).alias("form"),
            H.email_candidates(body).alias("candidates"),
        )
        .withColumn("_rank", F.row_number().over(latest))
        .filter("_rank = 1")
        .drop("_rank", "link_no")
    )
    open_link = allowed(F.col("rules.disallow"), F.col("rules.allow"), H.parse_url(F.col("link"))["path"])
    read = to_read.join(pages, ["place_id", "link"], "left").select(
        "place_id",
        F.struct(
            "link_pos",
            open_link.alias("open"),
            F.coalesce("answered", F.lit(False)).alias("answered"),
            F.coalesce("has_body", F.lit(False)).alias("has_body"),
            F.coalesce("form", F.lit(False)).alias("form"),
            F.coalesce(
                H.rank_emails(F.col("candidates"), F.col("site_host")), F.array().cast("array<string>")
            ).alias("emails"),
        ).alias("visit"),
    )
    # Two visits per place at most, by the limit on links.
    visits = read.groupBy("place_id").agg(F.array_sort(F.collect_list("visit")).alias("visits"))

    def step(acc, v):
        go = ~acc["done"]
        readable = go & v["open"] & v["answered"]
        useful = readable & v["has_body"]
        hit = useful & (F.size(v["emails"]) > 0)
        return F.struct(
            F.when(useful, F.array_union(acc["emails"], v["emails"])).otherwise(acc["emails"]).alias("emails"),
            (acc["form"] | (useful & v["form"])).alias("form"),
            (acc["skipped"] | (go & ~useful) | hit).alias("skipped"),
            (acc["done"] | hit).alias("done"),
            (acc["fetched"] + F.when(readable, 1).otherwise(0)).alias("fetched"),
        )

    empty = F.array().cast("array<string>")
    start = F.struct(
        F.coalesce("home_emails", empty).alias("emails"),
        F.coalesce("form", F.lit(False)).alias("form"),
        F.lit(False).alias("skipped"),
        F.lit(False).alias("done"),
        F.lit(0).alias("fetched"),
    )
    walked = judged.join(visits, "place_id", "left").withColumn(
        "w", F.aggregate(F.coalesce("visits", F.array().cast(visits.schema["visits"].dataType)), start, step)
    )

    listed = ~blank("website")
    blocked = listed & F.col("parseable") & ~F.col("open_here")
    answered = F.col("http_status").isNotNull()
    complete = F.col("loaded") & wants & ~F.col("w.skipped")
    unknown = F.lit("unknown")
    return walked.select(
        "place_id",
        F.when(listed, F.col("website")).alias("input_url"),
        F.when(answered, F.col("final_url")).alias("final_url"),
        F.when(blocked, unknown).otherwise(F.col("up")).alias("reachable"),
        F.when(answered, H.yes_no(F.col("final_url").rlike("(?i)^https:"))).otherwise(unknown).alias("https"),
        "ttfb_ms",
        F.when(F.col("loaded"), H.yes_no(F.col("viewport"))).otherwise(unknown).alias("viewport"),
        first_match(
            [
                (F.col("loaded") & F.col("w.form"), F.lit("yes")),
                (complete, F.lit("no")),
            ],
            unknown,
        ).alias("contact_form"),
        F.when(F.col("loaded"), F.slice("w.emails", 1, 3)).otherwise(empty).alias("emails"),
        F.when(answered, F.lit(1) + F.col("w.fetched")).otherwise(F.lit(0)).alias("pages_fetched"),
        "http_status",
        first_match(
            [
                (~listed, F.lit("no website listed")),
                (~F.col("parseable"), F.concat(F.lit("unparseable url: "), F.col("website"))),
                (blocked, F.lit("robots.txt disallows this path")),
                (
                    ~answered & F.contains("failure", F.lit("abort")),
                    F.lit(f"timeout after {V.AUDIT_TIMEOUT_MS}ms"),
                ),
                (~answered, F.substring("failure", 1, 160)),
            ],
            F.lit(None).cast("string"),
        ).alias("error"),
        blocked.alias("robots_blocked"),
    )
