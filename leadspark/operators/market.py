"""What a market looks like, and the sentences that quote it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V, wording as W
from ..functions.clock import check_date
from ..functions.derive import blank, first_match, has_signal
from .leads import upper_median
from .skew import ROWS_PER_TASK, join_by_key

MARKET = ["market", "niche"]


def corpus(leads: DataFrame, by: list[str] = MARKET, *more: Column) -> DataFrame:
    """Counts over audited leads; viewport and https only where the site loaded.

    `leads` is the size of the whole group, audited or not; `more` are aggregates taken
    in the same pass.
    """
    up, down = F.col("reachable") == "yes", F.col("reachable") == "no"
    return leads.groupBy(*by).agg(
        F.count_if(up | down).alias("n"),
        F.count_if(up).alias("up"),
        F.count_if(down).alias("down"),
        upper_median("ttfb_ms", "reachable = 'yes'").alias("median_ttfb_ms"),
        F.max(F.when(up, F.col("ttfb_ms"))).alias("slowest_ms"),
        F.count_if(up & (F.col("viewport") == "yes")).alias("viewport_ok"),
        F.count_if(up & (F.col("viewport") == "no")).alias("viewport_bad"),
        F.count_if(up & (F.col("https") == "yes")).alias("https_ok"),
        F.count_if(up & (F.col("https") == "no")).alias("https_bad"),
        F.count(F.lit(1)).alias("leads"),
        *more,
    )


def ttfb_median(leads: DataFrame, by: list[str] = MARKET) -> DataFrame:
    return leads.filter("reachable = 'yes' AND ttfb_ms IS NOT NULL").groupBy(*by).agg(
        upper_median("ttfb_ms").alias("median_ttfb_ms")
    )


def slowest(leads: DataFrame, by: list[str] = MARKET) -> DataFrame:
    return leads.filter("reachable = 'yes' AND ttfb_ms IS NOT NULL").groupBy(*by).agg(
        F.max("ttfb_ms").alias("slowest_ms")
    )


def join_corpus(
    leads: DataFrame, by: list[str] = MARKET, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Every lead beside the `corpus` of its own market and niche."""
    stats = corpus(leads, by)
    packed = stats.select(*by, F.struct(*[c for c in stats.columns if c not in by]).alias("corpus"))
    counts = stats.select(*by, F.col("leads").alias("n"))
    return join_by_key(leads, packed, by, "place_id", counts=counts, rows_per_task=rows_per_task, null_safe=True)


# ---------------------------------------------------------------- hook


def _observation(checked_on: Column) -> Column:
    """The measured finding, the costliest first; NULL when there is none."""
    when = F.coalesce(F.concat(F.lit(" when we checked on "), checked_on), F.lit(""))
    reviews = F.coalesce("reviews", F.lit(0))
    established = F.coalesce(
        (F.col("rating") >= V.GOOD_RATING) & (reviews > 0) & ~has_signal("thin-reviews"),
        F.lit(False),
    )
    standing = F.concat(
        W.counted(reviews, "review", "reviews"), F.format_string(" at %.1f stars", F.col("rating"))
    )
    took = F.concat(
        F.lit(" — about "), W.seconds(F.col("ttfb_ms")), F.lit(" seconds before anything appears")
    )
    lines = {
        "no-site": F.when(
            established,
            F.concat(F.lit("You have "), standing, F.lit(" on Google and no website to send any of it to.")),
        ).otherwise(
            F.lit("You are listed on Google Maps with no website attached, so everyone who looks you up stops at the listing.")
        ),
        "down": F.concat(
            F.lit("Your website did not load"), when,
            F.lit(" — a search for you currently ends at an error page."),
        ),
        "no-viewport": F.concat(
            F.lit("Your site was not built for phones"), when,
            F.lit(" — it renders desktop-width on a handset."),
        ),
        "insecure": F.concat(
            F.lit("Your site was still on http"), when,
            F.lit(', so browsers mark it "Not secure" before anyone reads a word.'),
        ),
        "slow": F.concat(
            F.lit("Your site was slow to respond"), when,
            F.when(F.col("ttfb_ms").isNotNull(), took).otherwise(F.lit("")), F.lit("."),
        ),
        "no-contact-form": F.concat(
            F.lit("Your site had no way to send an enquiry"), when,
            F.lit(" — a visitor who is not ready to ring has nothing to do next."),
        ),
    }
    return first_match([(has_signal(s), lines[s]) for s in V.HOOK_PRIORITY], F.lit(None))


def hook(niche: Column, checked_on: Column) -> Column:
    """Struct of text, audience, basis and reason; reads lead columns."""
    subject = F.when(F.coalesce(niche, F.lit("")) == "", F.col("primary_type")).otherwise(niche)
    audience = W.audience(subject)
    unaudited = ~F.col("audited") & ~blank("website")
    line = F.when(~unaudited, _observation(checked_on))
    basis = first_match([(has_signal(s), F.lit(s)) for s in V.HOOK_PRIORITY], F.lit("none"))
    return F.struct(
        F.coalesce(F.concat(line, F.lit(" "), W.stakes(audience)), F.lit("")).alias("text"),
        audience.alias("audience"),
        F.when(line.isNull(), F.lit("none")).otherwise(basis).alias("basis"),
        F.when(unaudited, F.lit(V.REASON_NOT_AUDITED))
        .when(line.isNull(), F.lit(V.REASON_NO_GAP))
        .alias("reason"),
    )


def with_hook(leads: DataFrame) -> DataFrame:
    """Adds `hook` from the lead's own niche and `checked_at`."""
    return leads.withColumn("hook", hook(F.col("niche"), check_date(F.col("checked_at"))))


def hook_coverage(hooked: DataFrame) -> DataFrame:
    """Leads per basis of their line, `no hook` for the rest."""
    basis = F.when(F.col("hook.text") != "", F.col("hook.basis")).otherwise(F.lit("no hook"))
    return hooked.groupBy(basis.alias("basis")).agg(F.count(F.lit(1)).alias("leads"))


# ---------------------------------------------------------------- benchmark


def benchmark(market: Column, niche_label: Column) -> Column:
    """The comparison with the lead's own `corpus`, or ''.

    It follows the same order as the hook, and speaks only when both sides of the
    comparison were measured and run the way the sentence says.
    """
    c = {f: F.col(f"corpus.{f}") for f in (
        "n", "up", "down", "median_ttfb_ms", "viewport_ok", "viewport_bad", "https_ok", "https_bad",
    )}

    def say(condition, *parts):
        text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        return F.when(condition, text).otherwise(F.lit(""))

    def n(name):
        return c[name].cast("string")

    down = say(
        c["down"] > 0,
        "We checked ", n("n"), " ", niche_label, " across ", market, ". ", n("up"),
        " had a site that loaded. Yours was one of the ", n("down"), " that didn't.",
    )
    phone = say(
        (c["viewport_bad"] > 0) & (c["viewport_ok"] > 0),
        n("viewport_ok"), " of the ", n("up"), " sites we checked in ", market,
        " render properly on a phone. Yours is one of the ", n("viewport_bad"), " that don't.",
    )
    https = say(
        (c["https_bad"] > 0) & (c["https_ok"] > 0),
        n("https_ok"), " of the ", n("up"), " sites we checked in ", market,
        " are on HTTPS. Yours is one of the ", n("https_bad"), " that aren't.",
    )
    slow = say(
        F.coalesce(F.col("ttfb_ms") > c["median_ttfb_ms"], F.lit(False)),
        "Across the ", n("up"), " sites in ", market, " that loaded, the median was ",
        W.seconds(c["median_ttfb_ms"]), " seconds. Yours was ", W.seconds(F.col("ttfb_ms")), " seconds.",
    )
    none = F.lit("")
    return first_match(
        [
            (F.coalesce(c["n"] < V.MIN_CORPUS, F.lit(True)), none),
            (has_signal("no-site"), none),
            (has_signal("down"), down),
            (has_signal("no-viewport"), phone),
            (has_signal("insecure"), https),
            (has_signal("slow"), slow),
        ],
        none,
    )


def letter_market(location: Column) -> Column:
    """Location as a reader names it, with one state spelled out."""
    named = F.regexp_replace(W.title_case(location), " Pa$", ", PA")
    return F.when(F.coalesce(location, F.lit("")) == "", F.lit("your market")).otherwise(named)


def letter_niche(niche: Column) -> Column:
    label = F.concat(F.regexp_replace(niche, "-", " "), F.lit(" companies"))
    return F.when(F.coalesce(niche, F.lit("")) == "", F.lit("businesses")).otherwise(label)


def with_benchmark(leads_with_corpus: DataFrame) -> DataFrame:
    return leads_with_corpus.withColumn(
        "benchmark", benchmark(letter_market(F.col("market")), letter_niche(F.col("niche")))
    )


def market_findings(c=lambda name: F.col(name)) -> Column:
    """The corpus as one paragraph: number agreement kept, zero faults left out."""
    median = F.concat(W.seconds(F.coalesce(c("median_ttfb_ms"), F.lit(0))), F.lit(" seconds"))
    worth_saying = c("slowest_ms").isNotNull() & ~c("slowest_ms").eqNullSafe(c("median_ttfb_ms"))
    typical = F.concat(
        F.lit("Of the "), c("up").cast("string"), F.lit(" that did, the typical one answered in about "),
        median,
        F.when(
            worth_saying,
            F.concat(F.lit(", and the slowest took "), W.seconds(c("slowest_ms")), F.lit(" seconds.")),
        ).otherwise(F.lit(".")),
    )
    loaded = F.when(
        c("up") == 1, F.concat(F.lit("Of the one that did, it answered in about "), median, F.lit("."))
    ).otherwise(typical)
    phones = F.when(
        c("viewport_bad") > 0,
        F.concat(W.counted(c("viewport_bad"), "was", "were"), F.lit(" still not built for phones")),
    )
    plain = F.when(
        c("https_bad") > 0,
        F.concat(
            W.counted(c("https_bad"), "was", "were"),
            F.lit(' still on http, which browsers mark "Not secure" before anyone reads a word'),
        ),
    )
    clauses = F.concat_ws(", and ", phones, plain)
    return F.concat(
        c("down").cast("string"), F.lit(" of those "), c("n").cast("string"),
        F.lit(" sites did not load at all. "), loaded,
        F.when(clauses != "", F.concat(F.lit(" Another "), clauses, F.lit("."))).otherwise(F.lit("")),
    )


# ---------------------------------------------------------------- letters


def _slots(slots: dict | None) -> dict:
    return V.SLOTS | (slots or {})


def _offer(s: dict) -> str:
    return (
        f"I am {s['sender']} — I run {s['company']}. We build the site and the systems behind it, "
        "hand you the keys, and stay on call when something breaks. You own it outright. "
        "That is the whole model."
    )


def _optout(s: dict) -> str:
    return (
        f"If you would rather not hear from me, {s['unsubscribe']} and "
        "I will remove you permanently — one click, no reply needed."
    )


def _paragraphs(*parts) -> Column:
    """Paragraphs joined by an empty line; NULL ones are left out."""
    return F.concat_ws("\n\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def letters(leads: DataFrame, slots: dict | None = None) -> DataFrame:
    """Subject, recipient, body and footer per lead that has an honest opening.

    `leads` carries `hook`, `benchmark`, `market` and `checked_at`.
    """
    s = _slots(slots)
    name = F.col("name")
    checked = F.coalesce(check_date(F.col("checked_at")), F.lit("null"))
    subject = first_match(
        [
            (F.col("hook.basis") == "down", F.concat(name, F.lit(" — your site didn't load on "), checked)),
            (
                F.col("hook.basis") == "no-site",
                F.concat(F.coalesce("reviews", F.lit(0)).cast("string"), F.lit(" reviews, no website")),
            ),
            (
                F.col("hook.basis") == "slow",
                F.concat(name, F.lit(" takes "), W.seconds(F.coalesce("ttfb_ms", F.lit(0))), F.lit(" seconds to load")),
            ),
            (F.col("hook.basis") == "no-viewport", F.concat(name, F.lit(" on a phone"))),
            (F.col("hook.basis") == "insecure", F.concat(F.lit("browsers are flagging "), name)),
        ],
        name,
    )
    ask = F.concat(
        F.lit('I am not asking for a meeting. If you want it, reply "send it" and I will write up everything we found on '),
        name,
        F.lit(
            " — what we checked, what we measured, and what I would fix first. "
            "No charge, no call, and I will not follow up unless you ask me to."
        ),
    )
    body = _paragraphs(
        "Hi there,", F.col("hook.text"), F.nullif("benchmark", F.lit("")), _offer(s), ask,
        s["sender"], f"{s['role']}, {s['company']}", s["phone"],
    )
    why = F.concat(
        F.lit("You are getting this because "), name, F.lit(" is listed publicly in "),
        letter_market(F.col("market")), F.lit(" and its website is publicly reachable. "), F.lit(_optout(s)),
    )
    return leads.filter(F.col("hook.text") != "").select(
        "ord",
        "place_id",
        "market",
        "niche",
        F.col("hook.basis").alias("basis"),
        subject.alias("subject"),
        F.when(blank("email"), F.lit("— no public address found —")).otherwise(F.col("email")).alias("recipient"),
        body.alias("body"),
        _paragraphs(s["company"], s["address"], why).alias("footer"),
    )


def letter_rank(basis: Column) -> Column:
    """Print order of a basis; one that is not listed sorts first."""
    return F.array_position(F.array(*map(F.lit, V.LETTER_ORDER)), basis)


def letters_ordered(letters_df: DataFrame) -> DataFrame:
    return letters_df.withColumn("basis_rank", letter_rank(F.col("basis"))).orderBy("basis_rank", "ord")


def letter_coverage(hooked: DataFrame, by: list[str] = MARKET) -> DataFrame:
    """How many letters can be written per market, and what they rest on."""
    gap = F.col("hook.text") != ""
    per_basis = [
        F.count_if(gap & (F.col("hook.basis") == b)).alias("basis_" + b.replace("-", "_"))
        for b in V.HOOK_PRIORITY
    ]
    return hooked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("prospects"),
        F.count_if(F.col("reachable").isin("yes", "no")).alias("audited"),
        F.count_if(gap).alias("with_gap"),
        F.count_if(gap & ~blank("email")).alias("emailable"),
        F.count_if(gap & ~blank("phone")).alias("phoneable"),
        F.count_if(~gap).alias("no_letter"),
        *per_basis,
    )


def campaign_corpus(leads: DataFrame, by: list[str] = MARKET) -> DataFrame:
    """The corpus per market with the words and the date its letter needs."""
    return corpus(leads, by, F.max("checked_at").alias("checked_at")).select(
        "*",
        W.market_label(F.col("market")).alias("market_label"),
        W.countable_niche(F.col("niche")).alias("niche_one"),
        W.plural_niche(F.col("niche")).alias("niche_many"),
        W.looker(F.col("niche")).alias("looker"),
        F.coalesce(check_date(F.col("checked_at")), F.lit("the day we ran it")).alias("checked_on"),
        first_match(
            [
                (F.col("n") == 0, F.lit("no audited rows")),
                (F.col("n") < V.MIN_CORPUS, F.lit("too few audited rows for a survey")),
            ],
            F.lit(None).cast("string"),
        ).alias("refused"),
    )


def campaign_letter(leads: DataFrame, slots: dict | None = None, by: list[str] = MARKET) -> DataFrame:
    """One letter per market that was surveyed widely enough."""
    s = _slots(slots)
    n, down = F.col("n").cast("string"), F.col("down").cast("string")
    market, one, many = F.col("market_label"), F.col("niche_one"), F.col("niche_many")
    intro = F.concat(
        F.lit("On "), F.col("checked_on"), F.lit(" we checked the public website of every "), one,
        F.lit(" we could find listed on Google Maps in and around "), market, F.lit(" — "), n,
        F.lit(" of them. We wanted to see what "), F.col("looker"),
        F.lit(" actually runs into when they look one of you up."),
    )
    ask = (
        "We have the individual result for every firm on that list, including yours. If you want "
        'yours, reply "send it" and I will write it up — what we checked, what it measured, and '
        "what I would fix first. No charge, no call, and I will not follow up unless you ask me to."
    )
    provenance = [
        F.concat(n, F.lit(" audited — rows whose site was actually fetched. "), F.col("leads").cast("string"),
                 F.lit(" were harvested; the difference is sites whose own robots.txt disallowed us.")),
        F.concat(down, F.lit(" did not load — reachable = no.")),
        F.concat(F.col("up").cast("string"), F.lit(" loaded — reachable = yes.")),
        F.concat(W.seconds(F.coalesce("median_ttfb_ms", F.lit(0))),
                 F.lit("s median — middle time-to-first-byte across the "), F.col("up").cast("string"),
                 F.lit(" that answered.")),
        F.concat(W.seconds(F.col("slowest_ms")),
                 F.lit("s slowest — highest time-to-first-byte in the same set.")),
        F.concat(F.col("viewport_bad").cast("string"),
                 F.lit(" not built for phones — no mobile viewport, among sites that loaded.")),
        F.concat(F.col("https_bad").cast("string"),
                 F.lit(" still on http — no HTTPS after redirects, among sites that loaded.")),
    ]
    slow_line = F.when(F.col("slowest_ms").isNotNull(), provenance[4])
    provenance[4] = slow_line
    why = F.concat(
        F.lit("You are getting this because your company is listed publicly in "), market, F.lit(". "),
        F.lit(_optout(s)),
    )
    return campaign_corpus(leads, by).filter("refused IS NULL").select(
        *by,
        F.concat(F.lit("we checked "), n, F.lit(" "), many, F.lit(" in "), market).alias("subject_1"),
        F.concat(down, F.lit(" of "), n, F.lit(" "), market, F.lit(" "), many, F.lit(" had no working site")).alias("subject_2"),
        F.concat(F.lit("what we found checking every "), one, F.lit(" in "), market).alias("subject_3"),
        _paragraphs(
            "Hi there,", intro, market_findings(), ask, _offer(s),
            s["sender"], f"{s['role']}, {s['company']}", s["phone"],
        ).alias("body"),
        _paragraphs(s["company"], s["address"], why).alias("footer"),
        F.concat_ws("\n", *provenance).alias("provenance"),
    )


def campaign_refusals(leads: DataFrame, by: list[str] = MARKET) -> DataFrame:
    """Markets that get no campaign letter, and why."""
    return campaign_corpus(leads, by).filter("refused IS NOT NULL").select(*by, "n", "refused")
