"""Signals, score and band of a lead as column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V


def blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(text: Column, kind: str) -> Column:
    """Text as a number; NULL when it is blank, not a number or not finite."""

    def kept(v):
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v.cast(kind))

    def number(t):
        # a trailing d or f, which a cast would take, is no part of a number
        return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))

    return let(let(F.trim(text), number), kept)


def has_signal(name: str) -> Column:
    return F.array_contains("signals", F.lit(name))


def first_match(pairs, default) -> Column:
    """CASE over (condition, value) pairs, first true condition wins."""
    head, *rest = pairs
    case = F.when(*head)
    for cond, value in rest:
        case = case.when(cond, value)
    return case.otherwise(default)


def signals() -> Column:
    """Ordered array of gaps. NULL and 'unknown' never raise one."""
    thin = F.col("reviews") < V.THIN_REVIEW_COUNT
    raised = [
        ("no-site", blank("website")),
        ("down", ~blank("website") & (F.col("reachable") == "no")),
        ("insecure", F.col("https") == "no"),
        ("no-viewport", F.col("viewport") == "no"),
        ("slow", F.col("ttfb_ms") > V.SLOW_TTFB_MS),
        ("no-contact-form", F.col("contact_form") == "no"),
        ("low-rating", (F.col("rating") < V.LOW_RATING) & (F.col("reviews") >= V.THIN_REVIEW_COUNT)),
        ("no-email", F.col("audited") & blank("email")),
        ("thin-reviews", thin),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in raised]))


def score() -> Column:
    """Struct of total, the three axes, band and reasons; reads `signals`."""
    unaudited = ~F.col("audited") & ~blank("website")
    low = has_signal("low-rating")
    worst_points = first_match([(has_signal(s), F.lit(p)) for s, p, _ in V.DEFECTS], F.lit(0))
    worst_reason = first_match([(has_signal(s), F.lit(r)) for s, _, r in V.DEFECTS], F.lit(None))
    bonus = F.when(low, V.LOW_RATING_BONUS).otherwise(0)
    opportunity = F.when(unaudited, F.lit(0)).otherwise(
        F.least(worst_points + bonus, F.lit(V.MAX_OPPORTUNITY))
    )
    clean = worst_reason.isNull() & ~low
    opportunity_why = F.when(
        unaudited, F.array(F.lit("not audited yet — score is provisional"))
    ).otherwise(
        F.array_compact(
            F.array(
                worst_reason,
                F.when(low, F.lit("rating is below the bar")),
                F.when(clean, F.lit("nothing measurably wrong — needs a different angle")),
            )
        )
    )

    email, phone = ~blank("email"), ~blank("phone")
    reach = F.when(email, V.EMAIL_POINTS).otherwise(0) + F.when(phone, V.PHONE_POINTS).otherwise(0)
    reach_why = F.array_compact(
        F.array(
            F.when(email, F.lit("email address found")),
            F.when(phone, F.lit("phone number on the listing")),
            F.when(~email & ~phone, F.lit("no way to contact them at all")),
        )
    )

    reviews = F.coalesce(F.col("reviews"), F.lit(0))
    count_text = reviews.cast("string")
    reviews_why = first_match(
        [
            (reviews >= 100, F.concat(count_text, F.lit(" reviews — well established"))),
            (reviews >= 10, F.concat(count_text, F.lit(" reviews"))),
            (reviews > 1, F.concat(F.lit("only "), count_text, F.lit(" reviews"))),
            (reviews == 1, F.lit("only 1 review")),
        ],
        F.lit("no reviews — may not be trading"),
    )
    rating = F.col("rating")
    value = F.least(
        first_match([(reviews >= n, F.lit(p)) for n, p in V.REVIEW_POINTS], F.lit(0))
        + first_match([(rating >= r, F.lit(p)) for r, p in V.RATING_POINTS], F.lit(0)),
        F.lit(V.MAX_VALUE),
    )
    value_why = F.array_compact(
        F.array(reviews_why, F.when(rating >= V.GOOD_RATING, F.format_string("%.1f stars", rating)))
    )

    total = opportunity + reach + value
    return F.struct(
        total.alias("total"),
        opportunity.alias("opportunity"),
        reach.alias("reach"),
        value.alias("value"),
        band(total).alias("band"),
        F.concat(opportunity_why, reach_why, value_why).alias("reasons"),
    )


def band(total: Column) -> Column:
    return first_match([(total >= n, F.lit(b)) for n, b in V.BANDS], F.lit(V.LOWEST_BAND))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
