"""Page reading: the fixed patterns on ordinary text, linear time on hostile text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from leadspark.functions import clock, derive, fixed, html, keys, wording

TOKENS = [
    "<!--", "-->", "<script>", "<script ", "</script>", "<SCRIPT type='ld+json'>", "<style>", "</style>", "<style a>", ">", "<",
    "a@b.com", "x..y@z.org", "me@a..com", "me@a.com..xx", "q@a.b1.com-x@c.de", " ", "ld+json", "-", "\n", "'<!-->", "name='viewport'",
    "İ", "ſ</SCRIPT>", "<meta ", "<meta", 'name="viewport" ', "Viewport", "mailto:a%20b@c.de?x",
]


def plain_strip(text):
    for pattern in (r"<!--[\s\S]*?-->", r"(?i)<script\b(?![^>]*ld\+json)[^>]*>[\s\S]*?</script>", r"(?i)<style\b[^>]*>[\s\S]*?</style>"):
        text = re.sub(pattern, " ", text)
    return text


def plain_emails(text):
    found = re.findall(r"(?i)mailto:([^\"'?>\s]+)", text)
    run = re.compile(fixed.EMAIL_PATTERN)
    at = 0
    while match := run.search(text, at):
        found.append(match[0])
        at = match.end()
    return found


def test_random_markup_reads_as_the_fixed_patterns_do(spark):
    rng = random.Random(1)
    pages = ["".join(rng.choices(TOKENS, k=rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    rows = df.select(
        "html", html.visible_html(F.col("html")).alias("text"), html.email_candidates(F.col("html")).alias("emails"),
        html.has_viewport(F.col("html")).alias("viewport"),
    ).collect()
    for r in rows:
        assert r.text == plain_strip(r.html)
        assert r.viewport == bool(re.search(fixed.VIEWPORT_PATTERN, r.html))
        want = [re.sub(r"[.,;:]+$", "", re.sub("^[^a-z0-9]+", "", e.lower().replace("%20", " "))) for e in plain_emails(r.text)]
        assert r.emails == list(dict.fromkeys(e for e in want if e)), r.html


HOSTILE = {
    "labels": ("me@" + "a." * 20_000 + "com", 1),
    "open scripts": ("<script>" * 130_000, 0),
    "open tags": ("<script " * 130_000 + "</script>", 0),
    "kept tags": ("<script ld+json " * 60_000 + "></script>", 0),
    "open comments": ("<!--" * 260_000, 0),
    "open metas": ("<meta " * 170_000 + "viewport>", 0),
    "named metas": ("<meta name='viewport' " * 45_000, 0),
    "open styles": ("<style " * 140_000 + "></style", 0),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(spark, name):
    text, emails = HOSTILE[name]
    df = spark.createDataFrame([(text,)], "html string")
    facts = df.select(html.email_candidates(F.col("html")).alias("e"), html.has_viewport(F.col("html")).alias("v"))
    facts.collect()
    started = time.time()
    row = facts.collect()[0]
    assert time.time() - started < 2 and len(row.e) == emails and not row.v


def test_blank_host_is_unknown(spark):
    df = spark.createDataFrame([("a@x.com b@y.com", "", None)], "html string, blank string, none string")
    row = df.select(html.extract_emails(F.col("html"), F.col("blank")), html.extract_emails(F.col("html"), F.col("none"))).first()
    assert row[0] == row[1] == ["a@x.com", "b@y.com"]


def test_all_links_without_a_limit(spark):
    page = "".join(f'<a href="/contact/{k}">' for k in range(30))
    df = spark.createDataFrame([(page, "https://a.com/")], "html string, url string")
    count = lambda limit: df.select(F.size(html.contact_links(F.col("html"), html.parse_url(F.col("url")), limit))).first()[0]
    assert count(None) == 30 and count(2) == 2


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("v"))).collect()]


def test_small_readings(spark):
    finite = column(spark, ["12d", "1f", " 3.5 ", "1e3", "-.5", "", "5.", "NaN"], lambda v: derive.finite(v, "double"))
    assert finite == [None, None, 3.5, 1000.0, -0.5, None, 5.0, None]
    assert column(spark, ["o'brien st.louis", "new-york", "a_b c"], wording.title_case) == ["O'Brien St.Louis", "New York", "A_b C"]
    shaped = ["a@b.c", "a@b", "a@.b.c", "a@b..c", "a@b.c.", "a b@c.d", "a@b@c.d", "x@" + "a." * 20_000 + "c"]
    assert column(spark, shaped, keys.email_shaped) == [bool(re.search(r"^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$", s)) for s in shaped]
    long = "63" + "9" * 2_000_000
    assert column(spark, [long], lambda v: keys.phone_problem(v, F.lit(True))) == ["unexpected PH format (2000002 digits)"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Sao_Paulo"])
def test_calendar_keys_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(1).select(F.timestamp_micros(F.lit(1_710_054_000_000_000)).alias("t"))
        got = df.select(
            clock.month_key(F.col("t")), clock.day_key(F.col("t")), F.unix_micros(clock.next_month_reset(F.col("t"))),
            F.unix_micros(clock.next_day_reset(F.col("t"))),
        ).first()
        assert tuple(got) == ("2024-03", "2024-03-09", 1_711_929_600_000_000, 1_710_057_600_000_000)
        iso = ["2024-08-26", "2024-08-26T23:30:00Z", "2024-08-26T23:30:00-05:00", "2024-08-26 10:00:00", "2024-08-26T10:00:00", "nope", ""]
        assert column(spark, iso, clock.check_date) == ["26 Aug", "26 Aug", "27 Aug", "26 Aug", "26 Aug", None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
