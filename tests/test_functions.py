import pytest
from pyspark.sql import functions as F

from leadspark.functions import clock, html as H, keys as K, robots as R, wording as W


def run(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*cols).collect()]


EMAILS = [
    ('<a href="mailto:info@acme.com">x</a>', "acme.com", ["info@acme.com"]),
    ("zz9@acme.com info@acme.com", "acme.com", ["info@acme.com", "zz9@acme.com"]),
    ("contact@acme.com and backup@gmail.com", "acme.com", ["contact@acme.com", "backup@gmail.com"]),
    ('<img src="https://cdn.site.com/sprite@2x.png"> logo@2x.jpg', "site.com", []),
    ("a1b2c3d4e5f6a7b8@sentry.io you@example.com", "acme.com", []),
    ("noreply@acme.com no-reply@acme.com", "acme.com", []),
    ("Info@Acme.com and info@acme.com", "www.acme.com", ["info@acme.com"]),
    ("Site by hello@studio.dev", "acme.com", []),
    ("office@mail.acme.com", "acme.com", ["office@mail.acme.com"]),
    ("hello@somewhere.com", None, ["hello@somewhere.com"]),
    ("build@1.2.3 jquery@3.6.0 and info@acme.com", "acme.com", ["info@acme.com"]),
    ("<style>/* font@gmail.com */</style><!-- old@gmail.com --><script>dev@gmail.com</script>", "a.com", []),
    ('<script type="application/ld+json">{"email":"office@acme.com"}</script>', "acme.com", ["office@acme.com"]),
    ('<a href="mailto:%20trag@acme.com">%20trag@acme.com</a>', "acme.com", ["trag@acme.com"]),
    ("e-mail:-info@acme.com", "acme.com", ["info@acme.com"]),
    ("bo%zzb@acme.com", "acme.com", []),
    ("%ff%fe@acme.com", "acme.com", []),
    ("first.last@acme.com, 9x@acme.com", "acme.com", ["first.last@acme.com", "9x@acme.com"]),
    ("a@b.com%foo@x.com", None, ["a@b.com", "foo@x.com"]),
]


def test_extract_emails(spark):
    got = run(spark, [e[:2] for e in EMAILS], "html string, host string", H.extract_emails(F.col("html"), F.col("host")))
    assert got == [e[2] for e in EMAILS]


def test_long_runs_are_read_in_linear_time(spark):
    """A megabyte without an @ must not be scanned once per character."""
    text = "x" * 1_000_000 + " info@acme.com"
    assert run(spark, [(text,)], "html string", H.extract_emails(F.col("html"), F.lit("acme.com"))) == [["info@acme.com"]]


LINKS = [
    ('<a href="/contact-us">', "https://acme.com/", ["https://acme.com/contact-us"]),
    ('<a href="https://facebook.com/contact">', "https://acme.com/", []),
    ('<a href="mailto:a@acme.com?contact"><a href="#contact"><a href="ftp://acme.com/contact">', "https://acme.com/", []),
    ('<a href="/contact">', "https://acme.com/contact", []),
    ('<a href="/contact#a"><a href="/contact#b">', "https://acme.com/", ["https://acme.com/contact"]),
    ('<a HREF = \'../about/./us\'>', "https://acme.com/a/b/c", ["https://acme.com/a/about/us"]),
    ('<a href="staff?q=é b">', "https://acme.com/x/y?z=1", ["https://acme.com/x/staff?q=%C3%A9%20b"]),
    ('<a href="//WWW.Acme.com:443/about">', "https://acme.com/", ["https://www.acme.com/about"]),
    ('<a href="?page=contact">', "http://acme.com:80/p", ["http://acme.com/p?page=contact"]),
    ('<a href="/contact"><a href="/about"><a href="/staff">', "https://acme.com/", ["https://acme.com/contact", "https://acme.com/about"]),
]


def test_contact_links(spark):
    cols = H.contact_links(F.col("html"), H.parse_url(F.col("base")))
    assert run(spark, [e[:2] for e in LINKS], "html string, base string", cols) == [e[2] for e in LINKS]


STAR = "User-agent: *\n"
ROBOTS = [
    (STAR + "Disallow: /private", "/private/page", False),
    ("User-agent: BadBot\nDisallow: /\n\nUser-agent: *\r\nDisallow: /admin", "/contact", True),
    ("User-agent: BadBot\nDisallow: /\n\nUser-agent: *\r\nDisallow: /admin", "/admin", False),
    (STAR + "Disallow: /\nAllow: /contact", "/contact", True),
    (STAR + "Disallow: /\nAllow: /contact", "/else", False),
    ("", "/anything", True),
    ("User-agent: *   # everyone\nDisallow: /x  # secret", "/x", False),
    (STAR + "Disallow: /*.pdf$", "/files/brochure.pdf", False),
    (STAR + "Disallow: /*.pdf$", "/brochure.pdf.html", True),
    (STAR + "Disallow: /$", "/", False),
    (STAR + "Disallow: /$", "/about", True),
    (STAR + "Disallow: /*/private", "/uk/private/deeper", False),
    (STAR + "Disallow: /*/private", "/private", True),
    (STAR + "Disallow: /a/*/b/*/c", "/a/1/2/b/3/4/c/d", False),
    (STAR + "Disallow: /a/*/b/*/c", "/a/1/b/2/d", True),
    (STAR + "Disallow: /*?", "/contact", True),
    (STAR + "Disallow: /" + "*a" * 20 + "$", "/" + "a" * 200 + "b", True),
    (STAR + "Disallow: /*\nAllow: /contact", "/pricing", False),
    (STAR + "Disallow: /files\nAllow: /files", "/files/x", True),
    (STAR + "Disallow: /Admin", "/admin", True),
    (STAR + "User-agent: Bot\nDisallow: /", "/x", True),
    (STAR + "Disallow:\nDisallow: /a**b", "/axxb", False),
]


def test_robots(spark):
    rules = [R.wildcard_rules(F.col("t"), f) for f in ("disallow", "allow")]
    got = run(spark, [e[:2] for e in ROBOTS], "t string, p string", R.allowed(*rules, F.col("p")))
    assert got == [e[2] for e in ROBOTS]


PHONES = [
    ("0917 555 0124", True, None), ("+63 917 555 0124", True, None), ("(02) 8555 0191", True, None),
    ("12345", True, "unexpected PH format (5 digits)"),
    ("(718) 555-0175", False, None), ("+1 718 555 0175", False, None),
    ("(646) 555-0142 ext. 106", False, "not 10 digits (13)"),
    ("(046) 555-0142", False, "area code starts 0 or 1"),
    ("(646) 055-0142", False, "exchange starts 0 or 1"),
    ("call us", False, "no digits"), (None, False, "no digits"),
]


def test_phone_problem(spark):
    got = run(spark, [p[:2] for p in PHONES], "p string, ph boolean", K.phone_problem(F.col("p"), F.col("ph")))
    assert got == [p[2] for p in PHONES]


def test_mx_verdict_never_blames_a_failed_lookup(spark):
    rows = [(True, 0, 1), (True, 0, 0), (True, 3, None), (True, 2, None), (False, 0, 1), (None, None, None)]
    got = run(spark, rows, "ok boolean, s int, a int", K.mx_verdict(F.col("ok"), F.col("s"), F.col("a")))
    assert got == ["yes", "no", "no", "unknown", "unknown", "unknown"]


def test_owns_domain(spark):
    rows = [
        ("BrightSmile Avenue Dental Clinic", "brightsmileavenue.com", True),
        ("Philly Property Management LLC", "phillypm.com", True),
        ("SmileON Dental Clinic", "cebudentalimplants.com", False),
        ("Iconic Smile Dental Clinic", "facebook.com", False),
        ("Concierge Property Management, LLC", "fb.me", False),
    ]
    got = run(spark, [r[:2] for r in rows], "n string, h string", K.owns_domain(F.col("n"), F.col("h")))
    assert got == [r[2] for r in rows]


def test_wording(spark):
    labels = [("camden-nj-usa", "Camden, NJ"), ("philadelphia-pa", "Philadelphia, PA"),
              ("makati-city-metro-manila", "Makati City Metro Manila"), ("usa", "Usa"), ("", "your market")]
    assert run(spark, [(a,) for a, _ in labels], "x string", W.market_label(F.col("x"))) == [b for _, b in labels]
    words = [("property-management", "property management company", "property management companies"),
             ("dental-clinic", "dental clinic", "dental clinics"), ("roofing", "roofing company", "roofing companies"),
             ("law firm", "law firm", "law firms"), ("gas", "gas", "gases"), ("", "business", "businesses")]
    got = run(spark, [(w[0],) for w in words], "x string", W.countable_niche(F.col("x")), W.plural_niche(F.col("x")))
    assert got == [w[1:] for w in words]
    audiences = [("property-management", "property"), ("Roofing contractor", "emergency-trade"), ("dentist", "appointment"),
                 ("law firm", "professional"), ("pool builder", "home-services"), ("bakery", "general")]
    assert run(spark, [(a,) for a, _ in audiences], "x string", W.audience(F.col("x"))) == [b for _, b in audiences]


def test_slug(spark):
    rows = [("Café São Paulo / Öst", "cafe-sao-paulo-ost"), ("***", "untitled"), ("ﬁne Ⅷ é", "fine-viii-e"),
            ("a" * 39 + " b", "a" * 39), ("Straße 5", "stra-e-5")]
    assert run(spark, [(a,) for a, _ in rows], "x string", W.slug(F.col("x"))) == [b for _, b in rows]


def test_seconds_and_terms(spark):
    assert run(spark, [(612,), (2550,), (60000,), (0,)], "x int", W.seconds(F.col("x"))) == ["0.6", "2.6", "60.0", "0.0"]
    assert run(spark, [(" Law  Firms ",)], "x string", W.terms_for(F.col("x"))) == [
        ["law firms", "law firm company", "law firm services", "local law firms"]]


@pytest.mark.parametrize("ts, day, reset", [
    ("2026-08-16 06:59:00", "2026-08-15", "2026-08-16 07:00:00"),
    ("2026-08-16 07:00:00", "2026-08-16", "2026-08-17 07:00:00"),
    ("2026-01-16 07:59:00", "2026-01-15", "2026-01-16 08:00:00"),
    ("2026-03-08 12:00:00", "2026-03-08", "2026-03-09 07:00:00"),
    ("2026-11-01 12:00:00", "2026-11-01", "2026-11-02 08:00:00"),
])
def test_quota_days_follow_their_zone(spark, ts, day, reset):
    t = F.col("t").cast("timestamp")
    got = run(spark, [(ts,)], "t string", clock.day_key(t), clock.next_day_reset(t).cast("string"))
    assert got == [(day, reset)]


def test_check_date(spark):
    rows = [("2026-08-26T14:27:26.820Z", "26 Aug"), ("soon", None), (None, None)]
    assert run(spark, [(a,) for a, _ in rows], "x string", clock.check_date(F.col("x"))) == [b for _, b in rows]


def test_quota_kind(spark):
    rows = [("RESOURCE_EXHAUSTED limit 'SearchPerDay' per day", "daily"), ("Quota exceeded per minute", "rate"),
            ("quota exceeded", None), ("per day", None)]
    assert run(spark, [(a,) for a, _ in rows], "x string", K.quota_kind(F.col("x"))) == [b for _, b in rows]
