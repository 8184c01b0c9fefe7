from leadspark.operators import audit
from leadspark.schemas import PAGE_CAPTURE_SCHEMA, ROBOTS_CAPTURE_SCHEMA

VIEWPORT = '<meta name="viewport" content="x">'
SITES, PAGES, ROBOTS, WANT = [], [], [], {}


def site(pid, url, pages=(), robots=None, **want):
    SITES.append((pid, url))
    for role, no, at, final, status, ctype, html, error in pages:
        PAGES.append((pid, role, no, at, final, status, ctype, 100, html, error))
    if robots:
        ROBOTS.append((robots[0], 200, "text/plain", robots[1]))
    WANT[pid] = want


def home(url, html="<p>", status=200, final=None, ctype="text/html", role="home", error=None):
    return (role, 0, url, final or url, status, ctype, html, error)


def contact(url, html, status=200):
    return ("contact", 1, url, url, status, "text/html", html, None)


site("none", "", reachable="no", error="no website listed", https="unknown")
site("bad", "not a url", reachable="no", error="unparseable url: not a url")
site("blocked", "https://b.com/x", [home("https://b.com/x")], ("https://b.com", "User-agent: *\nDisallow: /x"),
     reachable="unknown", robots_blocked=True, pages_fetched=0, https="unknown")
site("ok", "https://ok.com/", [home("https://ok.com/", VIEWPORT + "<form>contact info@ok.com a@ok.com b@ok.com c@ok.com")],
     reachable="yes", https="yes", viewport="yes", contact_form="yes", emails=["info@ok.com", "a@ok.com", "b@ok.com"], ttfb_ms=100)
site("e403", "https://e403.com/", [home("https://e403.com/", status=403)], reachable="unknown", viewport="unknown", ttfb_ms=None, http_status=403)
site("e500", "https://e500.com/", [home("https://e500.com/", status=500)], reachable="no", viewport="unknown")
site("refused", "https://r.com/", [home("https://r.com/", status=None, error="refused")], reachable="no", error="refused", pages_fetched=0)
site("retry", "http://t.com/", [home("http://t.com/", status=None, error="refused"), home("https://t.com/", VIEWPORT, role="home_https")],
     reachable="yes", https="yes", viewport="yes", error=None, contact_form="no")
site("retry-blocked", "http://u.com/", [home("http://u.com/", status=None, error="refused"), home("https://u.com/", VIEWPORT, role="home_https")],
     ("https://u.com", "User-agent: *\nDisallow: /"), reachable="no", error="refused")
site("redirect", "http://v.com/", [home("http://v.com/", final="https://v.com/")], https="yes")
site("pdf", "https://pdf.com/", [home("https://pdf.com/", ctype="application/pdf")], reachable="yes", viewport="unknown", contact_form="unknown")
site("plain", "https://plain.com/", [home("https://plain.com/", "<p>hello")], viewport="no", contact_form="no", emails=[], pages_fetched=1)
site("home-mail", "https://hm.com/", [home("https://hm.com/", '<a href="/contact">x</a>i@hm.com')], contact_form="unknown", emails=["i@hm.com"], pages_fetched=1)
site("chase", "https://ch.com/", [home("https://ch.com/", '<a href="/contact"><a href="/about">'), contact("https://ch.com/contact", "info@ch.com"),
                                  contact("https://ch.com/about", "other@ch.com <form>")],
     emails=["info@ch.com"], contact_form="unknown", pages_fetched=2)
site("all-read", "https://ar.com/", [home("https://ar.com/", '<a href="/contact"><a href="/about">'), contact("https://ar.com/contact", "x"),
                                     contact("https://ar.com/about", "y")], emails=[], contact_form="no", pages_fetched=3)
site("page-form", "https://pf.com/", [home("https://pf.com/", '<a href="/contact">'), contact("https://pf.com/contact", "<form>")], contact_form="yes")
site("dead-link", "https://dl.com/", [home("https://dl.com/", '<a href="/contact">'), contact("https://dl.com/contact", "", None)],
     contact_form="unknown", pages_fetched=1)
site("no-entry", "https://ne.com/", [home("https://ne.com/", '<a href="/contact">'), contact("https://ne.com/contact", "info@ne.com")],
     ("https://ne.com", "User-agent: *\nDisallow: /contact"), contact_form="unknown", emails=[], pages_fetched=1)


def test_audit_site(spark):
    out = audit.audit_site(
        spark.createDataFrame(SITES, "place_id string, website string"),
        spark.createDataFrame(PAGES, PAGE_CAPTURE_SCHEMA),
        spark.createDataFrame(ROBOTS, ROBOTS_CAPTURE_SCHEMA),
    )
    rows = {r.place_id: r for r in out.collect()}
    assert set(rows) == set(WANT)
    for pid, want in WANT.items():
        got = {k: rows[pid][k] for k in want}
        assert got == want, pid


def test_robots_served_as_something_else_gives_no_rules(spark):
    rows = [("a", 200, "text/html", "User-agent: *\nDisallow: /"), ("b", 200, "application/json", "User-agent: *\nDisallow: /"),
            ("c", 404, "text/plain", "User-agent: *\nDisallow: /"), ("d", 200, "", "User-agent: *\nDisallow: /")]
    rules = audit.robots_rules_long(spark.createDataFrame(rows, ROBOTS_CAPTURE_SCHEMA)).collect()
    assert sorted(r.origin for r in rules) == ["a", "d"]


def test_no_page_text_is_shuffled(spark):
    out = audit.audit_site(
        spark.createDataFrame(SITES, "place_id string, website string"),
        spark.createDataFrame(PAGES, PAGE_CAPTURE_SCHEMA),
        spark.createDataFrame(ROBOTS, ROBOTS_CAPTURE_SCHEMA),
    )
    homes = audit._home_facts(spark.createDataFrame(PAGES, PAGE_CAPTURE_SCHEMA))
    assert "html" not in homes.schema.simpleString() and "body" not in homes.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")[1:]
    assert all("html" not in part.splitlines()[0] for part in below)


def test_an_aborted_fetch_reads_as_a_timeout(spark):
    rows = [("home", 0, "https://z.com/", None, None, None, None, "The operation was aborted")]
    out = audit.audit_site(
        spark.createDataFrame([("z", "https://z.com/")], "place_id string, website string"),
        spark.createDataFrame([("z", r[0], r[1], r[2], r[3], r[4], r[5], None, r[6], r[7]) for r in rows], PAGE_CAPTURE_SCHEMA),
        spark.createDataFrame([], ROBOTS_CAPTURE_SCHEMA),
    )
    assert out.first().error == "timeout after 9000ms"
