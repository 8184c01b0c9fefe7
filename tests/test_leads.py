from pyspark.sql import functions as F

from leadspark.operators import gates, ingest, leads as L, market

FACTS = """ord long, place_id string, name string, phone string, website string, email string, rating double,
reviews int, reachable string, https string, ttfb_ms int, viewport string, contact_form string, audited boolean,
market string, niche string, primary_type string, checked_at string"""
CLEAN = dict(ord=1, place_id="p1", name="Acme", phone="555", website="https://acme.com", email="a@acme.com", rating=4.2,
             reviews=50, reachable="yes", https="yes", ttfb_ms=400, viewport="yes", contact_form="yes", audited=True,
             market="camden nj", niche="roofing", primary_type="", checked_at="2026-08-26T14:27:26Z")


def facts(spark, *changes):
    return spark.createDataFrame([tuple((CLEAN | c).values()) for c in changes], FACTS)


def derive(spark, *changes):
    return L.with_derived(facts(spark, *[{"ord": i, **c} for i, c in enumerate(changes)])).orderBy("ord").collect()


def test_signals(spark):
    rows = derive(
        spark, {}, dict(website="", reachable="no"), dict(reachable="no"), dict(https="unknown", viewport="unknown", ttfb_ms=None),
        dict(https="no", viewport="no", ttfb_ms=2501, contact_form="no"), dict(rating=3.9, reviews=10), dict(rating=3.0, reviews=9),
        dict(email=""), dict(email="", audited=False), dict(reviews=None, rating=None), dict(ttfb_ms=2500),
    )
    assert [r.signals for r in rows] == [
        [], ["no-site"], ["down"], [], ["insecure", "no-viewport", "slow", "no-contact-form"], ["low-rating"],
        ["thin-reviews"], ["no-email"], [], [], [],
    ]


def test_score(spark):
    rows = derive(spark, {}, dict(website="", rating=4.8, reviews=120), dict(audited=False), dict(reachable="no", ttfb_ms=3000, rating=2.0),
                  dict(website="", rating=1.0, reviews=11, email="", phone=""), dict(reviews=1, rating=None))
    got = [(r.score.total, r.score.opportunity, r.score.reach, r.score.value, r.score.band) for r in rows]
    assert got == [(49, 0, 30, 19, "cool"), (100, 45, 30, 25, "hot"), (49, 0, 30, 19, "cool"), (87, 45, 30, 12, "hot"),
                   (51, 45, 0, 6, "warm"), (33, 0, 30, 3, "cool")]
    assert rows[0].score.reasons == ["nothing measurably wrong — needs a different angle", "email address found",
                                     "phone number on the listing", "50 reviews", "4.2 stars"]
    assert rows[2].score.reasons[0] == "not audited yet — score is provisional"
    assert rows[5].score.reasons[-1] == "only 1 review"


def test_hook_texts(spark):
    df = market.with_hook(L.with_derived(facts(
        spark, dict(ord=0, website="", rating=4.6, reviews=120), dict(ord=1, website="", rating=1.6, reviews=20),
        dict(ord=2, reachable="no"), dict(ord=3, ttfb_ms=3412, checked_at=""), dict(ord=4), dict(ord=5, audited=False),
        dict(ord=6, rating=2.0), dict(ord=7, niche="property-management", viewport="no", https="no"))))
    rows = [r.hook for r in df.orderBy("ord").collect()]
    assert rows[0].text.startswith("You have 120 reviews at 4.6 stars on Google and no website")
    assert rows[1].text.startswith("You are listed on Google Maps with no website attached")
    assert rows[2].text.startswith("Your website did not load when we checked on 26 Aug — a search")
    assert rows[3].text.startswith("Your site was slow to respond — about 3.4 seconds before anything appears.")
    assert (rows[4].text, rows[4].basis) == ("", "none") and rows[4].reason.startswith("no gap found")
    assert rows[5].text == "" and rows[5].reason.startswith("not audited")
    assert rows[6].text == ""
    assert rows[7].basis == "no-viewport" and rows[7].audience == "property"


def test_market_findings_agree_in_number(spark):
    cols = "n long, up long, down long, median_ttfb_ms int, slowest_ms int, viewport_bad long, https_bad long"
    df = spark.createDataFrame([(31, 1, 30, 700, 700, 0, 0), (40, 30, 10, 612, 9000, 1, 2), (30, 30, 0, 612, 612, 0, 1)], cols)
    got = [r[0] for r in df.select(market.market_findings()).collect()]
    assert got[0] == "30 of those 31 sites did not load at all. Of the one that did, it answered in about 0.7 seconds."
    assert got[1].endswith('and the slowest took 9.0 seconds. Another 1 was still not built for phones, and 2 were still on http, '
                           'which browsers mark "Not secure" before anyone reads a word.')
    assert got[2].startswith("0 of those 30 sites did not load at all. Of the 30 that did, the typical one answered in about 0.6 seconds. Another 1 was")


def test_benchmark_stays_silent_without_two_sides(spark):
    few = [dict(ord=i, place_id=f"p{i}", reachable="no") for i in range(29)]
    many = [dict(ord=i, place_id=f"p{i}", reachable="no" if i < 20 else "yes") for i in range(40)]
    slow = [dict(ord=i, place_id=f"p{i}", ttfb_ms=3000) for i in range(40)]
    for rows, want in [(few, ""), (slow, ""), (many, None)]:
        df = market.with_benchmark(market.join_corpus(market.with_hook(L.with_derived(facts(spark, *rows)))))
        text = df.filter("ord = 0").collect()[0].benchmark
        if want is None:
            assert text == ("We checked 40 roofing companies across Camden Nj. 20 had a site that loaded. "
                            "Yours was one of the 20 that didn't.")
        else:
            assert text == want


def test_first_failing_gate_names_the_reason(spark):
    df = facts(spark, dict(website="", rating=None), dict(rating=None), dict(rating=2.0, reviews=1), dict(reviews=None), dict(rating=3.5))
    why = [r[0] for r in df.select(gates.drop_reason(min_rating=3.5, min_reviews=5, require_website=True)).collect()]
    assert why == ["no website", "unrated", "rating below minimum", "too few reviews", None]
    assert gates.filter_places(df, min_rating=3.5, keep_unrated=True).count() == 4
    assert gates.filter_places(df).count() == 5


def test_totals_of_nothing(spark):
    row = L.summarise(L.with_derived(facts(spark, {}).limit(0))).collect()[0]
    assert row.prospects == 0 and row.avg_rating == "—"


def test_one_bad_record_never_costs_its_page(spark):
    body = '{"places":[{"id":"a","rating":4.5,"types":["x"]},{"id":""},{"id":7},{"id":"b","userRatingCount":1.5},"text",' \
           '{"id":"c","location":{"latitude":1}},{"id":"d","displayName":{"text":"D"},"location":{"latitude":1,"longitude":2.5}},' \
           '{"id":"e","types":[1]},{"id":"f","businessStatus":"GONE"}]}'
    pages = spark.createDataFrame([("t", "k", 1, body, None)], "term string, tile_key string, page_no int, body string, next_token string")
    assert sorted(r.id for r in ingest.ingest_places(pages).collect()) == ["a", "d"]
    bad = {r.pos: r.error for r in ingest.rejected_places(pages).collect()}
    assert bad == {1: "id", 2: "id", 3: "userRatingCount", 4: "not an object", 5: "location.longitude", 7: "types", 8: "businessStatus"}


def test_tile_completeness(spark):
    def page(term, no, n, token):
        return (term, "k", no, '{"places":[' + ",".join(["{}"] * n) + "]}", token)

    pages = spark.createDataFrame(
        [page("full", 1, 20, "x"), page("full", 2, 20, "x"), page("full", 3, 20, None), page("done", 1, 20, "x"), page("done", 2, 3, None),
         page("cut", 1, 20, "x"), page("token", 1, 1, "x"), page("token", 2, 1, "x"), page("token", 3, 1, "x")],
        "term string, tile_key string, page_no int, body string, next_token string")
    tiles = spark.createDataFrame([(t, "k") for t in ("full", "done", "cut", "token", "never")], "term string, tile_key string")
    got = {r.term: r.truncated for r in ingest.tile_completeness(tiles, pages).collect()}
    assert got == {"full": True, "done": False, "cut": True, "token": True, "never": True}
