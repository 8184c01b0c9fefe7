"""The same results in plain SQL, written independently of the DataFrame code."""

import re

from ..functions import fixed as V
from ..operators.contacts import SECTIONS
from ..sources.driver_views import VIEWS
from .tables import NOW, ROOT


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(lit(i) for i in items)


def case(pairs, default) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def secs(x: str) -> str:
    return f"printf('%.1f', floor(({x} + 50) / 100) / 10)"


def counted(n, one, many):
    return f"({n} || CASE WHEN {n} = 1 THEN ' {one}' ELSE ' {many}' END)"


def slash(s):
    return f"regexp_replace({s}, '/.*$', '', 's')"


def host_key(s):
    no_scheme = f"regexp_replace({s}, '^https?://', '', 'i')"
    return f"regexp_replace(lower({slash(no_scheme)}), '^www[.]', '')"


def lead_host(s):
    return slash(f"regexp_replace({s}, '^https?://', '')")


def audience(n):
    clean = f"regexp_replace({n}, '[-_]+', ' ', 'g')"
    return case([(f"regexp_matches({clean}, {lit(p)}, 'i')", lit(a)) for a, p in V.AUDIENCE_PATTERNS], lit("general"))


def by_key(mapping, key):
    return "CASE " + key + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


def countable(n, fallback):
    clean = f"lower(trim(regexp_replace({n}, '[-_]+', ' ', 'g')))"
    return f"CASE WHEN {clean} = '' THEN '{fallback}' WHEN regexp_matches({clean}, '\\b({V.MASS_NOUNS})$') THEN {clean} || ' company' ELSE {clean} END"


def plural(n):
    one = f"({countable(n, '')})"
    return case(
        [(f"{one} = ''", "'businesses'"), (f"regexp_matches({one}, '(s|x|z|ch|sh)$')", f"{one} || 'es'"),
         (f"regexp_matches({one}, '[^aeiou]y$')", f"left({one}, length({one}) - 1) || 'ies'")],
        f"{one} || 's'",
    )


def iso_day(iso):
    return f"strftime(try_strptime({iso}, '%Y-%m-%dT%H:%M:%SZ'), '%-d %b')"


IS_PH = f"regexp_matches(address, {lit(V.PH_PATTERN.removeprefix('(?i)'))}, 'i')"
DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
NANP = f"(CASE WHEN regexp_matches({DIGITS}, '^1[0-9]{{10}}$') THEN substr({DIGITS}, 2) ELSE {DIGITS} END)"
NATIONAL = f"(CASE WHEN {DIGITS} LIKE '63%' THEN substr({DIGITS}, 3) ELSE regexp_replace({DIGITS}, '^0', '') END)"
PHONE_PROBLEM = case(
    [
        (f"{DIGITS} = ''", "'no digits'"),
        (f"{IS_PH} AND (regexp_matches({NATIONAL}, '^9[0-9]{{9}}$') OR regexp_matches({NATIONAL}, '^2[0-9]{{8}}$') OR regexp_matches({NATIONAL}, '^[3-8][0-9]{{6,8}}$'))", "NULL"),
        (IS_PH, f"'unexpected PH format (' || length({DIGITS}) || ' digits)'"),
        (f"length({NANP}) <> 10", f"'not 10 digits (' || length({NANP}) || ')'"),
        (f"left({NANP}, 1) IN ('0', '1')", "'area code starts 0 or 1'"),
        (f"substr({NANP}, 4, 1) IN ('0', '1')", "'exchange starts 0 or 1'"),
    ],
    "NULL",
)
PRESENT = "(trim({0}) <> '' AND {0} <> 'unknown')"
DROP = "CASE WHEN {p}website IS NULL THEN 'no website' WHEN {p}rating IS NULL THEN 'unrated' WHEN {p}rating < 3.0 THEN 'rating below minimum' WHEN coalesce({p}reviews, 0) < 10 THEN 'too few reviews' END"
SITE = "regexp_replace(lower(site_host), '^www[.]', '')"

FLAGS = [
    ("no-site", "website = ''"),
    ("down", "website <> '' AND reachable = 'no'"),
    ("insecure", "https = 'no'"),
    ("no-viewport", "viewport = 'no'"),
    ("slow", "ttfb_ms > 2500"),
    ("no-contact-form", "contact_form = 'no'"),
    ("low-rating", "rating < 4.0 AND reviews >= 10"),
    ("no-email", "audited AND email = ''"),
    ("thin-reviews", "reviews < 10"),
]


def flag(name):
    return "f_" + name.replace("-", "_")


REVIEWS = "coalesce(reviews, 0)"
CHECKED = iso_day("checked_at")
WHEN = f"coalesce(' when we checked on ' || {CHECKED}, '')"
OBSERVATION = case(
    [
        (
            "f_no_site",
            f"CASE WHEN coalesce(rating >= 4.0, false) AND {REVIEWS} > 0 AND NOT f_thin_reviews THEN 'You have ' || {counted(REVIEWS, 'review', 'reviews')} || ' at ' || printf('%.1f', rating) || ' stars on Google and no website to send any of it to.' "
            "ELSE 'You are listed on Google Maps with no website attached, so everyone who looks you up stops at the listing.' END",
        ),
        ("f_down", f"'Your website did not load' || {WHEN} || ' — a search for you currently ends at an error page.'"),
        ("f_no_viewport", f"'Your site was not built for phones' || {WHEN} || ' — it renders desktop-width on a handset.'"),
        ("f_insecure", f"'Your site was still on http' || {WHEN} || ', so browsers mark it \"Not secure\" before anyone reads a word.'"),
        ("f_slow", f"'Your site was slow to respond' || {WHEN} || ' — about ' || {secs('ttfb_ms')} || ' seconds before anything appears.'"),
        ("f_no_contact_form", f"'Your site had no way to send an enquiry' || {WHEN} || ' — a visitor who is not ready to ring has nothing to do next.'"),
    ],
    "NULL",
)
LETTER_MARKET = "regexp_replace(list_aggregate(list_transform(string_split(market, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ' '), ' Pa$', ', PA')"
S = V.SLOTS
OFFER = f"I am {S['sender']} — I run {S['company']}. We build the site and the systems behind it, hand you the keys, and stay on call when something breaks. You own it outright. That is the whole model."
OPTOUT = f"If you would rather not hear from me, {S['unsubscribe']} and I will remove you permanently — one click, no reply needed."
SIGN = "\n\n".join([S["sender"], f"{S['role']}, {S['company']}", S["phone"]])
NL2 = "chr(10) || chr(10)"
FINDINGS = (
    "down || ' of those ' || n || ' sites did not load at all. ' || "
    f"CASE WHEN up = 1 THEN 'Of the one that did, it answered in about ' || {secs('coalesce(median_ttfb_ms, 0)')} || ' seconds.' "
    f"ELSE 'Of the ' || up || ' that did, the typical one answered in about ' || {secs('coalesce(median_ttfb_ms, 0)')} || ' seconds' || CASE WHEN slowest_ms IS NOT NULL AND slowest_ms IS DISTINCT FROM median_ttfb_ms THEN ', and the slowest took ' || {secs('slowest_ms')} || ' seconds.' ELSE '.' END END || "
    f"coalesce(' Another ' || nullif(concat_ws(', and ', CASE WHEN viewport_bad > 0 THEN {counted('viewport_bad', 'was', 'were')} || ' still not built for phones' END, CASE WHEN https_bad > 0 THEN {counted('https_bad', 'was', 'were')} || ' still on http, which browsers mark \"Not secure\" before anyone reads a word' END), '') || '.', '')"
)

EMAILS_SQL = """
 SELECT page_id, place_id, site_host, regexp_replace(regexp_replace(lower(trim(CASE WHEN contains(raw, '%') THEN url_decode(raw) ELSE raw END)), '^[^a-z0-9]+', ''), '[.,;:]+$', '') AS email
 FROM (SELECT page_id, place_id, site_host, unnest(list_concat(regexp_extract_all(txt, '(?i)mailto:([^"''?>\\s]+)', 1), regexp_extract_all(txt, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'))) AS raw
  FROM (SELECT page_id, place_id, site_host, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--[\\s\\S]*?-->', ' ', 'g'), '<script([^>]*ld\\+json)', '<kept\\1', 'gi'), '<script\\b[^>]*>[\\s\\S]*?</script>', ' ', 'gi'), '<style\\b[^>]*>[\\s\\S]*?</style>', ' ', 'gi') AS txt FROM site_pages))
"""
LOCAL, HOST = "regexp_replace(email, '@[^@]*$', '')", "regexp_extract(email, '@([^@]*)$', 1)"
PLAUSIBLE = (
    f"(contains(email, '@') AND {LOCAL} <> '' AND NOT regexp_matches(email, {lit(V.FILE_SUFFIX_PATTERN)}) AND NOT contains(email, '..') "
    f"AND length({LOCAL}) <= 64 AND length(email) <= 254 AND contains({HOST}, '.') AND NOT contains({LOCAL}, '%') AND regexp_matches({LOCAL}, '^[a-z0-9]') "
    f"AND NOT regexp_full_match({LOCAL}, '[0-9a-f]{{16,}}') AND NOT list_bool_or([{HOST} = n OR ends_with({HOST}, '.' || n) for n in [{values(V.NOISE_HOSTS)}]]) AND {LOCAL} NOT IN ({values(V.NOISE_LOCALS)}))"
)
SAME = f"({HOST} = {SITE} OR ends_with({HOST}, '.' || {SITE}) OR ends_with({SITE}, '.' || {HOST}))"
BELONGS = f"({HOST} IN ({values(V.FREE_PROVIDERS)}) OR {SAME})"
POINTS = (
    f"(CASE WHEN {SAME} THEN 40 ELSE 0 END + CASE WHEN list_contains([{values(V.PREFERRED_LOCALS)}], {LOCAL}) THEN 31 - list_position([{values(V.PREFERRED_LOCALS)}], {LOCAL}) ELSE 0 END "
    f"+ CASE WHEN contains({LOCAL}, '.') THEN 3 ELSE 0 END - CASE WHEN regexp_matches({LOCAL}, '^[0-9]') THEN 10 ELSE 0 END)"
)

STORED_SELECT = f"""
 SELECT ord, 0 AS generation, place_id, '2026-07-01 00:00:00' AS first_listed, '2026-07-15 00:00:00' AS last_seen, name, address, phone, email, email_alt, website,
  rating, reviews, signals, reachable, https, ttfb_ms, viewport AS mobile_viewport, contact_form, business_status, primary_type, lat AS latitude, lng AS longitude,
  final_url, audit_error, niche, market AS search_location, checked_at AS google_refreshed_at, CASE WHEN ord % 4 = 0 THEN 'contacted' ELSE 'unreviewed' END AS review_status,
  CASE WHEN ord % 6 = 0 THEN 'call back, after 5' ELSE '' END AS notes, hook, hook_basis, total AS score, band AS score_band, reasons AS score_why
 FROM hooked WHERE ord % 2 = 0
"""


def signal_columns(source):
    cols = ", ".join(f"coalesce({sql}, false) AS {flag(n)}" for n, sql in FLAGS)
    text = ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql in FLAGS)
    return f"SELECT *, {cols}, concat_ws(' ', {text}) AS signals FROM {source}"


def score_columns(source):
    return f"""
 SELECT *, opportunity + reach + value AS total, {case([(f'opportunity + reach + value >= {n}', lit(b)) for n, b in V.BANDS], "'cold'")} AS band,
  concat_ws('; ', CASE WHEN provisional THEN 'not audited yet — score is provisional' ELSE nullif(concat_ws('; ', worst_why, CASE WHEN f_low_rating THEN 'rating is below the bar' END, CASE WHEN worst_why IS NULL AND NOT f_low_rating THEN 'nothing measurably wrong — needs a different angle' END), '') END,
   CASE WHEN email <> '' THEN 'email address found' END, CASE WHEN phone <> '' THEN 'phone number on the listing' END, CASE WHEN email = '' AND phone = '' THEN 'no way to contact them at all' END,
   CASE WHEN {REVIEWS} >= 100 THEN {REVIEWS} || ' reviews — well established' WHEN {REVIEWS} >= 10 THEN {REVIEWS} || ' reviews' WHEN {REVIEWS} > 1 THEN 'only ' || {REVIEWS} || ' reviews' WHEN {REVIEWS} = 1 THEN 'only 1 review' ELSE 'no reviews — may not be trading' END,
   CASE WHEN rating >= 4.0 THEN printf('%.1f', rating) || ' stars' END) AS reasons
 FROM (SELECT *, website <> '' AND NOT audited AS provisional,
   {case([(flag(s), lit(r)) for s, _, r in V.DEFECTS], 'NULL')} AS worst_why,
   CASE WHEN website <> '' AND NOT audited THEN 0 ELSE least(45, {case([(flag(s), p) for s, p, _ in V.DEFECTS], 0)} + CASE WHEN f_low_rating THEN 5 ELSE 0 END) END AS opportunity,
   CASE WHEN email <> '' THEN 20 ELSE 0 END + CASE WHEN phone <> '' THEN 10 ELSE 0 END AS reach,
   {case([(f'{REVIEWS} >= {n}', p) for n, p in V.REVIEW_POINTS], 0)} + {case([(f'rating >= {n}', p) for n, p in V.RATING_POINTS], 0)} AS value
  FROM {source})
"""


CORPUS_AGG = """count(*) FILTER (WHERE reachable IN ('yes', 'no')) AS n, count(*) FILTER (WHERE reachable = 'yes') AS up, count(*) FILTER (WHERE reachable = 'no') AS down,
  CAST(list_sort(list(ttfb_ms) FILTER (WHERE reachable = 'yes' AND ttfb_ms IS NOT NULL))[CAST(floor(count(ttfb_ms) FILTER (WHERE reachable = 'yes') / 2) AS INT) + 1] AS INT) AS median_ttfb_ms,
  max(ttfb_ms) FILTER (WHERE reachable = 'yes') AS slowest_ms,
  count(*) FILTER (WHERE reachable = 'yes' AND viewport = 'yes') AS viewport_ok, count(*) FILTER (WHERE reachable = 'yes' AND viewport = 'no') AS viewport_bad,
  count(*) FILTER (WHERE reachable = 'yes' AND https = 'yes') AS https_ok, count(*) FILTER (WHERE reachable = 'yes' AND https = 'no') AS https_bad, count(*) AS leads"""

HELPERS = {
    "sig": signal_columns("leads"),
    "scored": score_columns("sig"),
    "corpora": f"SELECT market, niche, {CORPUS_AGG} FROM leads GROUP BY 1, 2",
    "hooked": f"""
 SELECT *, coalesce(line || ' ' || {by_key(V.STAKES, 'audience')}, '') AS hook, CASE WHEN line IS NULL THEN 'none' ELSE gap END AS basis,
  CASE WHEN provisional THEN {lit(V.REASON_NOT_AUDITED)} WHEN line IS NULL THEN {lit(V.REASON_NO_GAP)} END AS reason,
  CASE WHEN line IS NOT NULL THEN gap WHEN provisional THEN {lit(V.REASON_NOT_AUDITED)} ELSE {lit(V.REASON_NO_GAP)} END AS hook_basis
 FROM (SELECT *, CASE WHEN NOT provisional THEN {OBSERVATION} END AS line, {audience('niche')} AS audience, {case([(flag(s), lit(s)) for s in V.HOOK_PRIORITY], "'none'")} AS gap FROM scored)
""",
    "compared": f"""
 SELECT h.*, c.n, c.up, {LETTER_MARKET.replace('market', 'h.market')} AS place_name,
  CASE WHEN c.n < 30 OR f_no_site THEN ''
   WHEN f_down THEN CASE WHEN c.down > 0 THEN 'We checked ' || c.n || ' ' || replace(h.niche, '-', ' ') || ' companies across ' || {LETTER_MARKET.replace('market', 'h.market')} || '. ' || c.up || ' had a site that loaded. Yours was one of the ' || c.down || ' that didn''t.' ELSE '' END
   WHEN f_no_viewport THEN CASE WHEN c.viewport_ok > 0 AND c.viewport_bad > 0 THEN c.viewport_ok || ' of the ' || c.up || ' sites we checked in ' || {LETTER_MARKET.replace('market', 'h.market')} || ' render properly on a phone. Yours is one of the ' || c.viewport_bad || ' that don''t.' ELSE '' END
   WHEN f_insecure THEN CASE WHEN c.https_ok > 0 AND c.https_bad > 0 THEN c.https_ok || ' of the ' || c.up || ' sites we checked in ' || {LETTER_MARKET.replace('market', 'h.market')} || ' are on HTTPS. Yours is one of the ' || c.https_bad || ' that aren''t.' ELSE '' END
   WHEN f_slow THEN CASE WHEN h.ttfb_ms > c.median_ttfb_ms THEN 'Across the ' || c.up || ' sites in ' || {LETTER_MARKET.replace('market', 'h.market')} || ' that loaded, the median was ' || {secs('c.median_ttfb_ms')} || ' seconds. Yours was ' || {secs('h.ttfb_ms')} || ' seconds.' ELSE '' END
   ELSE '' END AS benchmark
 FROM hooked h LEFT JOIN corpora c USING (market, niche)
""",
    "keyed": f"""
 SELECT ord, place_id, total, nullif(lower(email), '') AS email_key, nullif({DIGITS}, '') AS phone_key,
  CASE WHEN website <> '' AND length(label) >= 3 AND (contains(flat, label) OR (word <> '' AND contains(label, word))) THEN host END AS website_key
 FROM (SELECT *, {host_key('website')} AS host, split_part({host_key('website')}, '.', 1) AS label, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS flat, regexp_extract(lower(name), '[a-z0-9]{{4,}}') AS word FROM scored)
""",
    "by_email": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY email_key) AS size, min(ord) OVER (PARTITION BY email_key) AS group_ord FROM keyed WHERE email_key IS NOT NULL) WHERE size >= 2",
    "by_phone": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY phone_key) AS size, min(ord) OVER (PARTITION BY phone_key) AS group_ord FROM keyed WHERE phone_key IS NOT NULL AND place_id NOT IN (SELECT place_id FROM by_email)) WHERE size >= 2",
    "by_site": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY website_key) AS size, min(ord) OVER (PARTITION BY website_key) AS group_ord FROM keyed WHERE website_key IS NOT NULL AND place_id NOT IN (SELECT place_id FROM by_email) AND place_id NOT IN (SELECT place_id FROM by_phone)) WHERE size >= 2",
    "members": """
 SELECT 'email' AS shared_by, email_key AS value, group_ord, size, ord, place_id, total FROM by_email
 UNION ALL SELECT 'phone', phone_key, group_ord, size, ord, place_id, total FROM by_phone
 UNION ALL SELECT 'website', website_key, group_ord, size, ord, place_id, total FROM by_site
""",
    "survivors": "SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY shared_by, value ORDER BY total DESC, ord) = 1",
    "stored": STORED_SELECT,
    "stored_all": STORED_SELECT.replace("FROM hooked WHERE ord % 2 = 0", "FROM hooked"),
    "fresh_leads": "SELECT * REPLACE (CAST(reviews + 1 AS INT) AS reviews, '2026-08-20T08:00:00Z' AS checked_at) FROM leads WHERE ord % 3 = 0",
    "fresh_sig": signal_columns("fresh_leads"),
    "fresh_scored": score_columns("fresh_sig"),
    "fresh_hooked": f"""
 SELECT *, CASE WHEN line IS NOT NULL THEN gap WHEN provisional THEN {lit(V.REASON_NOT_AUDITED)} ELSE {lit(V.REASON_NO_GAP)} END AS hook_basis
 FROM (SELECT *, CASE WHEN NOT provisional THEN {OBSERVATION} END AS line, {case([(flag(s), lit(s)) for s in V.HOOK_PRIORITY], "'none'")} AS gap FROM fresh_scored)
""",
    "upserted": f"""
 SELECT coalesce(s.place_id, f.place_id) AS place_id, CASE WHEN s.place_id IS NULL THEN '{NOW}' ELSE s.first_listed END AS first_listed,
  CASE WHEN f.place_id IS NULL THEN s.last_seen ELSE '{NOW}' END AS last_seen, CASE WHEN f.place_id IS NULL THEN s.name ELSE f.name END AS name,
  CASE WHEN f.place_id IS NULL THEN s.phone WHEN f.ord % 9 = 0 THEN '(215) 555-0199' ELSE f.phone END AS phone,
  CASE WHEN f.place_id IS NULL THEN s.email ELSE f.email END AS email, CASE WHEN f.place_id IS NULL THEN s.reviews ELSE f.reviews END AS reviews,
  CASE WHEN f.place_id IS NULL THEN s.signals ELSE f.signals END AS signals, CASE WHEN s.place_id IS NULL THEN 'unreviewed' ELSE s.review_status END AS review_status,
  CASE WHEN s.place_id IS NULL THEN '' ELSE s.notes END AS notes, CASE WHEN f.place_id IS NULL THEN s.hook_basis ELSE f.hook_basis END AS hook_basis,
  CASE WHEN f.place_id IS NULL THEN s.score ELSE f.total END AS score, CASE WHEN f.place_id IS NULL THEN s.score_band ELSE f.band END AS score_band,
  CASE WHEN f.place_id IS NULL THEN s.google_refreshed_at ELSE f.checked_at END AS google_refreshed_at,
  CASE WHEN s.place_id IS NULL THEN 1 ELSE 0 END AS generation, coalesce(s.ord, f.ord) AS ord
 FROM stored s FULL JOIN fresh_hooked f ON s.place_id = f.place_id
""",
    "patches": """
 SELECT k * 100 + n_nationkey AS ord, 'p' || (n_nationkey * 2) AS place_id, col AS "column", val AS value
 FROM nation CROSS JOIN (VALUES (1, 'phone', '(215) 555-0100'), (2, 'notes', 'call back, after 5'), (3, 'phone', ''), (4, 'review_status', 'contacted')) v(k, col, val)
""",
    "found": EMAILS_SQL,
    "addresses": "SELECT DISTINCT page_id, site_host, email FROM found WHERE email <> ''",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {POINTS} DESC, email) - 1 AS pos FROM addresses WHERE {PLAUSIBLE} AND {BELONGS}",
    "rule_lines": """
 SELECT origin, i, line, last_value(CASE WHEN regexp_matches(line, '^\\s*user-agent\\s*:', 'i') THEN trim(regexp_replace(line, '^[^:]*:', '')) END IGNORE NULLS) OVER (PARTITION BY origin ORDER BY i) AS agent
 FROM (SELECT origin, unnest(range(len(string_split(body, chr(10))))) AS i, regexp_replace(rtrim(unnest(string_split(body, chr(10))), chr(13)), '#.*$', '') AS line
  FROM (SELECT origin, CASE WHEN content_type = '' OR lower(content_type) LIKE 'text/%' THEN text ELSE '' END AS body FROM robots_captures WHERE http_status BETWEEN 200 AND 299))
""",
    "rules": """
 SELECT origin, lower(trim(split_part(line, ':', 1))) AS kind, trim(regexp_replace(line, '^[^:]*:', '')) AS rule FROM rule_lines
 WHERE agent = '*' AND regexp_matches(line, '^\\s*(allow|disallow)\\s*:', 'i') AND trim(regexp_replace(line, '^[^:]*:', '')) <> ''
""",
    "paths": "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages",
    "verdicts": r"""
 SELECT page_id, p.origin, path, coalesce(max(length(rule)) FILTER (WHERE kind = 'disallow' AND hit), -1) = -1
  OR coalesce(max(length(rule)) FILTER (WHERE kind = 'allow' AND hit), -1) >= max(length(rule)) FILTER (WHERE kind = 'disallow' AND hit) AS allowed
 FROM (SELECT p.page_id, p.origin, p.path, r.kind, r.rule,
   regexp_matches(p.path, '^' || replace(regexp_escape(CASE WHEN r.rule LIKE '%$' THEN left(r.rule, length(r.rule) - 1) ELSE r.rule END), '\*', '.*') || CASE WHEN r.rule LIKE '%$' THEN '$' ELSE '' END) AS hit
  FROM paths p LEFT JOIN rules r USING (origin)) p GROUP BY ALL
""",
    "site_paths": "SELECT page_id, place_id, url, site_host, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, url LIKE 'http:%' AS on_http FROM site_pages",
    "asks": """
 SELECT place_id, 'here' AS q, origin, path FROM site_paths UNION ALL SELECT place_id, 'https', 'https://' || site_host, path FROM site_paths
 UNION ALL SELECT place_id, 'link_here', origin, '/contact-us' FROM site_paths UNION ALL SELECT place_id, 'link_https', 'https://' || site_host, '/contact-us' FROM site_paths
""",
    "answers": r"""
 SELECT place_id, bool_and(ok) FILTER (WHERE q = 'here') AS here, bool_and(ok) FILTER (WHERE q = 'https') AS secure, bool_and(ok) FILTER (WHERE q = 'link_here') AS link_here, bool_and(ok) FILTER (WHERE q = 'link_https') AS link_secure FROM (
  SELECT place_id, q, coalesce(max(length(rule)) FILTER (WHERE kind = 'disallow' AND hit), -1) = -1 OR coalesce(max(length(rule)) FILTER (WHERE kind = 'allow' AND hit), -1) >= max(length(rule)) FILTER (WHERE kind = 'disallow' AND hit) AS ok
  FROM (SELECT a.*, r.kind, r.rule, regexp_matches(a.path, '^' || replace(regexp_escape(CASE WHEN r.rule LIKE '%$' THEN left(r.rule, length(r.rule) - 1) ELSE r.rule END), '\*', '.*') || CASE WHEN r.rule LIKE '%$' THEN '$' ELSE '' END) AS hit FROM asks a LEFT JOIN rules r USING (origin)) GROUP BY 1, 2) GROUP BY 1
""",
    "visited": """
 SELECT s.*, a.*, h.http_status IS NOT NULL AND here AS direct, here AND h.http_status IS NULL AND on_http AND secure AND r.http_status IS NOT NULL AS retried,
  CASE WHEN here AND h.http_status IS NOT NULL THEN h.http_status WHEN here AND on_http AND secure THEN r.http_status END AS status,
  CASE WHEN h.http_status IS NOT NULL THEN h.final_url ELSE r.final_url END AS landed, CASE WHEN h.http_status IS NOT NULL THEN h.ttfb_ms ELSE r.ttfb_ms END AS ms,
  CASE WHEN h.http_status IS NOT NULL THEN CASE WHEN h.content_type = '' OR lower(h.content_type) LIKE '%html%' THEN h.html ELSE '' END ELSE r.html END AS body, h.error AS failure
 FROM site_paths s JOIN answers a ON a.place_id = s.place_id JOIN page_captures h ON h.place_id = s.place_id AND h.role = 'home' LEFT JOIN page_captures r ON r.place_id = s.place_id AND r.role = 'home_https'
""",
    "judged": """
 SELECT v.*, CASE WHEN NOT here THEN 'unknown' WHEN status IS NULL THEN 'no' WHEN status BETWEEN 200 AND 399 THEN 'yes' WHEN status >= 500 THEN 'no' ELSE 'unknown' END AS reach,
  coalesce(status BETWEEN 200 AND 399 AND body <> '', false) AS loaded, coalesce(e.emails, '') AS home_emails,
  coalesce(CASE WHEN retried OR NOT on_http THEN link_secure ELSE link_here END AND c.http_status IS NOT NULL AND regexp_extract(landed, '^(https?://[^/?#]+)', 1) || '/contact-us' = c.url, false) AND page_id % 6 < 4 AS read_contact,
  CASE WHEN page_id % 3 = 0 AND site_host LIKE '%.example.net' THEN 'hello@' || site_host ELSE '' END AS contact_email
 FROM visited v LEFT JOIN page_captures c ON c.place_id = v.place_id AND c.role = 'contact' LEFT JOIN (SELECT page_id AS pid, string_agg(email, ' ' ORDER BY pos) FILTER (WHERE pos < 3) AS emails FROM ranked GROUP BY 1) e ON e.pid = v.page_id
""",
    "cells": f"""
 SELECT term, place_id, pos, least(floor((lat - {ROOT['sw_lat']}) / ({ROOT['ne_lat']} - {ROOT['sw_lat']}) * 8), 7)::INT AS y, least(floor((lng - ({ROOT['sw_lng']})) / (({ROOT['ne_lng']}) - ({ROOT['sw_lng']})) * 8), 7)::INT AS x
 FROM tile_batches WHERE lat BETWEEN {ROOT['sw_lat']} AND {ROOT['ne_lat']} AND lng BETWEEN {ROOT['sw_lng']} AND {ROOT['ne_lng']}
""",
    "grid": "SELECT t.term, d.depth::INT AS depth, gy::INT AS gy, gx::INT AS gx FROM (SELECT DISTINCT term FROM cells) t, (SELECT unnest(range(4)) AS depth) d, (SELECT unnest(range(8)) AS gy) a, (SELECT unnest(range(8)) AS gx) b WHERE gy < 2 ** depth AND gx < 2 ** depth",
    "tallies": "SELECT g.term, g.depth, g.gy, g.gx, count(c.y) AS n FROM grid g LEFT JOIN cells c ON c.term = g.term AND c.y >> (3 - g.depth) = g.gy AND c.x >> (3 - g.depth) = g.gx GROUP BY ALL",
    "tree": """
 SELECT t.term, t.depth, t.gy, t.gx, t.n AS item_count, t.n >= 60 AS truncated, t.n >= 60 AND t.depth < 3 AS split, CASE WHEN t.n >= 60 AND t.depth >= 3 THEN 'maxDepth' END AS split_blocked_by
 FROM tallies t WHERE NOT EXISTS (SELECT 1 FROM tallies a WHERE a.term = t.term AND a.depth < t.depth AND a.gy = t.gy >> (t.depth - a.depth) AND a.gx = t.gx >> (t.depth - a.depth) AND a.n < 60)
""",
    "costed": """
 SELECT *, coalesce(sum(cost) OVER (ORDER BY term, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS calls_before
 FROM (SELECT *, greatest(ceil(least(item_count, 60) / 20), 1)::BIGINT AS cost,
  array_to_string(list_transform(range(1, depth + 1), lambda k: ((gy >> (depth - k)::INT) & 1) * 2 + ((gx >> (depth - k)::INT) & 1)), '') AS path FROM tree)
""",
    "swept": """
 SELECT term, depth, gy, gx, path, CASE WHEN calls < cost THEN calls * 20 ELSE item_count END AS item_count, cut AS truncated, cut AND why IS NULL AS split, why AS split_blocked_by, calls, calls_before
 FROM (SELECT *, CASE WHEN cut THEN CASE WHEN depth >= 3 THEN 'maxDepth' WHEN calls_before + calls >= 100 THEN 'halted' END END AS why
  FROM (SELECT *, least(cost, 100 - calls_before) AS calls, truncated OR cost > 100 - calls_before AS cut FROM costed WHERE calls_before < 100))
""",
    "sweeps": """
 SELECT t.term, coalesce(n, 0) AS tiles_searched, coalesce(s, 0) AS tiles_split, coalesce(deepest, 0) AS deepest, coalesce(leaves, 0) AS truncated_leaves, coalesce(w, 0) > 0 AS halted
 FROM (SELECT DISTINCT term FROM tree) t
 LEFT JOIN (SELECT term, count(*) AS n, count(*) FILTER (WHERE split) AS s, max(depth) AS deepest, count(*) FILTER (WHERE truncated AND NOT split) AS leaves FROM swept GROUP BY term) a ON a.term = t.term
 LEFT JOIN (SELECT d.term, count(*) AS w FROM costed d LEFT JOIN swept p ON p.term = d.term AND p.path = left(d.path, d.depth - 1)
  WHERE d.calls_before >= 100 AND (d.depth = 0 OR p.split) GROUP BY d.term) b ON b.term = t.term""",
    "tile_answers": """
 SELECT k.tile_key, c.place_id, row_number() OVER (PARTITION BY k.tile_key ORDER BY c.pos) - 1 AS pos
 FROM tile_keys k JOIN cells c ON c.term = k.term AND c.y >> (3 - k.depth) = k.gy AND c.x >> (3 - k.depth) = k.gx
 QUALIFY row_number() OVER (PARTITION BY k.tile_key ORDER BY c.pos) <= 60
""",
    "tile_keys": f"""
 SELECT *, lower(trim(term)) || '|' || printf('%.6f', {ROOT['sw_lat']} + gy * ({ROOT['ne_lat']}::DOUBLE - {ROOT['sw_lat']}::DOUBLE) / 2 ** depth) || ',' || printf('%.6f', ({ROOT['sw_lng']}) + gx * ({ROOT['ne_lng']}::DOUBLE - ({ROOT['sw_lng']})::DOUBLE) / 2 ** depth)
  || ',' || printf('%.6f', {ROOT['sw_lat']} + (gy + 1) * ({ROOT['ne_lat']}::DOUBLE - {ROOT['sw_lat']}::DOUBLE) / 2 ** depth) || ',' || printf('%.6f', ({ROOT['sw_lng']}) + (gx + 1) * ({ROOT['ne_lng']}::DOUBLE - ({ROOT['sw_lng']})::DOUBLE) / 2 ** depth) AS tile_key
 FROM tree
""",
    "cache": """
 SELECT tile_key, CASE WHEN gy + gx = 2 THEN 'not a date' ELSE '2026-07-' || lpad((gx + 27)::VARCHAR, 2, '0') || 'T06:00:00Z' END AS "at", NOT (gx = 3 AND gy = 0) AS has_places
 FROM tile_keys WHERE (gy + gx + depth) % 3 <> 0
""",
    "fresh_cache": f"""SELECT * FROM cache WHERE has_places AND try_strptime("at", '%Y-%m-%dT%H:%M:%SZ') > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS""",
    "collected": "SELECT * FROM tile_batches QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY batch, pos) = 1",
    "capped": "SELECT * FROM collected ORDER BY batch, pos LIMIT 700",
    "lead_checks": f"""
 SELECT 'site' AS channel, ord, l.place_id, name, address, CASE WHEN robots_blocked THEN 'blocked_site' WHEN p.reachable = 'no' THEN 'broken_site' END AS kind,
  CASE WHEN robots_blocked THEN 'robots.txt disallows us, so its status is unknown by choice' WHEN p.reachable = 'no' THEN coalesce(p.error, 'did not load') || coalesce(' (HTTP ' || p.http_status || ')', '') END AS detail
 FROM leads l LEFT JOIN probes p ON l.place_id = p.place_id WHERE {PRESENT.format('website')}
 UNION ALL
 SELECT 'email', ord, place_id, name, address, CASE WHEN NOT shaped OR verdict = 'no' THEN 'bad_email' WHEN verdict = 'unknown' THEN 'unchecked_email' END,
  CASE WHEN NOT shaped THEN email || ' — malformed address' WHEN verdict = 'no' THEN email || ' — ' || domain || ' has no mail server, so nothing can be delivered' ELSE email || ' — ' || domain || ' could not be checked' END
 FROM lead_mx
 UNION ALL
 SELECT 'phone', ord, place_id, name, address, CASE WHEN ({PHONE_PROBLEM}) IS NOT NULL THEN 'bad_phone' END, phone || ' — ' || ({PHONE_PROBLEM}) FROM leads WHERE {PRESENT.format('phone')}
""",
    "mx": "SELECT domain, CASE WHEN NOT http_ok THEN 'unknown' WHEN status = 3 THEN 'no' WHEN status <> 0 THEN 'unknown' WHEN answers > 0 THEN 'yes' ELSE 'no' END AS verdict FROM mx_results",
    "lead_addresses": f"""
 SELECT ord, place_id, name, address, email, regexp_matches(email, '^[^\\s@]+@[^\\s@.]+(\\.[^\\s@.]+)+$') AS shaped, CASE WHEN regexp_matches(email, '^[^\\s@]+@[^\\s@.]+(\\.[^\\s@.]+)+$') THEN lower(split_part(email, '@', 2)) END AS domain
 FROM (SELECT ord, place_id, name, address, trim(unnest(list_concat([email], string_split(email_alt, ' ')))) AS email FROM leads) WHERE {PRESENT.format('email')}
""",
    "lead_mx": "SELECT a.*, CASE WHEN shaped THEN coalesce(m.verdict, 'unknown') END AS verdict FROM lead_addresses a LEFT JOIN mx m ON a.domain = m.domain",
}

SUMMARY = """count(*) AS prospects, count(*) FILTER (WHERE email <> '') AS with_email, count(*) FILTER (WHERE website = '') AS no_site, count(*) FILTER (WHERE f_down) AS down,
 count(*) FILTER (WHERE f_insecure) AS insecure, count(*) FILTER (WHERE f_no_viewport) AS no_viewport, count(*) FILTER (WHERE f_slow) AS slow, count(*) FILTER (WHERE f_no_contact_form) AS no_contact_form,
 count(*) FILTER (WHERE f_low_rating) AS low_rating, count(*) FILTER (WHERE f_thin_reviews) AS thin_reviews, count(*) FILTER (WHERE contact_form = 'yes') AS contact_form,
 count(*) FILTER (WHERE phone <> '') AS with_phone, count(*) FILTER (WHERE signals = '') AS clean, coalesce(printf('%.2f', round(avg(rating), 2)), '—') AS avg_rating"""
TERMS = """SELECT niche, unnest(range(len(terms)))::INT AS pos, unnest(terms) AS term, len(terms)::INT AS terms_available, leads FROM (
 SELECT niche, count(*) AS leads, CASE WHEN niche = 'property-management' THEN [{curated}]
  ELSE list_filter([niche, regexp_replace(niche, 's$', '') || ' company', regexp_replace(niche, 's$', '') || ' services', 'local ' || niche], lambda x: true) END AS terms FROM leads GROUP BY niche)""".replace(
    "{curated}", values(V.CURATED_NICHES["property-management"])
)
RECORD_FAULTS = """concat_ws('; ', CASE WHEN ord % 31 = 0 THEN 'id' END, CASE WHEN name IS NULL AND ord % 37 = 0 THEN 'displayName.text' END, CASE WHEN ord % 37 = 0 AND rating IS NOT NULL THEN 'rating' END,
 CASE WHEN ord % 29 = 0 THEN 'userRatingCount' END, CASE WHEN ord % 23 = 0 THEN 'businessStatus' END, CASE WHEN ord % 47 = 0 THEN 'location.longitude' END)"""
PAGED = "(ord // 20) % 17 <> 16"
HARVEST_TEXT = "place_id, coalesce(name, '') AS name, coalesce(address, '') AS address, coalesce(phone, '') AS phone, coalesce(website, '') AS website, rating, coalesce(reviews::VARCHAR, '') AS review_count, coalesce(business_status, '') AS business_status, coalesce(primary_type, '') AS primary_type, lat AS latitude, lng AS longitude"
CLEAN_LEADS = "place_id, name, address, phone, website, {host} AS host, email, CASE WHEN email = '' THEN '' ELSE email_alt END AS email_alt, rating, reviews, lat, lng, reachable, ttfb_ms, final_url, audit_error"

# A row read back from a file: audited is judged by what was measured.
READ_BACK = score_columns("(" + signal_columns("(SELECT * REPLACE (reachable <> 'unknown' OR final_url <> '' OR email <> '' AS audited) FROM leads)") + ")")

ORACLES = {
    "ingest_places": f"SELECT 'term ' || ((ord // 60) % 4) AS term, 'tile-' || (ord // 60) AS tile_key, ((ord // 20) % 3 + 1)::INT AS page_no, place_id, name, address, phone, website, rating, reviews, business_status, primary_type, lat, lng FROM places WHERE {RECORD_FAULTS} = ''",
    "ingest_rejected": f"SELECT 'term ' || ((ord // 60) % 4) AS term, 'tile-' || (ord // 60) AS tile_key, ((ord // 20) % 3 + 1)::INT AS page_no, pos::INT AS pos, {RECORD_FAULTS} AS error FROM (SELECT *, row_number() OVER (PARTITION BY ord // 20 ORDER BY ord) - 1 AS pos FROM places) WHERE {RECORD_FAULTS} <> ''",
    "tile_completeness": f"""
SELECT term, tile_key, coalesce(sum(raw), 0)::BIGINT AS raw_returned, count(raw) AS pages_fetched, count(raw) = 0 OR coalesce(arg_max(token, page_no), false) OR coalesce(max(page_no) > count(DISTINCT page_no), false) OR coalesce(sum(raw), 0) >= 60 AS truncated
FROM (SELECT DISTINCT 'term ' || ((ord // 60) % 4) AS term, 'tile-' || (ord // 60) AS tile_key, ord // 60 AS chain FROM places) t
LEFT JOIN (SELECT ord // 60 AS chain, (ord // 20) % 3 + 1 AS page_no, count(*) AS raw, (ord // 20) % 3 + 1 < 3 OR (ord // 60) % 4 = 0 AS token FROM places WHERE {PAGED} GROUP BY ALL) p USING (chain) GROUP BY 1, 2""",
    "scan_lead_csv": f"SELECT {CLEAN_LEADS.format(host=lead_host('website'))}, audited, signals, total, '20260801-142726_town_dentist.csv' AS file FROM ({READ_BACK})",
    "file_labels": "SELECT ord, run_file AS file, '2026-08-0' || substr(run_file, 8, 1) || ' 14:27:26' AS run_at, replace(split_part(run_file, '_', 2), '-', ' ') AS run_location, replace(regexp_replace(split_part(run_file, '_', 3), '(-[0-9]+)?[.]csv$', ''), '-', ' ') AS run_niche, false AS refused FROM leads",
    "file_labels_refused": "SELECT true AS refused, count(*) AS files, 0::BIGINT AS labelled FROM documents",
    "scan_stored": f"SELECT ord, place_id, {lead_host('website')} AS host, rating, reviews, ttfb_ms, '' AS https, true AS audited, email_alt, signals, '2026-07-01 00:00:00' AS collected_at, CASE WHEN ord % 4 = 0 THEN 'contacted' ELSE 'unreviewed' END AS review_status, CASE WHEN ord % 6 = 0 THEN 'call back, after 5' ELSE '' END AS notes, hook_basis, o + reach + value AS total, {case([(f'o + reach + value >= {n}', lit(b)) for n, b in V.BANDS], chr(39) + 'cold' + chr(39))} AS band "
    f"FROM (SELECT *, least(45, {case([(flag(s), p) for s, p, _ in V.DEFECTS], 0)} + CASE WHEN f_low_rating THEN 5 ELSE 0 END) AS o FROM hooked)",
    "scan_page_captures": "SELECT place_id, role, http_status, CASE WHEN content_type = '' OR lower(content_type) LIKE '%html%' THEN html ELSE '' END AS body FROM page_captures",
    "scan_mx": "SELECT * FROM mx",
    "term_expand": TERMS,
    "term_expand_first": f"SELECT * FROM ({TERMS}) WHERE pos < 2",
    "dims_signal_labels": "SELECT signal, count(*) AS leads, label, severity FROM (SELECT unnest(string_split(signals, ' ')) AS signal FROM sig WHERE signals <> '') JOIN (VALUES "
    + ", ".join(f"({lit(a)}, {lit(b)}, {lit(c)})" for a, b, c in V.SIGNAL_LABELS) + ") v(signal, label, severity) USING (signal) GROUP BY ALL",
    "dims_niches": "SELECT suggestion, featured, count(ord) AS leads FROM (VALUES "
    + ", ".join(f"({lit(n)}, {featured})" for n, featured in V.NICHE_SUGGESTIONS) + ") v(suggestion, featured) LEFT JOIN leads ON replace(niche, '-', ' ') = suggestion GROUP BY ALL",
    "dims_markets": "SELECT market_id AS market, label, count(*) AS leads FROM (VALUES "
    + ", ".join(f"({lit(n)}, {lit(m)}, {lit(x)}, {a}, {b}, {c}, {d})" for n, m, x, a, b, c, d in V.CURATED_MARKETS)
    + ") v(vn, market_id, label, s, w, n, e) JOIN leads ON niche = vn AND lat BETWEEN s AND n AND lng BETWEEN w AND e GROUP BY ALL",
    "dims_locations": "SELECT place, region, count(*) AS leads FROM (VALUES "
    + ", ".join(f"({lit(p)}, {lit(r)})" for p, r in V.LOCATION_SEEDS)
    + ") v(place, region) JOIN leads ON contains(address, place) GROUP BY ALL",
    "write_harvest": f"SELECT {HARVEST_TEXT}, '2026-08-01T14:27:26.000Z' AS google_refreshed_at, '20260801-142726_town_gym.csv' AS file FROM places",
    "write_enriched": "SELECT place_id, name, address, phone, website, rating, coalesce(reviews::VARCHAR, '') AS review_count, business_status, primary_type, lat AS latitude, lng AS longitude, checked_at AS google_refreshed_at, email, CASE WHEN email = '' THEN '' ELSE email_alt END AS email_alt, reachable, https, coalesce(ttfb_ms::VARCHAR, '') AS ttfb_ms, viewport AS mobile_viewport, contact_form, final_url, audit_error, total::VARCHAR AS score FROM scored",
    "project_sheet": "SELECT ord, place_id, name, address, phone, email, email_alt, website, rating, reviews, signals, reachable, https, ttfb_ms, viewport AS mobile_viewport, contact_form, business_status, primary_type, lat AS latitude, lng AS longitude, final_url, audit_error, niche, market AS search_location, checked_at AS google_refreshed_at, hook, hook_basis, total AS score, band AS score_band, reasons AS score_why FROM hooked",
    "upsert_leads": "SELECT place_id, first_listed, last_seen, name, phone, email, reviews, signals, review_status, notes, hook_basis, score, score_band, google_refreshed_at FROM upserted",
    "upsert_table": "SELECT place_id, first_listed, last_seen, name, phone, email, reviews, signals, review_status, notes, hook_basis, score, score_band, google_refreshed_at FROM upserted",
    "upsert_table_counts": "SELECT (SELECT count(*) FROM leads WHERE ord % 3 = 0 AND ord % 2 = 1) AS inserted, (SELECT count(*) + count(*) FILTER (WHERE ord % 9 = 0) FROM leads WHERE ord % 6 = 0) AS updated, (SELECT count(*) FROM leads WHERE ord % 2 = 0 OR ord % 3 = 0) AS total",
    "upsert_counts": "SELECT (SELECT count(*) FROM leads WHERE ord % 3 = 0 AND ord % 2 = 1) AS inserted, (SELECT count(*) + count(*) FILTER (WHERE ord % 9 = 0) FROM leads WHERE ord % 6 = 0) AS updated, (SELECT count(*) FROM leads WHERE ord % 2 = 0 OR ord % 3 = 0) AS total",
    "patch_cells": """SELECT s.place_id, s.name, coalesce((SELECT arg_max(value, ord) FROM patches p WHERE p.place_id = s.place_id AND p."column" = 'phone'), s.phone) AS phone,
 coalesce((SELECT arg_max(value, ord) FROM patches p WHERE p.place_id = s.place_id AND p."column" = 'notes'), s.notes) AS notes,
 coalesce((SELECT arg_max(value, ord) FROM patches p WHERE p.place_id = s.place_id AND p."column" = 'review_status'), s.review_status) AS review_status, s.last_seen, s.google_refreshed_at FROM stored_all s""",
    "patch_log": """SELECT ord, place_id, "column", before, after, before <> after AS changed FROM (
 SELECT p.ord, p.place_id, p."column", coalesce(lag(p.value) OVER (PARTITION BY p.place_id, p."column" ORDER BY p.ord), CASE p."column" WHEN 'phone' THEN s.phone WHEN 'notes' THEN s.notes ELSE s.review_status END) AS before, p.value AS after
 FROM patches p JOIN stored_all s USING (place_id))""",
    "patch_violations": """SELECT error, count(*) AS patches, 0::BIGINT AS cells_written FROM (
 SELECT 'column is not patchable' AS error FROM patches WHERE ord % 4 = 0 UNION ALL SELECT 'no lead with this place_id' FROM patches WHERE ord % 3 = 0) GROUP BY 1""",
    "append_run": f"""SELECT max(checked_at) AS finished_at, market AS location, niche, CASE WHEN niche = 'property-management' THEN {lit(' '.join(V.CURATED_NICHES['property-management']))}
  ELSE niche || ' ' || regexp_replace(niche, 's$', '') || ' company ' || regexp_replace(niche, 's$', '') || ' services local ' || niche END AS terms, count(*) AS prospects, count(*) FILTER (WHERE email <> '') AS with_email,
 max(s.tiles) AS tiles, max(s.splits) AS tiles_split, max(s.calls)::BIGINT AS calls_used, 100 AS max_calls, (max(s.calls) * 35 / 1000)::DOUBLE AS estimated_cost_usd, max(d.dropped) AS duplicates_dropped,
 CASE WHEN bool_or(s.halted) THEN 'yes' ELSE 'no' END AS halted, CASE WHEN bool_or(audited) THEN 'no' ELSE 'yes' END AS aborted, max(run_file) AS file
FROM leads l JOIN (SELECT replace(term, ' company', '') AS phrase, sum(tiles_searched)::BIGINT AS tiles, sum(tiles_split)::BIGINT AS splits, bool_or(halted) AS halted, coalesce(sum(calls), 0) AS calls FROM sweeps LEFT JOIN (SELECT term, sum(calls) AS calls FROM swept GROUP BY term) USING (term) GROUP BY 1) s ON s.phrase = l.niche
JOIN (SELECT replace(term, ' company', '') AS phrase, count(*) - count(DISTINCT place_id) AS dropped FROM tile_batches GROUP BY 1) d ON d.phrase = l.niche GROUP BY market, niche""",
    "write_unique": "SELECT file, count(*) AS rows, count(DISTINCT place_id) AS places FROM places, (VALUES ('20260801-142726_town_gym.csv'), ('20260801-142726_town_gym-2.csv')) v(file) GROUP BY 1",
    "run_sidecar": "SELECT run_file AS file, market AS location, niche, count(*) AS prospects, count(*) FILTER (WHERE email <> '') AS with_email, count(*) FILTER (WHERE f_down) AS down, coalesce(printf('%.2f', round(avg(rating), 2)), '—') AS avg_rating FROM sig GROUP BY 1, 2, 3",
    "to_lead": f"""SELECT p.ord, p.place_id, coalesce(p.name, '(unnamed)') AS name, coalesce(p.address, '') AS address, coalesce(p.phone, '') AS phone, coalesce(p.website, '') AS website, {lead_host("coalesce(p.website, '')")} AS host,
 split_part(coalesce(a.emails_text, ''), ' ', 1) AS email, CASE WHEN contains(coalesce(a.emails_text, ''), ' ') THEN regexp_replace(a.emails_text, '^[^ ]* ', '') ELSE '' END AS email_alt, p.rating, p.reviews, coalesce(p.business_status, '') AS business_status,
 coalesce(a.reachable, 'unknown') AS reachable, coalesce(a.https, 'unknown') AS https, a.ttfb_ms, coalesce(a.viewport, 'unknown') AS viewport, coalesce(a.contact_form, 'unknown') AS contact_form, coalesce(a.final_url, '') AS final_url, coalesce(a.audit_error, '') AS audit_error, a.place_id IS NOT NULL AS audited
FROM places p LEFT JOIN audits a ON p.place_id = a.place_id""",
    "filter_places": f"SELECT ord, place_id, rating, reviews, website FROM places WHERE ({DROP.format(p='')}) IS NULL",
    "filter_leads": "SELECT ord, place_id, email FROM leads WHERE email <> ''",
    "drop_report": f"""SELECT reason, count(*) AS count FROM (
 SELECT coalesce({DROP.format(p='p.')}, CASE WHEN coalesce(a.emails_text, '') = '' THEN 'no email found' ELSE '(kept)' END) AS reason FROM places p LEFT JOIN audits a ON p.place_id = a.place_id) GROUP BY 1""",
    "require_email_rows": "SELECT ord, place_id, email, (SELECT count(*) FROM leads WHERE email = '') AS withheld FROM leads WHERE email <> ''",
    "sendable_segment": "SELECT ord, place_id, hook_basis, hook FROM hooked WHERE hook <> ''",
    "valid_boxes": "SELECT *, CASE WHEN floor((ne_lat - sw_lat) * 111 + 0.5) > 120 THEN floor((ne_lat - sw_lat) * 111 + 0.5)::INT END AS wide_km FROM boxes WHERE ne_lng IS NOT NULL AND ne_lat <= 90 AND sw_lat < ne_lat AND sw_lng < ne_lng AND NOT (ne_lat - sw_lat < 0.004 AND ne_lng - sw_lng < 0.004)",
    "box_checks": """SELECT ord, valid, valid AND small AS too_small, CASE WHEN valid AND km > 120 THEN km::INT END AS wide_km FROM (
 SELECT ord, coalesce(ne_lat <= 90 AND sw_lat < ne_lat AND sw_lng < ne_lng, false) AS valid, coalesce(ne_lat - sw_lat < 0.004 AND ne_lng - sw_lng < 0.004, false) AS small, floor((ne_lat - sw_lat) * 111 + 0.5) AS km FROM boxes)""",
    "stale_fields": "SELECT ord, place_id, CASE WHEN ord % 4 <> 0 THEN name END AS name, CASE WHEN ord % 4 <> 0 THEN phone END AS phone, CASE WHEN ord % 4 <> 0 THEN rating END AS rating, CASE WHEN ord % 4 <> 0 THEN reviews END AS reviews, score, hook_basis, ord % 4 = 0 AS stale FROM stored_all",
    "stale_list": "SELECT ord, place_id, name, 45::BIGINT AS age_days FROM stored_all WHERE ord % 4 = 0",
    "stale_excluded": "SELECT ord, place_id, name FROM stored_all WHERE ord % 4 <> 0",
    "disqualify": "SELECT ord, place_id, n AS name, CASE WHEN business_status <> 'OPERATIONAL' THEN 'not operational' WHEN ord % 33 = 0 THEN 'national brand' WHEN ord % 34 = 0 THEN 'software vendor or portal' WHEN phone = '' AND website = '' THEN 'no phone and no website' END AS disqualified FROM (SELECT *, CASE WHEN ord % 33 = 0 THEN 'JLL ' || name WHEN ord % 34 = 0 THEN name || ' on zillow' ELSE name END AS n FROM leads)",
    "join_place_audit": "SELECT p.ord, p.place_id, p.website, a.reachable, a.emails_text AS emails, CASE WHEN a.place_id IS NOT NULL THEN true END AS has_audit FROM places p LEFT JOIN audits a ON p.place_id = a.place_id",
    "join_probe": "SELECT ord, place_id, kind, detail FROM lead_checks WHERE channel = 'site'",
    "join_mx": "SELECT ord, place_id, email, domain, shaped, verdict FROM lead_mx",
    "join_corpus": "SELECT l.ord, l.place_id, l.market, l.niche, c.n, c.up, c.down, c.median_ttfb_ms, c.viewport_bad, c.https_ok FROM leads l JOIN corpora c USING (market, niche)",
    "join_sidecar": """SELECT file, CASE WHEN k THEN location ELSE replace(loc, '-', ' ') END AS location, CASE WHEN k THEN niche ELSE replace(nic, '-', ' ') END AS niche, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at, CASE WHEN k THEN prospects END AS prospects, CASE WHEN k THEN calls_used END AS calls_used, CASE WHEN k THEN (calls_used * 35 / 1000)::DOUBLE END AS estimated_cost_usd
FROM (SELECT *, strftime(finished_at, '%Y%m%d-%H%M%S') || '_' || replace(location, ' ', '-') || '_' || regexp_replace(niche, '[^a-z0-9]+', '-', 'g') || '-' || run_no || '.csv' AS file, run_no % 3 <> 0 AS k, replace(location, ' ', '-') AS loc, regexp_replace(niche, '[^a-z0-9]+', '-', 'g') AS nic FROM runs) ORDER BY file DESC LIMIT 40""",
    "reopen_run": """SELECT file, count(ord) AS prospects, count(ord) FILTER (WHERE email <> '') AS with_email, count(ord) FILTER (WHERE f_down) AS down, coalesce(printf('%.2f', round(avg(rating), 2)), '—') AS avg_rating, run_location, CASE WHEN known THEN max(market) END AS location, coalesce(bool_or(audited), false) AS any_audited, NOT known AS reopened_without_run
FROM (VALUES ('20260801-142726_town-0-pa_building.csv', 'town 0 pa', true), ('20260802-142726_town-1-pa_building-2.csv', 'town 1 pa', false)) v(file, run_location, known) LEFT JOIN sig ON run_file = file GROUP BY file, run_location, known""",
    "tiles_to_pay": "SELECT term, depth, gy, gx, tile_key FROM tile_keys WHERE tile_key NOT IN (SELECT tile_key FROM fresh_cache)",
    "cache_hits": "SELECT term, depth, gy, gx, tile_key FROM tile_keys WHERE tile_key IN (SELECT tile_key FROM fresh_cache)",
    "robots_match": "SELECT page_id, origin, path, allowed FROM verdicts",
    "point_in_tile": f"SELECT ord, place_id, floor((lat - {ROOT['sw_lat']}) / ({ROOT['ne_lat']}::DOUBLE - {ROOT['sw_lat']}::DOUBLE) * 16)::INT AS gy, floor((lng - ({ROOT['sw_lng']})) / ({ROOT['ne_lng']}::DOUBLE - ({ROOT['sw_lng']})::DOUBLE) * 16)::INT AS gx FROM leads",
    "drop_duplicates_anti": "SELECT ord, place_id, total FROM scored WHERE place_id NOT IN (SELECT place_id FROM members) OR place_id IN (SELECT place_id FROM survivors)",
    "summarise": f"SELECT {SUMMARY} FROM sig",
    "summarise_by_run": f"SELECT run_file, {SUMMARY} FROM sig GROUP BY run_file",
    "corpus": "SELECT * FROM corpora",
    "ttfb_median": "SELECT market, niche, median_ttfb_ms FROM corpora WHERE median_ttfb_ms IS NOT NULL",
    "slowest": "SELECT market, niche, slowest_ms FROM corpora WHERE slowest_ms IS NOT NULL",
    "sweep_summary": "SELECT * FROM sweeps",
    "sweep_halted": "SELECT term, depth, gy, gx, item_count, truncated, split, split_blocked_by, calls, calls_before FROM swept",
    "cache_replay": """SELECT k.term, k.depth, k.gy, k.gx, CASE WHEN f.tile_key IS NULL THEN 'paid' ELSE 'cached' END AS source, a.pos::INT AS pos, a.place_id
 FROM tile_keys k LEFT JOIN fresh_cache f ON f.tile_key = k.tile_key JOIN tile_answers a ON a.tile_key = k.tile_key WHERE f.tile_key IS NOT NULL OR k.depth < 3""",
    "cache_use": """SELECT k.term, count(f.tile_key) AS hits, count(*) FILTER (WHERE f.tile_key IS NULL AND k.depth < 3) AS misses, count(*) FILTER (WHERE f.tile_key IS NULL AND k.depth = 3) AS not_reached
 FROM tile_keys k LEFT JOIN fresh_cache f ON f.tile_key = k.tile_key GROUP BY k.term""",
    "cache_next": f"""SELECT k.tile_key, coalesce(f."at", '{NOW.replace(' ', 'T')}.000Z') AS "at", k.truncated, least(k.item_count, 60)::INT AS places
 FROM tile_keys k LEFT JOIN fresh_cache f ON f.tile_key = k.tile_key WHERE f.tile_key IS NOT NULL OR k.depth < 3""",
    "sweep_summary_complete": "SELECT term, count(*) AS tiles_searched, count(*) FILTER (WHERE split) AS tiles_split, max(depth) AS deepest, count(*) FILTER (WHERE truncated AND NOT split) AS truncated_leaves, false AS halted FROM tree GROUP BY term",
    "hook_coverage": "SELECT CASE WHEN hook <> '' THEN basis ELSE 'no hook' END AS basis, count(*) AS leads FROM hooked GROUP BY 1",
    "band_counts": "SELECT band, count(*) AS leads, count(*) FILTER (WHERE email <> '') AS emailable FROM scored GROUP BY 1",
    "audit_summary": """SELECT count(*) AS sites, count(*) FILTER (WHERE emails_text <> '') AS with_email, round(count(*) FILTER (WHERE emails_text <> '') * 100 / count(*), 0)::INT AS with_email_pct, count(*) FILTER (WHERE reachable = 'yes') AS reachable, count(*) FILTER (WHERE reachable = 'no') AS unreachable,
 count(*) FILTER (WHERE robots_blocked) AS robots_blocked, count(*) FILTER (WHERE https = 'yes') AS https_yes, count(*) FILTER (WHERE https = 'no') AS https_no, count(*) FILTER (WHERE viewport = 'no') AS no_viewport, count(*) FILTER (WHERE contact_form = 'yes') AS contact_form,
 list_sort(list(ttfb_ms) FILTER (WHERE ttfb_ms IS NOT NULL))[(count(ttfb_ms) // 2 + 1)::INT]::INT AS median_ttfb_ms, max(ttfb_ms) AS slowest_ms FROM audits""",
    "contact_report": "SELECT count(*) FILTER (WHERE channel = 'site') AS sites_tested, count(*) FILTER (WHERE channel = 'email') AS emails_tested, count(*) FILTER (WHERE channel = 'phone') AS phones_tested, "
    + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {n}" for k, n in [("broken_site", "broken_sites"), ("blocked_site", "blocked_sites"), ("bad_email", "bad_emails"), ("unchecked_email", "unchecked_emails"), ("bad_phone", "bad_phones")]) + " FROM lead_checks",
    "letter_coverage": "SELECT market, niche, count(*) AS prospects, count(*) FILTER (WHERE reachable IN ('yes', 'no')) AS audited, count(*) FILTER (WHERE hook <> '') AS with_gap, count(*) FILTER (WHERE hook <> '' AND email <> '') AS emailable, count(*) FILTER (WHERE hook <> '' AND phone <> '') AS phoneable, count(*) FILTER (WHERE hook = '') AS no_letter, "
    + ", ".join(f"count(*) FILTER (WHERE hook <> '' AND basis = '{b}') AS basis_{b.replace('-', '_')}" for b in V.HOOK_PRIORITY) + " FROM hooked GROUP BY 1, 2",
    "harvest_summary": f"""SELECT count(*) AS prospects, count(website) AS with_website, count(phone) AS with_phone, (SELECT count(DISTINCT place_id) FROM tile_batches) AS unique_found, (SELECT count(*) - count(DISTINCT place_id) FROM tile_batches) AS duplicates_dropped,
 (SELECT count(*) FROM places WHERE {RECORD_FAULTS} <> '') AS malformed_records, (SELECT count(DISTINCT place_id) >= 500 FROM tile_batches) AS partial
FROM (SELECT * FROM collected ORDER BY batch, pos LIMIT 500) WHERE ({DROP.format(p='')}) IS NULL""",
    "duplicate_savings": "SELECT count(*) AS groups, sum(size - 1)::BIGINT AS duplicate_sends FROM (SELECT DISTINCT shared_by, value, size FROM members)",
    "run_cost": "SELECT strftime(finished_at, '%Y-%m') AS month, sum(calls_used)::BIGINT AS calls_used, round((sum(calls_used) * 35 / 1000)::DOUBLE, 3) AS estimated_cost_usd FROM runs GROUP BY 1",
    "dedupe_first": "SELECT place_id, batch, pos, term FROM collected",
    "duplicates_dropped": "SELECT count(DISTINCT place_id) AS unique_rows, count(*) - count(DISTINCT place_id) AS duplicates_dropped FROM tile_batches",
    "dedupe_latest": "SELECT 'p' || o_custkey AS place_id, strftime(o_orderdate, '%Y%m%d') AS file, o_orderkey AS ord, o_totalprice AS reading FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y%m%d') DESC, o_orderkey DESC) = 1",
    "result_cap": "SELECT place_id, batch, pos FROM capped",
    "cap_reached": "SELECT least(count(DISTINCT place_id), 700) AS collected, count(DISTINCT place_id) >= 700 AS result_cap_reached FROM tile_batches",
    # All events are in one winter month, so a Pacific day is UTC minus 8 hours and
    # the two caps apply one after the other.
    "budget_grant": """SELECT account, event_id, want, month, day, granted, CASE WHEN granted < want THEN CASE WHEN 30 - dprev <= 700 - mprev THEN 'day' ELSE 'month' END END AS limited_by,
 mprev + granted AS used, 700 - mprev - granted AS remaining, dprev + granted AS day_used, 30 - dprev - granted AS day_remaining, '2024-02-01 00:00:00' AS resets_at, strftime(day::DATE + INTERVAL 32 HOURS, '%Y-%m-%d %H:%M:%S') AS day_resets_at
FROM (SELECT *, sum(granted) OVER (PARTITION BY account, month ORDER BY ts, event_id)::BIGINT - granted AS mprev, sum(granted) OVER (PARTITION BY account, day ORDER BY ts, event_id)::BIGINT - granted AS dprev
 FROM (SELECT *, (least(700, t) - least(700, t - dg))::BIGINT AS granted FROM (SELECT *, sum(dg) OVER (PARTITION BY account, month ORDER BY ts, event_id) AS t FROM (SELECT *, least(30, w) - least(30, w - want) AS dg FROM (
  SELECT *, sum(want) OVER (PARTITION BY account, day ORDER BY ts, event_id) AS w FROM (SELECT *, strftime(ts, '%Y-%m') AS month, strftime(ts - INTERVAL 8 HOURS, '%Y-%m-%d') AS day FROM budget_requests))))))""",
    "cluster_survivor": "SELECT shared_by, value, size, group_ord, place_id, total FROM survivors",
    "find_duplicates": "SELECT * FROM members",
    "rank_leads": "SELECT ord, place_id, name, total, band, reasons FROM scored ORDER BY total DESC, ord LIMIT 20",
    "page_newest": "SELECT place_id, generation, ord, name FROM upserted ORDER BY generation DESC, ord DESC LIMIT 200 OFFSET 40",
    "page_after": "SELECT place_id, generation, ord, name FROM upserted ORDER BY generation DESC, ord DESC LIMIT 100 OFFSET 100",
    "emails_top3": "SELECT page_id, pos::INT AS pos, email FROM ranked WHERE pos < 3",
    "union_batches": "SELECT term, batch, pos, place_id FROM tile_batches",
    "union_findings": "SELECT ord, place_id, channel, kind FROM lead_checks",
    "distinct_emails": "SELECT page_id, email FROM addresses",
    "signals": "SELECT ord, place_id, signals FROM sig",
    "score_opportunity": "SELECT ord, place_id, opportunity FROM scored",
    "score_reach": "SELECT ord, place_id, reach FROM scored",
    "score_value": "SELECT ord, place_id, value FROM scored",
    "score_total": "SELECT ord, place_id, total, band, reasons FROM scored",
    "phone_key": f"SELECT ord, phone, nullif({DIGITS}, '') AS phone_key FROM leads",
    "host_key": f"SELECT page_id, {host_key('url')} AS host_key FROM pages",
    "owns_domain": f"SELECT ord, name, length(label) >= 3 AND (contains(flat, label) OR (word <> '' AND contains(label, word))) AS owns FROM (SELECT ord, name, split_part({host_key('website')}, '.', 1) AS label, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS flat, regexp_extract(lower(name), '[a-z0-9]{{4,}}') AS word FROM leads)",
    "extract_emails": "SELECT p.page_id, count(r.email)::INT AS found, coalesce(string_agg(r.email, ' ' ORDER BY pos), '') AS emails FROM pages p LEFT JOIN ranked r ON p.page_id = r.page_id GROUP BY 1",
    "email_plausible": f"SELECT page_id, email, {PLAUSIBLE} AS plausible FROM addresses",
    "email_belongs": f"SELECT page_id, email, {BELONGS} AS belongs FROM addresses",
    "email_rank": f"SELECT page_id, email, {POINTS}::INT AS points FROM addresses",
    "links_top2": "SELECT page_id, pos, regexp_extract(url, '^(https?://[^/?#]+)', 1) || link AS link FROM (SELECT page_id, url, unnest(range(2))::INT AS pos, unnest(['/contact-us', regexp_extract(url, '^https?://[^/?#]+(/.*/|/)[^/?#]*([?#].*)?$', 1) || 'staff']) AS link FROM site_pages WHERE page_id % 6 < 4)",
    "contact_links": "SELECT page_id, CASE WHEN page_id % 6 < 4 THEN 3 ELSE 0 END AS found, CASE WHEN page_id % 6 < 4 THEN o || '/contact-us ' || o || regexp_extract(url, '^https?://[^/?#]+(/.*/|/)[^/?#]*([?#].*)?$', 1) || 'staff ' || o || '/Contact-us' ELSE '' END AS links FROM (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o FROM site_pages)",
    "audit_page": """SELECT place_id, role, url, http_status, reachable, CASE WHEN final_url LIKE 'https:%' THEN 'yes' ELSE 'no' END AS https, CASE WHEN reachable = 'yes' THEN ttfb_ms END AS ttfb_ms,
 CASE WHEN reachable <> 'yes' OR body = '' THEN 'unknown' WHEN regexp_matches(body, '<meta[^>]+name\\s*=\\s*["'']viewport["''][^>]*>', 'i') THEN 'yes' ELSE 'no' END AS viewport,
 CASE WHEN reachable = 'yes' AND regexp_matches(body, '<form[\\s>]', 'i') AND regexp_matches(body, 'contact|enquir|inquir|message|get-in-touch|request', 'i') THEN 'yes' ELSE 'unknown' END AS contact_form
FROM (SELECT *, CASE WHEN http_status BETWEEN 200 AND 399 THEN 'yes' WHEN http_status >= 500 THEN 'no' ELSE 'unknown' END AS reachable, CASE WHEN content_type = '' OR lower(content_type) LIKE '%html%' THEN html ELSE '' END AS body FROM page_captures)""",
    "audit_site": """SELECT place_id, url AS input_url, CASE WHEN status IS NOT NULL THEN landed END AS final_url, reach AS reachable, CASE WHEN status IS NULL THEN 'unknown' WHEN landed LIKE 'https:%' THEN 'yes' ELSE 'no' END AS https, CASE WHEN reach = 'yes' THEN ms END AS ttfb_ms,
 CASE WHEN NOT loaded THEN 'unknown' WHEN page_id % 2 = 0 THEN 'yes' ELSE 'no' END AS viewport,
 CASE WHEN loaded AND (page_id % 3 < 2 AND regexp_matches(body, 'contact|enquir|inquir|message|get-in-touch|request', 'i') OR home_emails = '' AND read_contact) THEN 'yes' WHEN loaded AND home_emails = '' AND page_id % 6 >= 4 THEN 'no' ELSE 'unknown' END AS contact_form,
 CASE WHEN NOT loaded THEN '' WHEN home_emails <> '' THEN home_emails WHEN read_contact THEN contact_email ELSE '' END AS emails,
 CASE WHEN status IS NULL THEN 0 WHEN loaded AND home_emails = '' AND read_contact THEN 2 ELSE 1 END::INT AS pages_fetched, status AS http_status, CASE WHEN NOT here THEN 'robots.txt disallows this path' WHEN status IS NULL THEN failure END AS error, NOT here AS robots_blocked FROM judged""",
    "parse_robots": "SELECT * FROM rules",
    "robots_allowed": "SELECT page_id, allowed FROM verdicts",
    "phone_problem": f"SELECT ord, phone, {PHONE_PROBLEM} AS problem FROM leads",
    "market_rule": f"SELECT ord, {IS_PH} AS is_ph FROM leads",
    "email_shape": f"SELECT ord, email, {PRESENT.format('email')} AS present, regexp_matches(email, '^[^\\s@]+@[^\\s@.]+(\\.[^\\s@.]+)+$') AS shaped FROM leads",
    "contact_findings": "SELECT ord, place_id, kind, detail FROM lead_checks WHERE kind IS NOT NULL",
    "contact_markdown": f"SELECT list_position([{values(k for k, _, _ in SECTIONS)}], kind)::INT AS section_no, CASE kind {' '.join(f'WHEN {lit(k)} THEN {lit(t)}' for k, t, _ in SECTIONS)} END AS section, ord, '- [' || CASE WHEN {IS_PH} THEN 'PH' ELSE 'US' END || '] **' || name || '** — ' || detail AS line FROM lead_checks WHERE kind IS NOT NULL",
    "contact_table": f"""SELECT (i - 1)::INT AS line_no, line FROM (
 SELECT 1 AS i, '# Contact verification — ' || (SELECT count(*) FROM leads) || ' leads' AS line UNION ALL SELECT 2, 'Run {NOW[:10]}. No Places quota was spent: this is direct HTTP and DNS only.'
 UNION ALL SELECT 3, '| Check | How certain | Tested | Failed |' UNION ALL SELECT 4, '|---|---|---|---|'
 UNION ALL SELECT i, '| ' || name || ' | ' || sure || ' | ' || (SELECT count(*) FROM lead_checks c WHERE c.channel = v.channel) || ' | **' || (SELECT count(*) FROM lead_checks c WHERE c.kind = v.failed) || '** |'
 FROM (VALUES (5, 'Website loads', 'Actually fetched', 'site', 'broken_site'), (6, 'Email domain accepts mail', 'MX looked up', 'email', 'bad_email'), (7, 'Phone is dialable', 'Format only', 'phone', 'bad_phone')) v(i, name, sure, channel, failed))""",
    "contact_headings": "SELECT i::INT AS section_no, '## ' || title || ' — ' || count(c.kind) AS heading, note, CASE WHEN count(c.kind) = 0 THEN '_Nothing found._' ELSE '' END AS empty FROM (VALUES "
    + ", ".join(f"({i}, {lit(k)}, {lit(t)}, {lit(n or '')})" for i, (k, t, n) in enumerate(SECTIONS, 1)) + ") v(i, k, title, note) LEFT JOIN lead_checks c ON c.kind = k GROUP BY i, title, note",
    "audience": f"SELECT ord, niche, {audience('niche')} AS audience FROM leads",
    "hook": "SELECT ord, place_id, hook AS text, audience, basis, reason FROM hooked",
    "check_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%-d %b') END AS checked_on FROM orders",
    "benchmark": "SELECT ord, place_id, benchmark FROM compared",
    "market_findings": f"SELECT market, niche, {FINDINGS} AS findings FROM corpora",
    "letters": f"""SELECT ord, place_id, market, niche, basis, {case([("basis = 'down'", f"name || ' — your site didn''t load on ' || {CHECKED}"), ("basis = 'no-site'", f"{REVIEWS} || ' reviews, no website'"), ("basis = 'slow'", f"name || ' takes ' || {secs('ttfb_ms')} || ' seconds to load'"), ("basis = 'no-viewport'", "name || ' on a phone'"), ("basis = 'insecure'", "'browsers are flagging ' || name")], 'name')} AS subject,
 CASE WHEN email = '' THEN '— no public address found —' ELSE email END AS recipient,
 concat_ws({NL2}, 'Hi there,', hook, nullif(benchmark, ''), {lit(OFFER)}, 'I am not asking for a meeting. If you want it, reply "send it" and I will write up everything we found on ' || name || ' — what we checked, what we measured, and what I would fix first. No charge, no call, and I will not follow up unless you ask me to.', {lit(SIGN)}) AS body,
 concat_ws({NL2}, {lit(S['company'])}, {lit(S['address'])}, 'You are getting this because ' || name || ' is listed publicly in ' || place_name || ' and its website is publicly reachable. ' || {lit(OPTOUT)}) AS footer
FROM compared WHERE hook <> ''""",
    "letters_ordered": f"""SELECT ord, place_id, basis, coalesce(list_position([{values(V.LETTER_ORDER)}], basis), 0)::BIGINT AS basis_rank, {case([("basis = 'down'", f"name || ' — your site didn''t load on ' || {CHECKED}"), ("basis = 'no-site'", f"{REVIEWS} || ' reviews, no website'"), ("basis = 'slow'", f"name || ' takes ' || {secs('ttfb_ms')} || ' seconds to load'"), ("basis = 'no-viewport'", "name || ' on a phone'"), ("basis = 'insecure'", "'browsers are flagging ' || name")], 'name')} AS subject FROM hooked WHERE hook <> ''""",
    "campaign_letter": f"""SELECT market, niche, 'we checked ' || n || ' ' || many || ' in ' || label AS subject_1, down || ' of ' || n || ' ' || label || ' ' || many || ' had no working site' AS subject_2, 'what we found checking every ' || one || ' in ' || label AS subject_3,
 concat_ws({NL2}, 'Hi there,', 'On ' || checked_on || ' we checked the public website of every ' || one || ' we could find listed on Google Maps in and around ' || label || ' — ' || n || ' of them. We wanted to see what ' || looker || ' actually runs into when they look one of you up.', {FINDINGS},
  'We have the individual result for every firm on that list, including yours. If you want yours, reply "send it" and I will write it up — what we checked, what it measured, and what I would fix first. No charge, no call, and I will not follow up unless you ask me to.', {lit(OFFER)}, {lit(SIGN)}) AS body,
 concat_ws({NL2}, {lit(S['company'])}, {lit(S['address'])}, 'You are getting this because your company is listed publicly in ' || label || '. ' || {lit(OPTOUT)}) AS footer,
 concat_ws(chr(10), n || ' audited — rows whose site was actually fetched. ' || leads || ' were harvested; the difference is sites whose own robots.txt disallowed us.', down || ' did not load — reachable = no.', up || ' loaded — reachable = yes.',
  {secs('coalesce(median_ttfb_ms, 0)')} || 's median — middle time-to-first-byte across the ' || up || ' that answered.', {secs('slowest_ms')} || 's slowest — highest time-to-first-byte in the same set.', viewport_bad || ' not built for phones — no mobile viewport, among sites that loaded.', https_bad || ' still on http — no HTTPS after redirects, among sites that loaded.') AS provenance
FROM (SELECT c.*, {plural('c.niche')} AS many, {countable('c.niche', 'business')} AS one, {by_key(V.LOOKERS, '(' + audience('c.niche') + ')')} AS looker, {LETTER_MARKET} AS label, (SELECT {iso_day('max(checked_at)')} FROM leads l WHERE l.market = c.market AND l.niche = c.niche) AS checked_on FROM corpora c WHERE n >= 30)""",
    "campaign_refusals": "SELECT market, niche, n, CASE WHEN n = 0 THEN 'no audited rows' ELSE 'too few audited rows for a survey' END AS refused FROM (SELECT CASE WHEN business_status = '' THEN market ELSE market || ' ' || lower(business_status) END AS market, niche, count(*) FILTER (WHERE reachable IN ('yes', 'no')) AS n FROM leads GROUP BY 1, 2) WHERE n < 30",
    "niche_words": f"SELECT p_partkey, {countable('niche', 'business')} AS countable, {plural('niche')} AS plural, {by_key(V.LOOKERS, '(' + audience('niche') + ')')} AS looker FROM (SELECT p_partkey, p_name || ['', '-management', ' Agency', ' box', ' law', ' dental_clinic', ' daycare'][p_partkey % 7 + 1] AS niche FROM part)",
    "market_label": "SELECT doc_id, upper(left(source, 1)) || substr(source, 2) || CASE doc_id % 3 WHEN 0 THEN ', NJ' WHEN 1 THEN ', PA' ELSE '' END AS label FROM documents",
    "slug": "SELECT doc_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), '-+$', ''), ''), 'untitled') AS slug, length(text)::INT AS chars FROM documents",
    "run_name": "SELECT run_no, strftime(finished_at, '%Y%m%d-%H%M%S') || '_' || replace(location, ' ', '-') || '_' || regexp_replace(regexp_replace(niche, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS run_name FROM runs",
    "tile_key": "SELECT term, depth, gy, gx, tile_key FROM tile_keys",
    "fresh": 'SELECT tile_key, "at" FROM fresh_cache',
    "calendar_keys": "SELECT event_id, strftime(ts, '%Y-%m') AS month_key, strftime(ts - INTERVAL 8 HOURS, '%Y-%m-%d') AS day_key FROM events",
    "next_resets": "SELECT o_orderkey, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS month_reset, strftime(timezone('UTC', timezone('America/Los_Angeles', date_trunc('day', timezone('America/Los_Angeles', timezone('UTC', ts))) + INTERVAL 1 DAY)), '%Y-%m-%d %H:%M:%S') AS day_reset FROM (SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS ts FROM orders)",
    "quota_class": "SELECT event_id, kind, CASE event_id % 4 WHEN 0 THEN 'TextSearchPerDay' || (event_id % 7) WHEN 1 THEN 'Rate' || (event_id % 7) END AS limit_name, status = 429 AND coalesce(kind = 'daily', false) AS fatal FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'rate' END AS kind FROM quota_errors)",
    "quadrants": """SELECT ord, sw_lat, sw_lng, ne_lat, ne_lng, k AS child_no, name AS child, CASE WHEN k >= 2 THEN mlat ELSE sw_lat END AS c_sw_lat, CASE WHEN k % 2 = 1 THEN mlng ELSE sw_lng END AS c_sw_lng, CASE WHEN k >= 2 THEN ne_lat ELSE mlat END AS c_ne_lat, CASE WHEN k % 2 = 1 THEN ne_lng ELSE mlng END AS c_ne_lng
FROM (SELECT *, (sw_lat + ne_lat) / 2 AS mlat, (sw_lng + ne_lng) / 2 AS mlng FROM boxes WHERE ne_lng IS NOT NULL AND ne_lat <= 90 AND sw_lat < ne_lat AND sw_lng < ne_lng), (VALUES (0, 'SW'), (1, 'SE'), (2, 'NW'), (3, 'NE')) v(k, name)""",
    "quadtree_tiles": "SELECT * FROM tree",
    "tile_plan": "SELECT term, count(*) AS tiles, sum(greatest(ceil(least(item_count, 60) / 20), 1))::BIGINT AS calls, sum(greatest(ceil(least(item_count, 60) / 20), 1)) * 35 / 1000 AS estimated_cost_usd FROM tree GROUP BY term",
    "job_rank": """SELECT ord, place_id, total, file FROM (
 SELECT l.ord, l.place_id, coalesce(f.total, l.total) AS total, CASE WHEN f.ord IS NULL THEN '20260801.csv' ELSE '20260802.csv' END AS file FROM scored l LEFT JOIN fresh_scored f ON f.ord = l.ord) ORDER BY total DESC, ord LIMIT 20""",
    "job_search": f"""SELECT place_id, batch, pos, signals, total FROM ({score_columns("(" + signal_columns(f'''(SELECT c.place_id, c.batch, c.pos, coalesce(p.name, '(unnamed)') AS name, coalesce(p.phone, '') AS phone, coalesce(p.website, '') AS website, split_part(coalesce(a.emails_text, ''), ' ', 1) AS email, p.rating, p.reviews, coalesce(a.reachable, 'unknown') AS reachable, coalesce(a.https, 'unknown') AS https, a.ttfb_ms, coalesce(a.viewport, 'unknown') AS viewport, coalesce(a.contact_form, 'unknown') AS contact_form, a.place_id IS NOT NULL AS audited
 FROM capped c JOIN places p ON p.place_id = c.place_id LEFT JOIN audits a ON a.place_id = c.place_id WHERE ({DROP.format(p='p.')}) IS NULL)''') + ")")}) WHERE email <> ''""",
}

# The ledger row by row: each step reads the state the step before left behind.
_FOLD = """
 fold AS (
  SELECT account, rn, '' AS month, '' AS day, 0::BIGINT AS used, 0::BIGINT AS day_used, 0::BIGINT AS event_id, NULL::BIGINT AS granted, NULL::VARCHAR AS limited_by, '' AS kind, '' AS month_l, '' AS day_l
  FROM (SELECT DISTINCT account, 0::BIGINT AS rn FROM numbered)
  UNION ALL
  SELECT account, rn, month, day,
   CASE WHEN kind = 'reserve' THEN mu + g WHEN month_l = month THEN greatest(used - credit, 0) ELSE used END,
   CASE WHEN kind = 'reserve' THEN du + g WHEN month_l = month AND day_l = day THEN greatest(day_used - credit, 0) ELSE day_used END,
   event_id, CASE WHEN kind = 'reserve' THEN g END, CASE WHEN kind = 'reserve' AND g < want THEN CASE WHEN 30 - du <= 500 - mu THEN 'day' ELSE 'month' END END, kind,
   CASE WHEN kind = 'reserve' THEN month ELSE month_l END, CASE WHEN kind = 'reserve' THEN day ELSE day_l END
  FROM (SELECT *, greatest(least(want, 500 - mu, 30 - du), 0) AS g FROM (
   SELECT n.account, n.rn, n.month, n.day, n.event_id, n.kind, n.want, greatest(0, n.reserved - greatest(0, n.actual)) AS credit, f.used, f.day_used, f.month_l, f.day_l,
    CASE WHEN f.month_l = n.month THEN f.used ELSE 0 END AS mu, CASE WHEN f.day_l = n.day THEN f.day_used ELSE 0 END AS du
   FROM fold f JOIN numbered n ON n.account = f.account AND n.rn = f.rn + 1)))
"""
_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) AS rn, strftime(ts, '%Y-%m') AS month, strftime(ts - INTERVAL 8 HOURS, '%Y-%m-%d') AS day FROM ledger_events)"
STEPS = "SELECT account, event_id, kind, month, day, granted, limited_by, used, day_used FROM fold WHERE rn > 0"
RECURSIVE = {
    "budget_settle": STEPS,
    "budget_stream": STEPS.replace(" FROM fold", ", false AS late FROM fold"),
    "budget_peek": """SELECT account, u AS used, 500 - u AS remaining, d AS day_used, 30 - d AS day_remaining, '2024-02-01 00:00:00' AS resets_at, '2024-01-31 08:00:00' AS day_resets_at, u < 500 AND d < 30 AS can_search
FROM (SELECT account, CASE WHEN month_l = '2024-01' THEN used ELSE 0 END AS u, CASE WHEN day_l = '2024-01-30' THEN day_used ELSE 0 END AS d FROM fold QUALIFY row_number() OVER (PARTITION BY account ORDER BY rn DESC) = 1)""",
}


def _closure(sql: str, defs: dict) -> list[str]:
    """Names of the definitions `sql` reads, in definition order."""
    needed: set[str] = set()

    def visit(text):
        for name in defs:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|, {name}\b(?= [a-z]\b)", text):
                needed.add(name)
                visit(defs[name])

    visit(sql)
    return [n for n in defs if n in needed]


def _ordered(names: list[str], defs: dict) -> list[str]:
    done: list[str] = []

    def add(name):
        for other in _closure(defs[name], defs):
            if other != name and other not in done:
                add(other)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return done


#: Whole jobs whose rows are those of one of their operators.
JOBS = {"job_letters": "letters_ordered", "job_verify": "contact_findings"}


def oracle_sql() -> dict[str, str]:
    defs = VIEWS | HELPERS
    out = {}
    for name, body in (ORACLES | {job: ORACLES[name] for job, name in JOBS.items()}).items():
        names = _ordered(_closure(body, defs), defs)
        ctes = ", ".join(f"{n} AS ({defs[n]})" for n in names)
        out[name] = f"WITH {ctes} {body}" if ctes else body
    for name, body in RECURSIVE.items():
        out[name] = f"WITH RECURSIVE ledger_events AS ({VIEWS['ledger_events']}), {_NUMBERED}, {_FOLD} {body}"
    return out
