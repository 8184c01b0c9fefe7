"""Lead tables derived from the benchmark tables.

The same SELECT runs in Spark and in other SQL engines, so a query and its check
start from identical rows. Each entry is (view name, SELECT); a view may read the
ones before it.
"""

VIEWS = {
    # One lead per customer; the website is one of the captured pages.
    "leads": """
 SELECT k.ord, k.place_id, k.market, k.niche, k.phone, k.email, k.email_alt, k.rating, k.reviews,
  k.lat, k.lng, k.reachable, k.viewport, k.contact_form, k.ttfb_ms, k.audited, k.address,
  k.business_status, k.primary_type, k.audit_error, k.checked_at, k.run_file,
  CASE WHEN k.ord % 9 = 0 THEN '' ELSE p.url END AS website,
  CASE WHEN p.url LIKE 'https:%' THEN 'yes' ELSE 'no' END AS https,
  CASE WHEN k.ord % 9 = 0 THEN '' ELSE p.url END AS final_url,
  CASE WHEN k.ord % 3 = 0 THEN concat(upper(substr(regexp_extract(p.url, '^https?://(www[.])?([a-z]+)', 2), 1, 1)), substr(regexp_extract(p.url, '^https?://(www[.])?([a-z]+)', 2), 2), ' Holdings') ELSE k.c_name END AS name
 FROM (
  SELECT c_custkey AS ord, c_name, c_custkey % (SELECT count(*) FROM pages) AS page_no,
   concat('p', CAST(c_custkey AS STRING)) AS place_id,
   concat('town ', CAST(c_nationkey % 5 AS STRING), ' pa') AS market,
   CASE c_mktsegment WHEN 'BUILDING' THEN 'property-management' WHEN 'AUTOMOBILE' THEN 'auto repair shop' WHEN 'HOUSEHOLD' THEN 'cleaning service' WHEN 'MACHINERY' THEN 'hvac contractors' ELSE lower(c_mktsegment) END AS niche,
   CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 41 = 1 THEN '(646) 555-0142 ext. 106' WHEN c_custkey % 43 = 1 THEN 'call us' WHEN c_custkey % 10 = 4 THEN concat('0917 ', CAST(100 + c_custkey % 900 AS STRING), ' ', CAST(1000 + (c_custkey * 7) % 9000 AS STRING))
    ELSE concat('(215) ', lpad(CAST(100 + c_custkey % 297 AS STRING), 3, '0'), '-', lpad(CAST((c_custkey * 37) % 700 AS STRING), 4, '0')) END AS phone,
   CASE WHEN c_custkey % 7 >= 3 THEN '' WHEN c_custkey % 49 = 2 THEN 'not-an-address' ELSE concat(CASE WHEN c_custkey % 2 = 0 THEN 'info' ELSE 'Info' END, '@firm', CAST(c_custkey % 601 AS STRING), '.example.com') END AS email,
   CASE WHEN c_custkey % 14 = 0 THEN concat('sales@firm', CAST(c_custkey % 97 AS STRING), '.example.com office@mail', CAST(c_custkey % 5 AS STRING), '.example.org') ELSE '' END AS email_alt,
   CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(10 + (c_custkey * 7) % 41 AS DOUBLE) / CAST(10 AS DOUBLE) END AS rating,
   CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST((c_custkey * 19) % 240 AS INT) END AS reviews,
   CAST(39.867 AS DOUBLE) + CAST(0.271 AS DOUBLE) * CAST((c_custkey * 7919) % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat,
   CAST(-75.28 AS DOUBLE) + CAST(0.324 AS DOUBLE) * CAST((c_custkey * c_custkey) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS lng,
   CASE WHEN c_custkey % 9 = 0 THEN 'no' WHEN c_custkey % 5 = 0 THEN 'no' WHEN c_custkey % 8 = 0 THEN 'unknown' ELSE 'yes' END AS reachable,
   CASE WHEN c_custkey % 6 = 0 THEN 'no' ELSE 'yes' END AS viewport,
   CASE WHEN c_custkey % 4 = 0 THEN 'no' WHEN c_custkey % 4 = 1 THEN 'yes' ELSE 'unknown' END AS contact_form,
   CASE WHEN c_custkey % 16 = 0 THEN NULL ELSE CAST((c_custkey * 313) % 4000 AS INT) END AS ttfb_ms,
   c_custkey % 10 <> 3 AS audited,
   CASE WHEN c_custkey % 10 = 4 THEN concat('Unit ', CAST(c_custkey AS STRING), ', Makati City, Philippines') WHEN c_custkey % 19 = 0 THEN '' ELSE concat(CAST(c_custkey AS STRING), ' "Market" St, Philadelphia, PA, USA') END AS address,
   CASE WHEN c_custkey % 25 = 7 THEN 'CLOSED_TEMPORARILY' WHEN c_custkey % 50 = 8 THEN '' ELSE 'OPERATIONAL' END AS business_status,
   lower(c_mktsegment) AS primary_type,
   CASE WHEN c_custkey % 5 = 0 THEN 'connect timeout' ELSE '' END AS audit_error,
   concat('2026-08-', lpad(CAST(1 + c_nationkey % 5 AS STRING), 2, '0'), 'T14:27:26Z') AS checked_at,
   concat('2026080', CAST(1 + c_nationkey % 5 AS STRING), '-142726_town-', CAST(c_nationkey % 5 AS STRING), '-pa_', lower(c_mktsegment), CASE WHEN c_nationkey % 2 = 0 THEN '-2' ELSE '' END, '.csv') AS run_file
  FROM customer) k
 JOIN pages p ON p.page_id = k.page_no
""",
    # Listings as collected: absent fields are NULL.
    "places": """
 SELECT ord, place_id, market, niche, CASE WHEN ord % 21 = 0 THEN NULL ELSE name END AS name,
  nullif(address, '') AS address, nullif(phone, '') AS phone, nullif(website, '') AS website,
  rating, reviews, nullif(business_status, '') AS business_status, primary_type, lat, lng
 FROM leads
""",
    "audits": """
 SELECT place_id, CASE WHEN email = '' THEN '' WHEN email_alt = '' THEN email ELSE concat(email, ' ', email_alt) END AS emails_text,
  reachable, https, ttfb_ms, viewport, contact_form, final_url, nullif(audit_error, '') AS audit_error, ord % 8 = 0 AS robots_blocked
 FROM leads WHERE audited
""",
    # Per-term batches: the second phrase finds part of the listings again.
    "tile_batches": """
 SELECT 1 AS batch, ord AS pos, place_id, niche AS term, lat, lng, website, phone, rating, reviews FROM places
 UNION ALL
 SELECT 2 AS batch, -ord AS pos, place_id, concat(niche, ' company') AS term, lat, lng, website, phone, rating, reviews FROM places WHERE ord % 3 = 0
""",
    "budget_requests": """
 SELECT concat('u', CAST(user_id % 4 AS STRING)) AS account, event_id, CAST(ts AS TIMESTAMP) AS ts, 1 + event_id % 3 AS want
 FROM events
""",
    "ledger_events": """
 SELECT concat('u', CAST(user_id % 20 AS STRING)) AS account, event_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_type = 'click' THEN 'settle' ELSE 'reserve' END AS kind,
  CASE WHEN event_type = 'click' THEN 0 ELSE 1 + event_id % 3 END AS want,
  CASE WHEN event_type = 'click' THEN 1 + event_id % 4 ELSE 0 END AS reserved,
  CASE WHEN event_type = 'click' THEN event_id % 3 ELSE 0 END AS actual
 FROM events
""",
    "quota_errors": """
 SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 503 ELSE 429 END AS status,
  CASE event_id % 4 WHEN 0 THEN concat('RESOURCE_EXHAUSTED: limit ''TextSearchPerDay', CAST(event_id % 7 AS STRING), ''' per day')
   WHEN 1 THEN concat('Quota exceeded for limit ''Rate', CAST(event_id % 7 AS STRING), ''' per minute')
   WHEN 2 THEN 'quota exceeded' ELSE concat('backend failure ', event_type) END AS body
 FROM events WHERE event_type = 'error'
""",
    # One saved run per order.
    "runs": """
 SELECT o_orderkey AS run_no, o_orderdate AS finished_at, concat('town ', CAST(o_custkey % 5 AS STRING), ' pa') AS location,
  lower(o_orderpriority) AS niche, CAST(o_custkey % 90 AS INT) AS calls_used, CAST(o_orderkey % 300 AS INT) AS prospects
 FROM orders
""",
    # Pages with the markup a firm's own site has, grown onto the captured text.
    "site_pages": """
 SELECT page_id, concat('p', CAST(page_id AS STRING)) AS place_id, url,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS site_host,
  concat(html,
   CASE WHEN page_id % 2 = 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END,
   CASE WHEN page_id % 3 = 0 THEN '<form action="/send">Request a quote</form>' WHEN page_id % 3 = 1 THEN '<form >' ELSE '' END,
   CASE WHEN page_id % 4 = 0 THEN concat('<a href="mailto:%20Info@', regexp_extract(url, '^https?://([^/?#]+)', 1), '?subject=x">x</a> zz9@', regexp_extract(url, '^https?://([^/?#]+)', 1), ' firm', CAST(page_id AS STRING), '@gmail.com, noreply@gmail.com') ELSE '' END,
   CASE WHEN page_id % 5 = 0 THEN '<script type="application/ld+json">{"email":"Office.Desk@yahoo.com"}</script><script>var a="dev@gmail.com";</script><!-- old@gmail.com --><style>/* font@gmail.com */</style>' ELSE '' END,
   CASE WHEN page_id % 6 < 4 THEN concat('<a href="/contact-us#form">c</a><a href="https://other.example.org/contact">o</a><a HREF=''about/../staff''>s</a><a href="mailto:contact@x.y">m</a><a href="/Contact-us">d</a>') ELSE '' END) AS html
 FROM pages
""",
    # One capture per place and role; some homes fail, some answer 4xx or 5xx.
    "page_captures": """
 SELECT place_id, 'home' AS role, 0 AS link_no, url, CASE WHEN page_id % 12 = 5 THEN replace(url, 'http:', 'https:') ELSE url END AS final_url,
  CASE WHEN page_id % 10 = 3 THEN NULL WHEN page_id % 17 = 1 THEN 403 WHEN page_id % 19 = 1 THEN 503 ELSE 200 END AS http_status,
  CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'TEXT/HTML' WHEN 2 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
  CAST((page_id * 97) % 4000 AS INT) AS ttfb_ms, html, CASE WHEN page_id % 10 = 3 THEN 'connect refused' ELSE NULL END AS error
 FROM site_pages
 UNION ALL
 SELECT place_id, 'home_https', 0, replace(url, 'http:', 'https:'), replace(url, 'http:', 'https:'), 200, 'text/html', CAST(350 AS INT), html, NULL
 FROM site_pages WHERE page_id % 20 = 3
 UNION ALL
 SELECT place_id, 'contact', 1, concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/contact-us'), NULL, CASE WHEN page_id % 8 = 1 THEN NULL ELSE 200 END,
  'text/html', CAST(100 AS INT), concat('<form>Contact</form> hello@', CASE WHEN page_id % 3 = 0 THEN site_host ELSE 'elsewhere.example.net' END), NULL
 FROM site_pages WHERE page_id % 2 = 1
""",
    # One robots file per origin.
    "robots_captures": """
 SELECT origin, CASE WHEN n % 9 = 8 THEN 404 ELSE 200 END AS http_status,
  CASE WHEN n % 6 = 5 THEN 'text/html' WHEN n % 10 = 9 THEN 'application/json' ELSE 'Text/Plain' END AS content_type,
  concat('User-agent: BadBot', chr(10), 'Disallow: /', chr(13), chr(10), 'user-agent : *  # all', chr(10),
   CASE n % 4 WHEN 0 THEN concat('Disallow: /*/9', chr(10), 'Allow: /en/9*.html$') WHEN 1 THEN concat('Disallow: /fr # no', chr(10), 'disallow:', chr(10), 'Allow: /fr/8')
    WHEN 2 THEN 'Disallow: /*5$' ELSE concat('Disallow: /es/', chr(10), 'Allow: /es/', chr(10), 'Disallow: /contact') END) AS text
 FROM (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, min(page_id) AS n FROM pages GROUP BY 1) o
""",
    "mx_results": """
 SELECT domain, n % 7 <> 3 AS http_ok, CAST(CASE n % 5 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS INT) AS status, CAST(CASE WHEN n % 5 = 0 THEN 0 ELSE 2 END AS INT) AS answers
 FROM (SELECT concat('firm', CAST(c_custkey % 601 AS STRING), '.example.com') AS domain, min(c_custkey) AS n FROM customer GROUP BY 1) d
 WHERE n % 11 <> 10
""",
    "probes": """
 SELECT place_id, ord % 8 = 0 AS robots_blocked, reachable, CASE WHEN ord % 10 = 0 THEN 503 ELSE NULL END AS http_status, nullif(audit_error, '') AS error
 FROM leads WHERE ord % 12 <> 7
""",
    # Boxes around every lead, from a building to half a continent.
    "boxes": """
 SELECT ord, lat - CAST(0.001 AS DOUBLE) * (ord % 7) AS sw_lat, lng - CAST(0.001 AS DOUBLE) * (ord % 5) AS sw_lng,
  CASE WHEN ord % 23 = 0 THEN CAST(95 AS DOUBLE) ELSE lat + CAST(0.001 AS DOUBLE) * (1 + ord % 7) * (CASE WHEN ord % 6 = 0 THEN 400 ELSE 1 END) END AS ne_lat,
  CASE WHEN ord % 29 = 0 THEN NULL ELSE lng + CAST(0.001 AS DOUBLE) * (ord % 5) END AS ne_lng
 FROM leads
""",
}

ORDER = list(VIEWS)
