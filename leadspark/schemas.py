"""Table schemas."""

PLACE_SCHEMA = """
    id string,
    displayName struct<text: string, languageCode: string>,
    formattedAddress string,
    nationalPhoneNumber string,
    websiteUri string,
    rating double,
    userRatingCount int,
    businessStatus string,
    primaryType string,
    types array<string>,
    location struct<latitude: double, longitude: double>
"""

PAGE_CAPTURE_SCHEMA = """
    place_id string, role string, link_no int, url string, final_url string,
    http_status int, content_type string, ttfb_ms int, html string, error string
"""

ROBOTS_CAPTURE_SCHEMA = "origin string, http_status int, content_type string, text string"

MX_SCHEMA = "domain string, http_ok boolean, status int, answers int"

LEDGER_EVENT_SCHEMA = """
    account string, event_id long, ts timestamp, kind string,
    want long, reserved long, actual long
"""
