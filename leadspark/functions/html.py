"""Facts read out of captured HTML: addresses, contact links, page checks.

Everything is an in-row expression of a cost linear in the text, hostile markup
included. Callers take the facts of a capture before they group or join, so no page
text reaches a shuffle.
"""

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .derive import first_match, let

# Marks a double dot in an address run, or an opening mark that nothing closes.
_BREAK = "\u0001"
# Stands where an element was taken out, and before one that stays.
_CUT = "\u0002"
# The fixed address pattern written without a repeated group, which would recurse once
# per label: with double dots marked, a host is one flat run of label characters. A match
# can only begin where an address run begins, so such a run is read once.
_RUN = f"A-Za-z0-9._%+{_BREAK}-"
_EMAIL_AT_RUN_START = rf"(?:\G|(?<![{_RUN}]))([{_RUN}]+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{{2,}})"


def _before(text: Column, tail: Column) -> Column:
    return F.left(text, F.length(text) - F.length(tail))


def _without_comments(html: Column) -> Column:
    """Only what stands before the last closing mark can be a comment."""

    def cut(tail):
        return F.concat(F.regexp_replace(_before(html, tail), r"<!--[\s\S]*?-->", " "), tail)

    return F.when(F.contains(html, F.lit("-->")), let(F.substring_index(html, "-->", -1), cut)).otherwise(html)


def _replaced(text: Column, cut: str, brk: str) -> Column:
    return F.replace(F.replace(text, F.lit(_CUT), F.lit(cut)), F.lit(_BREAK), F.lit(brk))


def _lowered(text: Column) -> Column:
    """`text` with A-Z lowered and every character in its place.

    Lowering as a whole is quick; only where it changes the length (a dotted capital I
    becomes two characters) are the letters replaced one by one.
    """

    def checked(low):
        return F.when(F.length(low) == F.length(text), low).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))

    return let(F.lower(text), checked)


def _without_element(html: Column, name: str, kept: str | None = None) -> Column:
    """Without the elements `name`; those whose opening tag holds `kept` stay.

    What stands behind the last closing tag is set aside by its length. An opening tag is
    looked for only where a `>` and a closing tag follow, so every attempt succeeds and
    the text is read once. `kept` is matched first and skipped as one piece.
    """
    closing = f"</{name}>"
    keep = rf"(<{name}\b[^>]*{kept})|" if kept else "()"

    def cut(behind):
        end = F.length(html) - behind

        def joined(parts):
            body, loose = parts["body"], parts["loose"]
            marked = F.regexp_replace(loose, rf"(?i)<(?={name})", "<" + _BREAK)
            pattern = rf"(?i){keep}<{name}\b[^>]*>[\s\S]*?</{name}>"
            close = F.substr(html, end - (len(closing) - 1), F.lit(len(closing)))
            text = F.regexp_replace(F.concat(_before(body, loose), marked, close), pattern, _CUT + "$1")
            if kept:
                text = F.regexp_replace(text, rf"(?i){_CUT}(?=<{name}\b)", "")
            return F.concat(_replaced(text, " ", ""), F.right(html, behind))

        body = F.left(html, end - len(closing))
        return let(body, lambda b: let(F.struct(b.alias("body"), F.substring_index(b, ">", -1).alias("loose")), joined))

    def searched(low):
        found = let(F.length(F.substring_index(low, closing, -1)), cut)
        return F.when(F.contains(low, F.lit(closing)), found).otherwise(html)

    return let(_lowered(html), searched)


def visible_html(html: Column) -> Column:
    """Without comments, styles and scripts; ld+json scripts are kept."""
    plain = _replaced(html, " ", " ")
    out = let(plain, _without_comments)
    out = let(out, lambda t: _without_element(t, "script", r"ld\+json"))
    return let(out, lambda t: _without_element(t, "style"))


def _decoded(raw: Column) -> Column:
    """Percent-decoding that keeps the raw text when an escape is malformed."""
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    whole = let(decoded, lambda d: F.when(~F.contains(d, F.lit("\ufffd")), d))
    return F.when(F.contains(raw, F.lit("%")), F.coalesce(whole, raw)).otherwise(raw)


def _normalised(raw: Column) -> Column:
    text = F.lower(F.regexp_replace(_decoded(raw), r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(text, "^[^a-z0-9]+", ""), "[.,;:]+$", "")


def _around_at(text: Column) -> Column:
    """What stands next to an `@`: of the text between two of them the first and the last run.

    Address runs are all that the address pattern looks at, and those that no `@` touches
    cannot match, so it finds the same in this as in the whole text.
    """

    def run(piece):
        return F.regexp_extract(piece, rf"^[{_RUN}]*", 0)

    def ends(piece):
        first = run(piece)
        last = F.reverse(run(F.reverse(piece)))
        return F.when(F.length(first) == F.length(piece), piece).otherwise(F.concat(first, F.lit(" "), last))

    return F.array_join(F.transform(F.split(text, "@"), ends), "@")


def email_candidates(html: Column) -> Column:
    """Distinct addresses from mailto links and from bare text."""

    def found(text):
        none = F.array().cast("array<string>")
        mailto = F.regexp_extract_all(text, F.lit(V.MAILTO_PATTERN), F.lit(1))
        mailto = F.when(F.contains(F.lower(text), F.lit("mailto:")), mailto).otherwise(none)
        marked = F.when(F.contains(text, F.lit("..")), F.regexp_replace(text, r"\.(?=\.)", "." + _BREAK)).otherwise(text)
        bare = F.regexp_extract_all(_around_at(marked), F.lit(_EMAIL_AT_RUN_START), F.lit(1))
        bare = F.when(F.contains(text, F.lit("@")), bare).otherwise(none)
        return F.concat(mailto, F.transform(bare, lambda a: F.replace(a, F.lit(_BREAK), F.lit(""))))

    both = F.transform(let(visible_html(html), found), _normalised)
    return F.array_distinct(F.filter(both, lambda a: a != ""))


def email_local(address: Column) -> Column:
    return F.regexp_replace(address, "@[^@]*$", "")


def email_host(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def email_plausible(address: Column) -> Column:
    noise = "|".join(re.escape(h) for h in V.NOISE_HOSTS)

    def judged(local, host):
        return (
            F.contains(address, F.lit("@"))
            & (local != "")
            & ~address.rlike(V.FILE_SUFFIX_PATTERN)
            & ~F.contains(address, F.lit(".."))
            & (F.length(local) <= 64)
            & (F.length(address) <= 254)
            & F.contains(host, F.lit("."))
            & ~F.contains(local, F.lit("%"))
            & local.rlike("^[a-z0-9]")
            & ~local.rlike("^[0-9a-f]{16,}$")
            & ~host.rlike(rf"(^|\.)({noise})$")
            & ~local.isin(V.NOISE_LOCALS)
        )

    return let(email_local(address), lambda local: judged(local, email_host(address)))


def same_site(host: Column, site: Column) -> Column:
    """Equal, or one is a subdomain of the other."""
    return (
        (host == site)
        | F.endswith(host, F.concat(F.lit("."), site))
        | F.endswith(site, F.concat(F.lit("."), host))
    )


def email_belongs(address: Column, site_host: Column) -> Column:
    host = email_host(address)
    return host.isin(V.FREE_PROVIDERS) | site_host.isNull() | same_site(host, site_host)


def email_score(address: Column, site_host: Column) -> Column:
    local = email_local(address)
    preferred = F.array_position(F.array(*map(F.lit, V.PREFERRED_LOCALS)), local)
    return (
        F.when(F.coalesce(same_site(email_host(address), site_host), F.lit(False)), 40).otherwise(0)
        + F.when(preferred > 0, F.lit(31) - preferred).otherwise(0)
        + F.when(F.contains(local, F.lit(".")), 3).otherwise(0)
        - F.when(local.rlike("^[0-9]"), 10).otherwise(0)
    )


def rank_emails(candidates: Column, site_host: Column) -> Column:
    """Plausible addresses of this site, best first, then alphabetical.

    A blank host is an unknown one: every plausible address is kept.
    """
    site_host = F.nullif(site_host, F.lit(""))
    kept = F.filter(candidates, lambda a: email_plausible(a) & email_belongs(a, site_host))
    keyed = F.transform(
        kept, lambda a: F.struct((-email_score(a, site_host)).alias("k"), a.alias("a"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["a"])


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def extract_emails(html: Column, site_host: Column) -> Column:
    return rank_emails(email_candidates(html), bare_host(site_host))


# ---------------------------------------------------------------- URLs

_ABSOLUTE = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"


def _tidy(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", "")


def _escaped(text: Column, unsafe: str) -> Column:
    """Percent-encode the characters matching `unsafe`."""

    def one(c):
        code = F.when(c == " ", F.lit("%20")).otherwise(F.url_encode(c))
        return F.when(c.rlike(unsafe), code).otherwise(c)

    def spelled(t):
        return F.when(
            t.rlike(unsafe), F.array_join(F.transform(F.split(t, ""), one), "")
        ).otherwise(t)

    return let(text, spelled)


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments."""

    def step(acc, s):
        return first_match(
            [
                (s.rlike(r"(?i)^(\.|%2e)$"), acc),
                (s.rlike(r"(?i)^(\.|%2e){2}$"), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))),
            ],
            F.concat(acc, F.array(s)),
        )

    def resolved(p):
        kept = F.aggregate(F.split(F.regexp_replace(p, "^/", ""), "/"), F.array(F.lit("")), step)
        # A final dot segment names the folder itself.
        end = F.when(p.rlike(r"(?i)/(\.|%2e){1,2}$"), F.lit("/")).otherwise(F.lit(""))
        return F.when(
            p.rlike(r"(?i)/(\.|%2e)"), F.concat(F.array_join(kept, "/"), end)
        ).otherwise(p)

    return let(path, resolved)


def parse_url(url: Column) -> Column:
    """An absolute http(s) URL taken apart and made canonical.

    Struct of scheme, host, origin, path, query, fragment and href (without the
    fragment); href is NULL when this is no such URL.
    """

    def part(u, group):
        return F.regexp_extract(u, _ABSOLUTE, group)

    def raw(u):
        return F.struct(
            F.lower(part(u, 1)).alias("scheme"),
            F.lower(F.regexp_replace(part(u, 2), "^[^@]*@", "")).alias("host"),
            F.replace(part(u, 3), F.lit("\\"), F.lit("/")).alias("path"),
            part(u, 4).alias("query"),
            part(u, 5).alias("fragment"),
        )

    def canonical(r):
        default_port = F.when(r["scheme"] == "https", F.lit(":443$")).otherwise(F.lit(":80$"))
        path = F.when(r["path"] == "", F.lit("/")).otherwise(r["path"])
        return F.struct(
            r["scheme"].alias("scheme"),
            F.regexp_replace(r["host"], r":[0-9]*$", "").alias("host"),
            F.concat(
                r["scheme"], F.lit("://"), F.regexp_replace(r["host"], default_port, F.lit(""))
            ).alias("origin"),
            _escaped(_without_dots(path), "[^!-~]|[\"<>`{}]").alias("path"),
            _escaped(r["query"], "[^!-~]|[\"<>']").alias("query"),
            r["fragment"].alias("fragment"),
        )

    def with_href(c):
        href = F.concat(c["origin"], c["path"], c["query"])
        return F.struct(
            *[c[f].alias(f) for f in ("scheme", "host", "origin", "path", "query", "fragment")],
            F.when(c["host"] != "", href).alias("href"),
        )

    return let(let(let(_tidy(url), raw), canonical), with_href)


def resolve_url(href: Column, base: Column) -> Column:
    """`href` against a parsed `base`, without its fragment, as absolute text.

    NULL when it has a scheme other than http(s).
    """

    def absolute(ref):
        folder = F.regexp_replace(base["path"], "[^/]*$", "")
        return first_match(
            [
                (ref.rlike("(?i)^https?://"), ref),
                (ref.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None)),
                (ref.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), ref)),
                (ref.rlike(r"^[/\\]"), F.concat(base["origin"], ref)),
                (ref == "", base["href"]),
                (F.startswith(ref, F.lit("?")), F.concat(base["origin"], base["path"], ref)),
            ],
            F.concat(base["origin"], folder, ref),
        )

    return let(F.regexp_replace(_tidy(href), r"#[\s\S]*$", ""), absolute)


def contact_links(html: Column, base: Column, limit: int | None = 2) -> Column:
    """First distinct same-host links that hint at a contact page; all without a limit.

    `base` is the parsed URL of the page.
    """
    hrefs = F.regexp_extract_all(
        html, F.lit("(?i)href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1)
    )
    hinted = F.filter(
        hrefs,
        lambda h: h.rlike(V.CONTACT_HINT_PATTERN) & ~h.rlike("(?i)^(mailto:|tel:|javascript:|#)"),
    )

    def found(b):
        site = bare_host(b["host"])
        page = F.concat(b["href"], b["fragment"])
        urls = F.transform(hinted, lambda h: parse_url(resolve_url(h, b)))
        kept = F.filter(
            urls,
            lambda u: u["href"].isNotNull() & (bare_host(u["host"]) == site) & (u["href"] != page),
        )
        links = F.array_distinct(F.transform(kept, lambda u: u["href"]))
        return links if limit is None else F.slice(links, 1, limit)

    none = F.array().cast("array<string>")
    return F.when(base["href"].isNotNull(), let(base, found)).otherwise(none)


# ---------------------------------------------------------------- page facts


def wanted_body(html: Column, content_type: Column, kind: str = "html") -> Column:
    """The body when its content type is the one asked for, else empty."""
    ctype = F.trim(F.lower(F.coalesce(content_type, F.lit(""))))
    right = F.contains(ctype, F.lit("html")) if kind == "html" else F.startswith(ctype, F.lit("text/"))
    return F.when((ctype == "") | right, F.coalesce(html, F.lit(""))).otherwise(F.lit(""))


def reachable(http_status: Column) -> Column:
    """2xx/3xx yes, 5xx no, anything else says nothing about the site."""
    return first_match(
        [(http_status.between(200, 399), F.lit("yes")), (http_status >= 500, F.lit("no"))],
        F.lit("unknown"),
    )


def yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("yes")).otherwise(F.lit("no"))


def has_viewport(html: Column) -> Column:
    """Whether some closed meta tag names the viewport.

    The fixed pattern, VIEWPORT_PATTERN, read piece by piece between `>`: the first
    `<meta` of a piece must stand before its last name, with a character between.
    """
    named = r"(?i)^([\s\S]*)name\s*=\s*[\"']viewport[\"']"

    def inside(piece):
        start = F.instr(F.lower(piece), "<meta")
        before = F.length(F.regexp_extract(piece, named, 1))
        return piece.rlike(named) & (start > 0) & (before >= start + 5)

    def closed(pieces):
        return F.exists(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), inside)

    return F.when(html.rlike("(?i)viewport"), let(F.split(html, ">"), closed)).otherwise(html.isNull() & F.lit(None))


def has_form(html: Column) -> Column:
    return html.rlike(V.FORM_PATTERN)


def has_contact_form(html: Column) -> Column:
    return has_form(html) & html.rlike(V.FORM_HINT_PATTERN)
