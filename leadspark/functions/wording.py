"""Niche and market wording, slugs, keys and short text helpers."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed as V
from .derive import first_match, let


def spaced(text: Column) -> Column:
    return F.regexp_replace(text, "[-_]+", " ")


def audience(niche: Column) -> Column:
    words = spaced(F.coalesce(niche, F.lit("")))
    return first_match(
        [(words.rlike(f"(?i){p}"), F.lit(a)) for a, p in V.AUDIENCE_PATTERNS],
        F.lit(V.DEFAULT_AUDIENCE),
    )


def lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def stakes(audience_col: Column) -> Column:
    return lookup(V.STAKES, audience_col)


def looker(niche: Column) -> Column:
    return lookup(V.LOOKERS, audience(niche))


def countable_niche(niche: Column, fallback: str = "business") -> Column:
    clean = F.lower(F.trim(spaced(F.coalesce(niche, F.lit("")))))
    return first_match(
        [
            (clean == "", F.lit(fallback)),
            (clean.rlike(rf"\b({V.MASS_NOUNS})$"), F.concat(clean, F.lit(" company"))),
        ],
        clean,
    )


def plural_niche(niche: Column, fallback: str = "businesses") -> Column:
    one = countable_niche(niche, "")
    return first_match(
        [
            (one == "", F.lit(fallback)),
            (one.rlike("(s|x|z|ch|sh)$"), F.concat(one, F.lit("es"))),
            (one.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(one, "y$", ""), F.lit("ies"))),
        ],
        F.concat(one, F.lit("s")),
    )


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def title_case(text: Column) -> Column:
    """Dashes to spaces, every ASCII word start in upper case."""
    pieces = F.split(F.regexp_replace(text, "-", " "), "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    started = F.transform(pieces, lambda w: F.when(w.rlike("^[a-z]"), capital(w)).otherwise(w))
    return F.array_join(started, "")


def market_label(location: Column, fallback: str = "your market") -> Column:
    """Location slug the way a person writes it, state codes in upper case."""
    clean = F.lower(F.trim(spaced(F.coalesce(location, F.lit("")))))
    every = F.split(clean, r"\s+")
    # A trailing country is dropped only while another word remains.
    named = F.transform(F.reverse(every), lambda w: ~w.isin("usa", "us"))
    after = F.array_position(named, True) - 1
    kept = F.when(after >= 0, F.size(every) - after.cast("int")).otherwise(1)
    words = F.slice(every, 1, kept)
    last = F.element_at(words, -1)
    stated = (F.size(words) > 1) & last.isin(V.STATE_CODES)
    body = F.when(stated, F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(words)
    label = F.array_join(F.transform(body, capital), " ")
    return F.when(clean == "", F.lit(fallback)).otherwise(
        F.when(stated, F.concat(label, F.lit(", "), F.upper(last))).otherwise(label)
    )


def _plain(text: str) -> str:
    """NFKD without combining marks U+0300..U+036F."""
    marks = range(0x300, 0x370)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if ord(c) not in marks)


# Latin letters that lose an accent, as one-to-one replacements.
_LATIN = [chr(n) for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
_ACCENTED = {c: _plain(c) for c in _LATIN if len(_plain(c)) == 1 and _plain(c) != c}
_MARKS = "".join(map(chr, range(0x300, 0x370)))


@F.pandas_udf(StringType())
def _strip_rare(text: pd.Series) -> pd.Series:
    return text.map(_plain, na_action="ignore")


def strip_accents(text: Column) -> Column:
    """Accents off. ASCII text is left alone, Latin letters are replaced by built-in
    code; only what holds any other non-ASCII character after that is sent to Python."""
    latin = F.translate(text, "".join(_ACCENTED) + _MARKS, "".join(_ACCENTED.values()))
    plain = F.when(text.rlike("[^\\x00-\\x7F]"), latin).otherwise(text)
    rest = let(plain, lambda p: F.when(p.rlike("[^\\x00-\\x7F]"), p))
    return F.coalesce(_strip_rare(rest), plain)


def slug(text: Column, max_length: int = 40) -> Column:
    base = F.lower(strip_accents(text))
    dashed = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    clipped = F.regexp_replace(F.substring(dashed, 1, max_length), "-+$", "")
    return F.when(clipped == "", F.lit("untitled")).otherwise(clipped)


def run_name(finished_at: Column, location: Column, niche: Column) -> Column:
    stamp = F.date_format(finished_at, "yyyyMMdd-HHmmss")
    return F.concat_ws("_", stamp, slug(location), slug(niche))


def coordinate(value: Column) -> Column:
    return F.format_string("%.6f", value)


def tile_key(term: Column, sw_lat: Column, sw_lng: Column, ne_lat: Column, ne_lng: Column) -> Column:
    corners = F.concat_ws(",", *[coordinate(c) for c in (sw_lat, sw_lng, ne_lat, ne_lng)])
    return F.concat_ws("|", F.lower(F.trim(term)), corners)


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with one decimal, halves up on whole ms."""
    tenths = F.floor((ms + 50) / 100).cast("long")
    return F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string"))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def terms_for(niche: Column) -> Column:
    """Search phrases: the curated list when one is saved, else four built ones."""
    base = F.regexp_replace(F.lower(F.trim(niche)), r"\s+", " ")
    singular = F.regexp_replace(base, "s$", "")
    built = F.array_distinct(
        F.array(
            base,
            F.concat(singular, F.lit(" company")),
            F.concat(singular, F.lit(" services")),
            F.concat(F.lit("local "), base),
        )
    )
    return first_match(
        [(niche == n, F.array(*map(F.lit, terms))) for n, terms in V.CURATED_NICHES.items()], built
    )
