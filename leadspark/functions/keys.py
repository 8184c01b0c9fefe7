"""Contact keys, phone and e-mail rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V
from .derive import first_match, let


def phone_key(phone: Column) -> Column:
    """Digits only; NULL when there are none."""
    return F.nullif(F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9]", ""), F.lit(""))


def host_key(website: Column) -> Column:
    """Lower-case host without scheme, path and leading www."""
    no_scheme = F.regexp_replace(website, r"(?i)^https?://", "")
    return F.regexp_replace(F.lower(F.regexp_replace(no_scheme, r"/[\s\S]*$", "")), r"^www\.", "")


def lead_host(website: Column) -> Column:
    """Host as listed: case kept, www. kept, only a lower-case scheme removed."""
    site = F.coalesce(website, F.lit(""))
    return F.regexp_replace(F.regexp_replace(site, r"^https?://", ""), r"/[\s\S]*$", "")


def owns_domain(name: Column, host: Column) -> Column:
    """The domain label and the business name recognise each other."""
    label = F.element_at(F.split(host, r"\."), 1)
    flat = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    word = F.regexp_extract(F.lower(name), "([a-z0-9]{4,})", 1)
    return (F.length(label) >= 3) & (
        F.contains(flat, label) | ((word != "") & F.contains(label, word))
    )


def is_ph(address: Column) -> Column:
    return F.coalesce(address, F.lit("")).rlike(V.PH_PATTERN)


def phone_problem(phone: Column, ph: Column) -> Column:
    """Why a number cannot be dialled as written, or NULL."""

    def judged(digits):
        national = F.when(digits.startswith("63"), F.substr(digits, F.lit(3))).otherwise(
            F.regexp_replace(digits, "^0", "")
        )
        ph_ok = national.rlike(r"^(9[0-9]{9}|2[0-9]{8}|[3-8][0-9]{6,8})$")
        nanp = F.when(digits.rlike("^1[0-9]{10}$"), F.substring(digits, 2, 10)).otherwise(digits)
        return first_match(
            [
                (digits == "", F.lit("no digits")),
                (ph & ph_ok, F.lit(None)),
                (ph, F.format_string("unexpected PH format (%s digits)", F.length(digits))),
                (F.length(nanp) != 10, F.format_string("not 10 digits (%s)", F.length(nanp))),
                (nanp.rlike("^[01]"), F.lit("area code starts 0 or 1")),
                (nanp.rlike("^[0-9]{3}[01]"), F.lit("exchange starts 0 or 1")),
            ],
            F.lit(None),
        )

    return let(F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]", ""), judged)


def present(value: Column) -> Column:
    """Blank and 'unknown' both count as absent."""
    v = F.coalesce(value, F.lit(""))
    return (F.trim(v) != "") & (v != "unknown")


def email_shaped(address: Column) -> Column:
    """The fixed shape, EMAIL_SHAPE_PATTERN, without its repeated group: labels may be many."""
    host = F.substring_index(address, "@", -1)
    labels = F.contains(host, F.lit(".")) & ~F.contains(host, F.lit("..")) & ~F.endswith(host, F.lit("."))
    return address.rlike(r"^[^\s@]+@[^\s@.][^\s@]*$") & labels


def mx_verdict(http_ok: Column, status: Column, answers: Column) -> Column:
    """Only an answer from DNS can say no; failing to ask is unknown."""
    return first_match(
        [
            (~F.coalesce(http_ok, F.lit(False)), F.lit("unknown")),
            (status == 3, F.lit("no")),
            (F.coalesce(status, F.lit(-1)) != 0, F.lit("unknown")),
            (F.coalesce(answers, F.lit(0)) > 0, F.lit("yes")),
        ],
        F.lit("no"),
    )


def quota_kind(body: Column) -> Column:
    quota = F.contains(body, F.lit("RESOURCE_EXHAUSTED")) | body.rlike("(?i)quota")
    return F.when(quota & body.rlike(r"(?i)per\s*day"), F.lit("daily")).when(
        quota & body.rlike(r"(?i)per\s*minute"), F.lit("rate")
    )


def quota_limit_name(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, r"limit\s+'([^']+)'", 1), F.lit(""))


def quota_fatal(status: Column, body: Column) -> Column:
    return (status == 429) & F.coalesce(quota_kind(body) == "daily", F.lit(False))
