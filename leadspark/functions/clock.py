"""Calendar keys and reset instants, the same under every session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V

_DAY = 86_400_000_000


def _date(ts: Column) -> Column:
    """The UTC calendar date of an instant, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / _DAY).cast("int"))


def _midnight(date: Column) -> Column:
    """The instant of UTC midnight that begins a date."""
    return F.timestamp_micros(F.unix_date(date).cast("long") * _DAY)


def _reset_date(ts: Column) -> Column:
    """Calendar date where the quota resets."""
    return _date(F.from_utc_timestamp(ts, V.QUOTA_ZONE))


def month_key(ts: Column) -> Column:
    return F.date_format(_date(ts), "yyyy-MM")


def day_key(ts: Column) -> Column:
    """Calendar day where the quota resets, not in UTC."""
    return F.date_format(_reset_date(ts), "yyyy-MM-dd")


def next_month_reset(ts: Column) -> Column:
    return _midnight(F.add_months(F.trunc(_date(ts), "month"), 1))


def next_day_reset(ts: Column) -> Column:
    """Next local midnight as an instant; exact over daylight-saving changes."""
    return F.to_utc_timestamp(_midnight(F.date_add(_reset_date(ts), 1)), V.QUOTA_ZONE)


def check_date(iso: Column) -> Column:
    """ISO text to `26 Aug` in UTC; NULL rather than an invented date."""
    zoned = iso.rlike(r"(?i)T.*(Z|[+-][0-9]{2}:?[0-9]{2})$")
    plain = F.trim(iso)
    of_day = F.when(plain.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(plain, F.lit("T00:00:00Z")))
    instant = F.try_to_timestamp(F.when(zoned, iso).otherwise(F.coalesce(of_day, F.concat(plain, F.lit(" UTC")))))
    return F.date_format(_date(instant), "d MMM")


def age_below(ts: Column, now: Column, days: int) -> Column:
    """Strictly younger than `days`; an unreadable time is stale."""
    limit = days * 86_400_000_000
    return F.coalesce(F.unix_micros(now) - F.unix_micros(ts) < limit, F.lit(False))
