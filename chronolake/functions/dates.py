"""Time and policy functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the retention policies, in days.
RETENTION_DAYS = {"1month": 30, "6months": 180, "1year": 365, "2years": 730}


def seconds(x: Column) -> Column:
    """Epoch seconds of a number that may be milliseconds (above 1e10)."""
    return F.when(x > 1e10, x / 1000.0).otherwise(x)


def known(x: Column) -> Column:
    """Null for times that are not above 0."""
    return F.when(x > 0, x)


def retention_cutoff(policy: Column, now: Column) -> Column:
    """The epoch second before which a policy expires rows; an unknown policy: null."""
    p, out = F.lower(F.trim(policy)), F.lit(None).cast("long")
    for name, days in RETENTION_DAYS.items():
        out = F.when(p == name, now - days * 86_400).otherwise(out)
    return out


def limit_bytes(text: Column) -> Column:
    """Bytes of a limit in GB; blank, unlimited, 0 or unreadable: null."""
    n = F.trim(text).try_cast("double")
    return F.when(n > 0, (n * float(1 << 30)).cast("long"))


def retry_time(text: Column) -> Column:
    """UTC text, to the second, of an RFC 3339 time or of a UTC time without a zone; another form: an error; null stays.

    Wants a session in UTC.
    """
    zoned = F.to_utc_timestamp(F.to_timestamp(F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), text)), "UTC")
    plain = F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), text.try_cast("timestamp"))
    out = F.date_format(F.coalesce(zoned, plain), "yyyy-MM-dd HH:mm:ss")
    return F.when(text.isNotNull(), F.coalesce(out, F.raise_error(F.lit("neither RFC 3339 nor YYYY-MM-DD HH:MM:SS"))))
