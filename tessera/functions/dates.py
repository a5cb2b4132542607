"""Date functions; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(x: Column) -> Column:
    return F.try_to_timestamp(F.substring(x, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def whole_days(a: Column, b: Column) -> Column:
    """Full 24 hours from a to b, rounded down."""
    return F.floor((micros(b) - micros(a)) / 86_400_000_000)


def is_active(last: Column, as_of: Column, days: int = 60) -> Column:
    return F.datediff(as_of, F.to_date(last)) <= days


def imap_date(x: Column) -> Column:
    return F.date_format(x, "dd-MMM-yyyy")
