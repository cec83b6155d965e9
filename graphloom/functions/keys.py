"""Keys: texts compared without regard to letter case and surrounding whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_key(column: Column | str) -> Column:
    """Lower-case, trimmed text; null and blank become null, as neither is a key."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.lower(F.regexp_replace(column.cast("string"), r"^\s+|\s+$", ""))
    return F.when(text != "", text)


def utc_day(column: Column | str) -> Column:
    """The date in UTC of a timestamp, whatever the time zone of the session."""
    column = F.col(column) if isinstance(column, str) else column
    return F.date_from_unix_date(F.floor(F.unix_micros(column) / 86_400_000_000).cast("int"))


def utc_month(column: Column | str) -> Column:
    """The month in UTC of a timestamp as ``YYYY-MM``."""
    return F.substring(utc_day(column).cast("string"), 1, 7)


def as_whole(column: Column | str) -> Column:
    """A number written in any usual way (`` 2``, ``02``, ``2.0``) as a decimal; blank, null and non-numbers become null."""
    column = F.col(column) if isinstance(column, str) else column
    text = F.regexp_replace(column.cast("string"), r"^\s+|\s+$", "")
    return text.try_cast("decimal(30,6)")
