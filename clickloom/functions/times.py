"""Timestamps and days. Nothing here depends on the session time zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROSECOND = "INTERVAL '0.000001' SECOND"


def ntz(moment: datetime) -> Column:
    """A timestamp literal without zone; a moment with a zone is taken in UTC."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end``, both without zone."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def add_micros(start: Column, micros: Column) -> Column:
    return start + micros * F.expr(_MICROSECOND)


def strip_zone(zoned: Column) -> Column:
    """UTC wall clock of a zoned timestamp: 19:47 UTC becomes 19:47."""
    return add_micros(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.unix_micros(zoned))


def parse_zoned(text: Column) -> Column:
    """Timestamp with zone from text, offset and all."""
    return text.cast("timestamp")


# Fixed value: a time of day that an offset, a Z or a zone name follows.
_ZONE_AFTER_TIME = r":\d{1,2}(\.\d*)?\s*[A-Za-z+-]"


def text_to_ntz(text: Column) -> Column:
    """Zone-free timestamp from text: its own wall clock, or that of UTC if it names a zone."""
    zoned = strip_zone(parse_zoned(F.when(text.rlike(_ZONE_AFTER_TIME), text)))
    return F.when(text.rlike(_ZONE_AFTER_TIME), zoned).otherwise(text.cast("timestamp_ntz"))


def text_to_ntz_or_null(text: Column) -> Column:
    """The same, NULL for text that is no time."""
    zoned = strip_zone(text.try_cast("timestamp"))
    return F.when(text.rlike(_ZONE_AFTER_TIME), zoned).otherwise(text.try_cast("timestamp_ntz"))


def timestamp_text(moment: Column) -> Column:
    """Text with six fractional digits, the form event files use."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_from_number(days: Column) -> Column:
    """Date from days since 1970-01-01."""
    return F.date_from_unix_date(days)


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def day_of(moment: Column) -> Column:
    return F.to_date(moment)
