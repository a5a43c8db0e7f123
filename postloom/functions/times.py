"""Absolute and relative time texts. The moment of collection is always given; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TIME_UNITS, collapse, let, strip

_RELATIVE = rf"(?i)^\s*(?:([0-9]+)\s*)?({TIME_UNITS}|y|yr|yrs|year|years)\s*$"
#: Accepted ISO shapes: a date with a time of minutes, seconds or fractions, and an offset or Z or neither.
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
# Seconds of a unit by its first letter; a year has 365 days.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "y": 31_536_000}


def parse_iso(text: Column) -> Column:
    """An instant of an ISO text; without an offset it is UTC, as is the session's time zone."""
    t = strip(text)
    zoned = F.when(t.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(_ISO), F.date_trunc("second", zoned.try_cast("timestamp")))


def format_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_relative(text: Column) -> Column:
    t = F.lower(strip(text))
    return F.coalesce(t.isin("just now", "now") | t.rlike(_RELATIVE), F.lit(False))


def relative_to_instant(text: Column, as_of: Column) -> Column:
    t = F.lower(strip(text))
    count = F.coalesce(F.nullif(F.regexp_extract(t, _RELATIVE, 1), F.lit("")).try_cast("bigint"), F.lit(1).cast("bigint"))
    unit = F.substring(F.regexp_extract(t, _RELATIVE, 2), 1, 1)
    seconds = F.lit(None).cast("bigint")
    for letter, value in UNIT_SECONDS.items():
        seconds = F.when(unit == letter, F.lit(value).cast("bigint")).otherwise(seconds)
    moved = F.timestamp_seconds(F.unix_timestamp(as_of) - count * seconds)
    return F.when(t.isin("just now", "now"), F.date_trunc("second", as_of)).when(t.rlike(_RELATIVE), moved)


def normalize_time(text: Column, as_of: Column) -> Column:
    """A date as it is, an instant in UTC with Z, a relative time against as_of (days and longer as a date), else ''."""
    return let(strip(text), lambda t: let(F.struct(parse_iso(t).alias("iso"), relative_to_instant(t, as_of).alias("relative")), lambda m: _normalized(t, m["iso"], m["relative"])))


def _normalized(t: Column, iso: Column, relative: Column) -> Column:
    day = t.rlike(r"(?i)^\s*(?:[0-9]+\s*)?(d|day|days|w|week|weeks|y|yr|yrs|year|years)\s*$")
    return F.coalesce(
        F.when(t == "", "").when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t)
        .when(iso.isNotNull(), format_instant(iso))
        .when(relative.isNull(), "").when(day, F.date_format(relative, "yyyy-MM-dd")).otherwise(format_instant(relative)),
        F.lit(""))


def publish_time_text(text: Column) -> Column:
    """The first date with a time, else date, else ISO date in a text, else the text."""
    t = collapse(text)
    shapes = (r"\b([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4} at [0-9]{1,2}:[0-9]{2} [AP]M)\b", r"\b([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})\b",
              r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b")
    return F.coalesce(*(F.nullif(F.regexp_extract(t, s, 1), F.lit("")) for s in shapes), t)


#: How every text begins that the formats of _absolute can read; the rest isn't tried with them.
_DATED = r"(?iu)^(?:[-+]?[0-9]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def _absolute(t: Column) -> Column:
    day = lambda f: F.date_format(F.try_to_timestamp(t, F.lit(f)), "yyyy-MM-dd")
    minute = lambda f: F.date_format(F.try_to_timestamp(t, F.lit(f)), "yyyy-MM-dd'T'HH:mm")
    read = F.coalesce(*(minute(f"{m} d, yyyy 'at' h:mm a") for m in ("MMMM", "MMM")), *(day(f"{m} d, yyyy") for m in ("MMMM", "MMM")), day("yyyy-MM-dd"))
    return F.when(t.rlike(_DATED), read)


def absolute_date_text(text: Column) -> Column:
    """ISO text of 'June 3, 2025', 'Jun 3, 2025 at 4:05 PM' or '2025-06-03'; minutes keep no time zone."""
    return let(publish_time_text(text), _absolute)


def is_relative_publish(text: Column) -> Column:
    """Relative publish texts: with a count and no years, or yesterday."""
    t = F.lower(strip(text))
    return F.coalesce(t.isin("yesterday", "昨天") | t.rlike(rf"^[0-9]+\s*({TIME_UNITS})$"), F.lit(False))


def parse_publish_time(*texts: Column) -> Column:
    """struct<iso, kept>: of the texts in order the first absolute or relative one."""
    def of(text: Column) -> Column:
        return let(publish_time_text(text), lambda kept: let(_absolute(kept), lambda iso: F.when(
            iso.isNotNull() | is_relative_publish(kept), F.struct(iso.alias("iso"), kept.alias("kept")))))

    return F.coalesce(*map(of, texts))


def store_datetime(text: Column) -> Column:
    """A text for a DATETIME column: a date as midnight, an instant in UTC; null where it can't be read."""
    t = strip(text)
    return F.when(F.length(t) == 10, t.try_cast("date").cast("timestamp")).otherwise(parse_iso(t))
