"""Publish times, run dates and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import trim_space
from broadsheet.session import let

# Zone names that dates are written with, and their offsets.
ZONES = {
    "Z": "+00:00", "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_DAY = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
_TIME = r"(?:[T,\s]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?"
_ZONE = r"\s*((?:GMT|UTC|UT)?[+-]\d{2}:?\d{2}|[A-Za-z]{1,3})?(?:\s*\([^)]*\))?$"
_NAME = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
#: Spellings and where their year, month and day stand; time and zone follow.
SPELLINGS = [
    (rf"(?i)^{_DAY}(\d{{1,2}})[\s-]+{_NAME},?[\s-]+(\d{{4}}|\d{{2}}){_TIME}{_ZONE}", (3, 2, 1)),
    (rf"(?i)^{_DAY}{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}}){_TIME}{_ZONE}", (3, 1, 2)),
    (rf"(?i)^(\d{{4}})[/-](\d{{1,2}})[/-](\d{{1,2}}){_TIME}{_ZONE}", (1, 2, 3)),
]

DEFAULT_STALE_AFTER_DAYS = 30


def _spelled(text: Column, pattern: str, at: tuple[int, int, int]) -> Column:
    """The time that a text in one spelling names; null for any other text."""
    year, month, day = (F.regexp_extract(text, pattern, k) for k in at)
    hour, minute, second, zone = (F.regexp_extract(text, pattern, k) for k in (4, 5, 6, 7))
    # Two digits are a year from 1950 to 2049.
    year = F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(year < "50", "20").otherwise("19"), year))
    named = ((F.instr(F.lit(_MONTHS), F.lower(F.substring(month, 1, 3))) + 2) / 3).cast("int").cast("string")
    month = F.when(month.rlike("^[0-9]"), month).otherwise(named)
    names = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
    offset = F.regexp_replace(zone, "(?i)^(?:GMT|UTC|UT)(?=[+-])", "")
    offset = (
        F.when(zone == "", "+00:00")
        .when(offset.rlike("^[+-]"), F.concat(F.substring(offset, 1, 3), F.lit(":"), F.right(offset, F.lit(2))))
        .otherwise(F.try_element_at(names, F.upper(zone)))
    )
    two = lambda value: F.lpad(value, 2, "0")
    whole = F.concat(
        year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit("T"), two(hour), F.lit(":"), two(minute), F.lit(":"), two(second), offset
    )
    return F.when(text.rlike(pattern), whole.try_cast("timestamp"))


def published_at(text: Column, run_time: Column) -> Column:
    """A feed's date text as a timestamp; the run time when it is missing or unreadable."""

    def read(t: Column) -> Column:
        iso = F.when(t.rlike(r"^\d{4}-\d{2}"), t.try_cast("timestamp"))
        return F.coalesce(*(_spelled(t, pattern, at) for pattern, at in SPELLINGS), iso)

    return F.coalesce(let(trim_space(text), read), run_time)


def published_at_epoch(number: Column, run_time: Column) -> Column:
    """Seconds, or milliseconds when above 10^12, since the epoch."""
    seconds = F.when(number > 1e12, number / 1000).otherwise(number).cast("double")
    # What no calendar holds (NaN, infinities, far numbers) falls back like a missing date.
    readable = F.abs(seconds) < 250_000_000_000
    micros = F.when(readable & ~F.isnan(seconds), F.round(seconds * 1e6)).try_cast("bigint")
    return F.coalesce(F.timestamp_micros(micros), run_time)


def local_date(at: Column, zone: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def local_time(at: Column, zone: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "HH:mm")


def age_seconds(now: Column, at: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(1e6)
