"""Date text and epoch numbers, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_whitespace

# Years 1 to 9999; beyond that an epoch has no ISO text.
_MIN_MICROS = -62135596800 * 1_000_000
_MAX_MICROS = 253402300800 * 1_000_000 - 1


def epoch_to_iso(c: Column) -> Column:
    """Seconds or (above 1e11) milliseconds -> ISO-8601 text in UTC."""
    value = c.cast("double")
    micros = F.rint(F.when(value > 1e11, value / 1000.0).otherwise(value) * 1e6).cast("long")
    text = F.timestamp_add(
        "MICROSECOND", micros, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    ).cast("string")
    fraction = F.regexp_extract(text, r"\.(\d+)$", 1)
    iso = F.concat(
        F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T")),
        F.when(fraction != "", F.concat(F.lit("."), F.rpad(fraction, 6, "0"))).otherwise(""),
        F.lit("+00:00"),
    )
    in_range = (value * F.when(value > 1e11, 1e3).otherwise(1e6)).between(_MIN_MICROS, _MAX_MICROS)
    return F.when(in_range, iso)


def normalize_date(c: Column) -> Column:
    """``2026年4月6日``, ``2026/4/6 12:30``, ... -> ``YYYY-MM-DD[ time]``; no date -> null."""
    text = F.translate(clean_whitespace(c), "/.年月T日", "---- ")
    pattern = r"(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2}:\d{2}(?::\d{2})?))?"
    year, month, day, clock = (F.regexp_extract(text, pattern, i) for i in range(1, 5))
    date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(
        text.rlike(pattern), F.concat_ws(" ", date, F.nullif(clock, F.lit("")))
    )


def looks_like_date(c: Column) -> Column:
    return F.coalesce(
        F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?$"), F.lit(False)
    )


def looks_like_datetime(c: Column) -> Column:
    shaped = c.rlike(
        r"^\d{4}-\d{2}-\d{2}(?:.\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?"
        r"(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"
    )
    return F.coalesce(shaped & F.try_to_date(F.substring(c, 1, 10)).isNotNull(), F.lit(False))
