"""Lenient timestamp parsing and ages, with the present given explicitly as ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient(text: Column, as_of: Column) -> Column:
    """ISO forms and Unix seconds as a timestamp in UTC; ``as_of`` for null, blank and anything else."""
    t = F.regexp_replace(F.trim(text), "Z", "+00:00")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?([+-]\d{2}:?\d{2})?)?$"), F.regexp_replace(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"^(.{11}\d{2}:\d{2})([+-]|$)", "$1:00$2").try_cast("timestamp"))
    compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
    seconds = F.when(t.rlike(r"^[+-]?\d+(\.\d*)?$") & ~t.rlike(r"^\d{8}$"), t.try_cast("double"))
    return F.coalesce(iso, compact, F.timestamp_seconds(F.when(F.abs(seconds) < 2.5e11, seconds)), as_of)


def age_days(time: Column, as_of: Column) -> Column:
    """Fractional days between, at least 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(time)) / 8.64e10)


def date_text(seconds: Column) -> Column:
    """The UTC date of Unix seconds."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def kept_after(time: Column, cutoff: Column) -> Column:
    """False only for times known to be before the cutoff."""
    return ~F.coalesce(time < cutoff, F.lit(False))


def element_date(text: Column) -> Column:
    """A date in figures inside a text: d/m/y or y/m/d; with both parts up to 12 the month is first. Vietnamese
    month words give the first of the month."""
    figures = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    a, b, y = (F.regexp_extract(text, figures, k).try_cast("int") for k in (1, 2, 3))
    by_figures = F.when(a > 12, F.try_make_timestamp(y, b, a, F.lit(0), F.lit(0), F.lit(0))).otherwise(F.try_make_timestamp(y, a, b, F.lit(0), F.lit(0), F.lit(0)))
    iso = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    y2, m2, d2 = (F.regexp_extract(text, iso, k).try_cast("int") for k in (1, 2, 3))
    words = r"tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
    m3, y3 = (F.regexp_extract(text, words, k).try_cast("int") for k in (1, 2))
    zero = [F.lit(0)] * 3
    return F.coalesce(F.try_make_timestamp(y2, m2, d2, *zero), by_figures, F.try_make_timestamp(y3, m3, F.lit(1), *zero)).cast("date")
