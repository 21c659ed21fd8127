"""Column functions over instants and dates; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitchspark.functions.numbers import col


def utc(x: Column | str, naive_is_utc: bool = True) -> Column:
    """ISO-8601 text to an instant. Without an offset it is UTC, or null if ``naive_is_utc`` is false."""
    text = F.trim(col(x))
    parsed = F.try_to_timestamp(text)
    return parsed if naive_is_utc else F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), parsed)


def from_millis(x: Column | str) -> Column:
    return F.timestamp_millis(col(x).cast("long"))


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    """Seconds with their fraction."""
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def season_label(day: Column | str, first_month: int = 7) -> Column:
    """2025/26 for days from ``first_month`` on to before it in the next year."""
    d = col(day)
    year = F.when(F.month(d) >= first_month, F.year(d)).otherwise(F.year(d) - 1)
    return F.concat(year.cast("string"), F.lit("/"), F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0"))


def age_bucket(hours: Column | str) -> Column:
    h = col(hours)
    return F.when(h.isNull(), "UNKNOWN").when(h < 24, "LT_24H").when(h < 168, "LT_7D").otherwise("GE_7D")


def display(x: Column | str, zone: str = "Europe/Berlin") -> Column:
    return F.date_format(F.from_utc_timestamp(col(x), zone), "dd.MM.yyyy HH:mm:ss")


def is_fresh(observed: Column | str, now: Column, max_age: float) -> Column:
    """Age (not below zero) within ``max_age`` seconds (at least one), the limit included."""
    return F.greatest(F.lit(0.0), seconds_between(now, observed)) <= max(1.0, max_age)


def utc_date(x: Column | str) -> Column:
    """UTC calendar day of an ISO text; null if it can't be read."""
    return F.to_date(utc(x))


def partition_keys(at: Column | str) -> list[Column]:
    """year, month and date of an instant, as texts."""
    at = col(at)
    return [F.date_format(at, "yyyy").alias("year"), F.date_format(at, "MM").alias("month"), F.date_format(at, "yyyy-MM-dd").alias("date")]
