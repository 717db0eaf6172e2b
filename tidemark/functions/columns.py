"""Column expressions that several operators share. All are built of functions that run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(c: Column, kind: str = "string") -> Column:
    """A point in time of a timestamp, a date, an ISO-8601 string (malformed and empty ones give null) or epoch seconds."""
    if kind == "string":
        return F.try_to_timestamp(c)
    return F.timestamp_seconds(c) if kind in ("bigint", "int") else c


def year_of(c: Column, kind: str = "string") -> Column:
    return F.year(moment(c, kind))


def positive_only(c: Column) -> Column:
    """The value if it is above 0, else null, so that a sum over none is null."""
    return F.when(c > 0, c)


def flag(c: Column) -> Column:
    """1 for true, 0 for false and null."""
    return F.when(c, 1).otherwise(0)


def activity_bucket(n: Column) -> Column:
    """A generalised count of actions: 1, up to 5 (0 as well), up to 20, up to 100, more (null as well)."""
    return F.when(n == 1, "1_single").when(n <= 5, "2_low").when(n <= 20, "3_medium").when(n <= 100, "4_high").otherwise("5_power")


def signed_error(estimate: Column, exact: Column) -> Column:
    """Error in percent of the exact value; null where that is 0."""
    return F.try_divide((estimate - exact) * F.lit(100.0), exact)


def absolute_error(estimate: Column, exact: Column) -> Column:
    return F.abs(signed_error(estimate, exact))


def window_label(window: Column) -> Column:
    """'2024-01-01 00:00 → 01:00' for a window of time."""
    return F.concat(F.date_format(window["start"], "yyyy-MM-dd HH:mm"), F.lit(" → "), F.date_format(window["end"], "HH:mm"))


def bands_label(bands: Column, rows: Column) -> Column:
    return F.format_string("b=%d,r=%d", bands, rows)


def trailing_zeros(h: Column, none: int = 32) -> Column:
    """Zero bits below the lowest one bit of a number that isn't negative; `none` for 0."""
    return F.when(h == 0, none).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")
