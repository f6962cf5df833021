"""Time column functions: lenient timestamp parsing and calendar periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted textual layouts besides the ISO forms, tried in order.
TIMESTAMP_FORMATS = (
    "yyyy/M/d H:m[:s]",
    "yyyy/M/d",
    "M/d/yyyy H:m[:s]",
    "M/d/yyyy",
)
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}"

PERIOD_UNITS = ("day", "week", "month", "quarter", "year")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c, source_type: str | None = None) -> Column:
    """Timestamp of a column; failures -> null.

    Strings that begin with an ISO date go to Spark's own parser: one-digit months and days,
    fractions of a second and zones (``Z``, ``+02:00``) are fine, and a time with a zone is
    converted to the session's time zone.  Others are tried against ``TIMESTAMP_FORMATS``.

    Columns that already hold timestamps or dates are passed through (as timestamps)."""
    col = _col(c)
    if source_type is not None and not source_type.startswith("string"):
        if source_type.startswith("date"):
            return col.cast("timestamp_ntz")
        return col
    return _parsed(F.trim(col.cast("string")))


def _parsed(s: Column) -> Column:
    iso = F.when(s.rlike(ISO_DATE), s.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(s, F.lit(f)) for f in TIMESTAMP_FORMATS]).cast("timestamp_ntz")


def canonical_unit(unit: str) -> str:
    """Unknown units fall back to month."""
    u = (unit or "month").lower()
    return u if u in PERIOD_UNITS else "month"


def period_start(ts, unit: str = "month") -> Column:
    """First day of the calendar period holding ``ts`` (weeks start on Monday) as DATE."""
    u = canonical_unit(unit)
    col = _col(ts)
    if u == "day":
        return F.to_date(col)
    return F.trunc(col, u)


def period_label(start, unit: str = "month") -> Column:
    """Label of a period given its start date: 2024-01-15, 2024-01-01/2024-01-07,
    2024-01, 2024Q1, 2024."""
    u = canonical_unit(unit)
    d = _col(start)
    if u == "day":
        return F.date_format(d, "yyyy-MM-dd")
    if u == "week":
        return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(d, 6), "yyyy-MM-dd"))
    if u == "month":
        return F.date_format(d, "yyyy-MM")
    if u == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    return F.year(d).cast("string")


def date_bound(value: str | None, end_of_day: bool = False) -> Column | None:
    """A literal bound for a date-range filter.

    A date-only end bound means midnight (the rest of that day is excluded) unless
    ``end_of_day`` is set, in which case the whole day is included."""
    if value is None:
        return None
    ts = _parsed(F.lit(value.strip()))
    if end_of_day and len(value.strip()) <= 10:
        return ts + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    return ts
