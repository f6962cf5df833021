"""Row filters and projections.  Every predicate is a plain Column, so Catalyst pushes the
simple ones (equality, IN, ranges) into the Parquet scan."""

from __future__ import annotations

import functools
import operator
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.text import is_non_blank
from feedlake.functions.timeparts import date_bound
from feedlake.sources.roles import find_column, project, quoted  # noqa: F401  (project re-exported)

__all__ = [
    "by_level",
    "level_bounds",
    "level_bounds_predicate",
    "match",
    "match_predicate",
    "project",
    "between_dates",
    "two_clock_range",
    "min_similarity",
    "non_blank",
    "fresh",
    "keep_newest",
    "first_rows",
]


def by_level(df: DataFrame, n: int, level: str = "level") -> DataFrame:
    return df.filter(F.col(level) == F.lit(n))


def level_bounds_predicate(eq=None, at_most=None, at_least=None, level: str = "level", conjunctive: bool = False, keep_missing: bool = False) -> Column | None:
    """Predicate of a level filter.

    Exclusive form (default): the first given of ``eq``, ``at_most``, ``at_least`` is used.
    Conjunctive form: every given bound applies; ``keep_missing`` lets rows without a level
    pass (search hits without metadata)."""
    lv = F.col(level)
    if not conjunctive:
        if eq is not None:
            return lv == F.lit(eq)
        if at_most is not None:
            return lv <= F.lit(at_most)
        if at_least is not None:
            return lv >= F.lit(at_least)
        return None
    parts = []
    if eq is not None:
        parts.append(lv == F.lit(eq))
    if at_most is not None:
        parts.append(lv <= F.lit(at_most))
    if at_least is not None:
        parts.append(lv >= F.lit(at_least))
    if not parts:
        return None
    pred = functools.reduce(operator.and_, parts)
    return (lv.isNull() | pred) if keep_missing else pred


def level_bounds(df: DataFrame, eq=None, at_most=None, at_least=None, level: str = "level", conjunctive: bool = False, keep_missing: bool = False) -> DataFrame:
    pred = level_bounds_predicate(eq, at_most, at_least, level, conjunctive, keep_missing)
    return df if pred is None else df.filter(pred)


def _comparable(df: DataFrame, name: str, value) -> bool:
    """Whether cells of the column can equal ``value``: text with text, numbers and truth values
    with each other, anything else (dates, times) with whatever Spark can cast.  A value of
    another kind equals no cell."""
    kind = df.schema[find_column(df, name)].dataType
    if value is None:
        return False
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return isinstance(value, (bool, int, float, Decimal))
    return True


def match_predicate(df: DataFrame, criteria: dict, literal: bool = False) -> Column | None:
    """AND over ``{column: value}``; column names are case-insensitive and an unknown column
    raises ``ValueError`` before any job runs.

    - list -> IN list (values of another kind than the column match nothing)
    - str  -> case-insensitive (Unicode) regular-expression search on the value as text
              (``literal=True``: plain substring); null cells never match
    - other scalar -> equality (null never equal)
    """
    parts = []
    for name, value in criteria.items():
        c = quoted(find_column(df, name))
        if isinstance(value, (list, tuple, set)):
            kept = [v for v in value if _comparable(df, name, v)]
            parts.append(c.isin(kept) if kept else F.lit(False))
        elif isinstance(value, str):
            s = c.cast("string")
            if literal:
                parts.append(F.lower(s).contains(value.lower()))
            else:
                parts.append(s.rlike("(?iu)" + value))
        else:
            parts.append(c == F.lit(value) if _comparable(df, name, value) else F.lit(False))
    if not parts:
        return None
    return functools.reduce(operator.and_, [F.coalesce(p, F.lit(False)) for p in parts])


def match(df: DataFrame, criteria: dict, literal: bool = False) -> DataFrame:
    pred = match_predicate(df, criteria, literal)
    return df if pred is None else df.filter(pred)


def between_dates(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts", end_of_day: bool = False) -> DataFrame:
    """Both ends inclusive and optional; rows without a time are dropped.  A date-only end
    means midnight (so the rest of that day is excluded) unless ``end_of_day``."""
    out = df.filter(F.col(ts).isNotNull())
    lo, hi = date_bound(start), date_bound(end, end_of_day)
    if lo is not None:
        out = out.filter(F.col(ts) >= lo)
    if hi is not None:
        out = out.filter(F.col(ts) <= hi)
    return out


def two_clock_range(df: DataFrame, start: str | None, end: str | None, event: str = "ts", stored: str = "stored_at", exact: bool = False) -> DataFrame:
    """Date range over a history table with two clocks.

    ``exact=True``: ``(event >= s OR stored >= s) AND (event <= e OR stored <= e)`` compared as
    text, with SQL three-valued logic for a null event time.
    Default: the event time decides; the stored time stands in only when the event time is null."""
    if exact:
        ev, st = F.col(event).cast("string"), F.col(stored).cast("string")
        out = df
        if start:
            out = out.filter((ev >= F.lit(start)) | (st >= F.lit(start)))
        if end:
            out = out.filter((ev <= F.lit(end)) | (st <= F.lit(end)))
        return out
    bounds = [(operator.ge, date_bound(start)), (operator.le, date_bound(end))]
    bounds = [(op, b) for op, b in bounds if b is not None]
    if not bounds:
        return df
    # written as an OR of plain ranges, not over coalesce, so that both reach the scan
    inside = lambda clock: functools.reduce(operator.and_, [op(F.col(clock), b) for op, b in bounds])
    return df.filter(inside(event) | (F.col(event).isNull() & inside(stored)))


def min_similarity(df: DataFrame, threshold: float = 0.3, col: str = "similarity") -> DataFrame:
    return df.filter(F.col(col) >= F.lit(threshold))


def non_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop rows whose text is null or whitespace only (Unicode whitespace)."""
    return df.filter(is_non_blank(F.col(text)))


def fresh(df: DataFrame, ts: str, now: str, hours: float = 24, drop_future: bool = False) -> DataFrame:
    """Rows at most ``hours`` old at time ``now`` (a parameter, so results are repeatable).  Rows
    newer than ``now`` are fresh too, unless ``drop_future``."""
    now_ts = F.lit(now).cast("timestamp_ntz")
    out = df.filter(F.col(ts) >= now_ts - F.make_dt_interval(secs=F.lit(float(hours) * 3600.0)))
    return out.filter(F.col(ts) <= now_ts) if drop_future else out


def keep_newest(df: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """The ``n`` most recent rows (ties broken by ``tie``); a top-k, planned as TakeOrdered."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(tie)).limit(n)


def first_rows(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """First ``n`` rows in table order."""
    return df.orderBy(order).limit(n)
