"""Small numeric helpers: shares, changes, direction words, lenient int cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Direction words for a change in average level.
IMPROVEMENT, DECLINE, STABLE = "Improvement", "Decline", "Stable"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(n, total) -> Column:
    """``n / total * 100`` as double; 0 when the total is 0 or null."""
    t = _col(total).cast("double")
    return F.when(t > 0, _col(n).cast("double") / t * 100.0).otherwise(F.lit(0.0))


def change(new, old) -> Column:
    return _col(new).cast("double") - _col(old).cast("double")


def direction(delta) -> Column:
    """Improvement if > 0, Decline if < 0, otherwise (0 or null) Stable."""
    d = _col(delta)
    return F.when(d > 0, IMPROVEMENT).when(d < 0, DECLINE).otherwise(STABLE)


def lenient_int(c) -> Column:
    """int() semantics: numbers and numeric strings truncate toward zero, others -> null."""
    return _col(c).cast("string").try_cast("double").try_cast("int")
