"""Vector column functions (arrays of floats), computed in double precision.

Spark has no vector built-in, so these are higher-order array expressions, which stay
inside the JVM.  Bulk similarity work (kNN, pair stage) uses blocked NumPy products in
``operators.blocks`` instead; these are for row-level use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    prod = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    sq = F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector has similarity 0 to everything."""
    denom = norm(a) * norm(b)
    return F.when(denom > 0, dot(a, b) / denom).otherwise(F.lit(0.0))


def l2_similarity(a, b) -> Column:
    """``1 - squared Euclidean distance`` (the similarity a squared-L2 index reports)."""
    diff = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.lit(1.0) - F.aggregate(diff, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def similarity(a, b, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return cosine(a, b)
    if metric == "l2":
        return l2_similarity(a, b)
    raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")
