"""Similarity search over a vector table: query vectors or a reference row, threshold,
top-k, level filters before or after ranking, and the reference row left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import is_non_blank
from feedlake.operators.blocks import knn
from feedlake.operators.filters import level_bounds_predicate


def reference_row(df: DataFrame, index: int, text: str | None = "text", order: str = "row_id") -> DataFrame:
    """The row at 0-based ``index`` among the non-blank rows in table order (a bounded
    TakeOrdered of ``index + 1`` rows).  Raises ``IndexError`` when out of range."""
    if index < 0:
        raise IndexError(f"reference index {index} is negative")
    rows = df.filter(is_non_blank(F.col(text))) if text else df
    ref = rows.orderBy(order).offset(index).limit(1)
    if ref.isEmpty():
        raise IndexError(f"reference index {index} is out of range")
    return ref


def search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    threshold: float | None = 0.3,
    metric: str = "cosine",
    eq=None,
    at_most=None,
    at_least=None,
    post_filter: bool = False,
    exclude_ids: DataFrame | None = None,
    exclude_self: bool = False,
    **knn_args,
) -> DataFrame:
    """Hits ``(query_id, row_id, level, similarity, rank)``.

    Level bounds (all given bounds apply, rows without a level pass) are applied to the
    corpus before ranking by default; ``post_filter=True`` applies them after top-k instead,
    so fewer than k hits may remain.  ``exclude_ids`` (``row_id`` column) removes rows - the
    reference row - before ranking, or after it with ``post_filter``."""
    pred = level_bounds_predicate(eq, at_most, at_least, "level", conjunctive=True, keep_missing=True)
    cand = corpus.select("row_id", "embedding", "level")
    if not post_filter:
        if pred is not None:
            cand = cand.filter(pred)
        if exclude_ids is not None:
            cand = cand.join(exclude_ids.select("row_id"), "row_id", "left_anti")
    hits = knn(queries, cand, k, metric, threshold, exclude_self, **knn_args)
    if post_filter:
        if pred is not None:
            hits = hits.filter(pred)
        if exclude_ids is not None:
            hits = hits.join(exclude_ids.select("row_id"), "row_id", "left_anti")
    return hits.select("query_id", "row_id", "level", "similarity", "rank")
