"""Content-hash dedupe: first row per hash, rows not stored yet.

``first_per_key`` is an aggregate (``min_by`` over the order column), not a window: Spark
combines rows of the same key inside each map task before the shuffle, so a hash shared by a
third of all rows (all punctuation-only texts share one) costs one row per map task in the
exchange instead of landing whole in one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import content_hash
from feedlake.sources.roles import quoted


def with_hash(df: DataFrame, text: str = "text", out: str = "text_hash") -> DataFrame:
    return df.withColumn(out, content_hash(quoted(text)))


def first_per_key(df: DataFrame, key: str = "text_hash", order: str = "row_id") -> DataFrame:
    """The row with the smallest ``order`` for every ``key``; columns keep their order."""
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(quoted(key)).agg(F.min_by(F.struct(*[quoted(c) for c in others]), quoted(order)).alias("__first"))
    return picked.select(*[quoted(key) if c == key else F.col("__first").getField(c).alias(c) for c in df.columns])


def new_rows(df: DataFrame, stored: DataFrame, key: str = "text_hash", probe: bool = False, max_probe_keys: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose key is not among ``stored``'s keys (left anti join).

    By default Catalyst picks the strategy (broadcast by statistics, else a sort-merge anti
    join whose skewed keys AQE splits).  ``probe=True`` is for a small incoming batch against
    a large stored table (ingest): when ``df`` has at most ``max_probe_keys`` rows (a bounded
    count), its distinct keys are broadcast to keep only the matching stored keys inside the
    stored table's scan - the stored side is read but never shuffled - and the anti join
    then runs against that small remainder."""
    stored_keys = stored.select(quoted(key))
    if probe and df.limit(max_probe_keys + 1).count() <= max_probe_keys:
        probe = F.broadcast(df.select(quoted(key)).distinct())
        stored_keys = stored_keys.join(probe, key, "left_semi")
    return df.join(stored_keys, key, "left_anti")
