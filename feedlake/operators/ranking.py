"""Distributed dense numbering of the distinct values of a column.

``dense_rank()`` over a window without a partition key moves every row into one task.  Here
the distinct values are range-partitioned and sorted, each partition is numbered locally,
and the partition offsets (one row per partition) are added back - every step stays
parallel, and only ``#partitions`` numbers meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def dense_index(values: DataFrame, col: str, out: str = "index") -> DataFrame:
    """``(col, out)``: 0-based rank of every distinct non-null value of ``col`` in ascending order."""
    ensure_checkpoint_dir(values.sparkSession)
    ordered = values.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)
    # monotonically_increasing_id = partition index << 33 | position inside the partition;
    # computed right after the range sort, so it follows the sort order.  Written once so
    # both uses below see the same ids.
    tagged = ordered.withColumn("__mid", F.monotonically_increasing_id()).checkpoint()
    tagged = tagged.withColumn("__part", F.shiftright("__mid", 33)).withColumn("__pos", F.col("__mid").bitwiseAND(F.lit(_LOW_BITS)))
    sizes = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: a single-task window here is bounded by the partition count
    offsets = sizes.withColumn(
        "__off", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("__part", "__off")
    return tagged.join(F.broadcast(offsets), "__part").select(col, (F.col("__off") + F.col("__pos")).alias(out))
