"""Stateful stream ingest: the first row of every text hash, remembered by the stream itself.

``ingest.ingest_stream`` asks the stored table which hashes of a micro-batch are new.  Here the hashes live in
the stream's keyed state (``applyInPandasWithState``), so a micro-batch reads its own rows and the state of its own
hashes and never the stored table.  State that is not seen again within ``expire_after`` seconds is forgotten,
which bounds it; a text that comes back later is stored again, and ``None`` keeps it for good.

Rows go to a Parquet file sink.  Its commit log takes each micro-batch exactly once, so a batch that is run again after
a failure stores nothing twice, and a stream restarted from its checkpoint resumes with its state.

Within a micro-batch the row with the smallest ``order`` is the first; across micro-batches the one that
arrived first, so a late row of a known hash is dropped however small its order.  Repeats of a hash are
reduced to one row per Arrow batch before the shuffle: a hash that a third of all rows share does not
move whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from feedlake.functions.numbers import lenient_int
from feedlake.functions.timeparts import parse_ts
from feedlake.operators.dedupe import with_hash
from feedlake.operators.filters import non_blank
from feedlake.sources.csv import null_tokens
from feedlake.sources.roles import quoted, resolve_roles

KEPT = T.StructType(
    [
        T.StructField("text_hash", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("place", T.LongType()),
    ]
)


def first_seen(expire_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Lets the first row of a key through and remembers the key, for ``expire_ms`` after its last row."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        rows = pd.concat(list(parts)).nsmallest(1, "place")  # one row per Arrow batch of the micro-batch
        state.update((int(rows["place"].iloc[0]),))
        if expire_ms is not None:
            state.setTimeoutDuration(expire_ms)
        if not known:
            yield rows

    return run


def _first_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows.sort_values("place", kind="stable").drop_duplicates("text_hash")


def hashed_rows(df: DataFrame, order: str) -> DataFrame:
    """Non-blank rows in the layout of ``KEPT``; a row without ``order`` comes after those with one."""
    roles = resolve_roles(df)
    roles.require("text")
    base = with_hash(non_blank(df, roles.text), roles.text)
    level = lenient_int(quoted(roles.level)) if roles.level else F.lit(None)
    ts = parse_ts(quoted(roles.timestamp), df.schema[roles.timestamp].dataType.simpleString()) if roles.timestamp else F.lit(None)
    last = F.lit((1 << 63) - 1)
    place = F.coalesce(quoted(order).cast("long"), last) if order in df.columns else F.monotonically_increasing_id()
    return base.select("text_hash", quoted(roles.text).cast("string").alias("text"), level.cast("int").alias("level"), ts.cast("timestamp_ntz").alias("ts"), place.alias("place"))


def first_seen_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    out_path: str,
    checkpoint: str,
    fmt: str = "csv",
    order: str = "row_id",
    expire_after: float | None = None,
    max_files_per_trigger: int | None = None,
):
    """Start the query over what lies in ``source_dir`` and return it; it stops when all is stored under
    ``out_path``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.load(source_dir)
    rows = hashed_rows(null_tokens(rows) if fmt == "csv" else rows, order)
    few = rows.mapInPandas(_first_of_batch, KEPT)
    timeout = GroupStateTimeout.NoTimeout if expire_after is None else GroupStateTimeout.ProcessingTimeTimeout
    remember = first_seen(None if expire_after is None else max(1, int(1000 * expire_after)))
    first = few.groupBy("text_hash").applyInPandasWithState(remember, KEPT, "place long", "append", timeout)
    writer = first.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append").trigger(availableNow=True)
    # Batches without data would follow each other without end, looking for hashes to forget; these are
    # forgotten in the next micro-batch with data.  A query keeps the settings it was started with.
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)
