"""Incremental ingest of arriving files with Structured Streaming.

Every micro-batch goes through the same steps as a batch load: first row per text hash,
anti join against the stored hashes, append to the history table and to the embedding
table.  A replayed micro-batch (after a failure between the two appends, or a lost
executor) appends nothing twice, because each table is anti-joined on its own hashes.
The stream's progress lives in its checkpoint folder (shared storage on a cluster), so a
restarted query resumes where it stopped.  One writer per table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.operators.encode import Encoder
from feedlake.sources.csv import null_tokens
from feedlake.sources.embeddings import append_new_embeddings
from feedlake.sources.history import append_new_history


def ingest_batch(batch: DataFrame, history_path: str, embeddings_path: str | None, stored_at: str, encoder: Encoder | None = None, order: str = "row_id") -> None:
    """One load: history first, then vectors (each is idempotent on its own)."""
    if order not in batch.columns:
        batch = batch.withColumn(order, F.monotonically_increasing_id())
    # the batch feeds two writes: keep it for the second read instead of recomputing it
    batch = batch.persist()
    try:
        append_new_history(batch, history_path, stored_at, order)
        if embeddings_path:
            append_new_embeddings(batch, embeddings_path, encoder, order)
    finally:
        batch.unpersist()


def ingest_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    history_path: str,
    checkpoint: str,
    embeddings_path: str | None = None,
    fmt: str = "csv",
    stored_at: str | None = None,
    encoder: Encoder | None = None,
    order: str = "row_id",
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
):
    """Start the ingest query over files arriving in ``source_dir``; returns the
    ``StreamingQuery``.  With ``available_now`` it processes what is there and stops."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)

    def run(batch: DataFrame, epoch_id: int) -> None:
        at = stored_at
        if at is None:
            at = batch.sparkSession.sql("select cast(date_trunc('second', localtimestamp()) as string) as t").first().t
        rows = null_tokens(batch) if fmt == "csv" else batch  # the cleaning step of the batch load
        ingest_batch(rows, history_path, embeddings_path, at, encoder, order)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
