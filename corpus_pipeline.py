"""Corpus pipeline: documents in, packed training sequences out.

``STAGES`` are applied in order; each is ``fn(spark, docs, sf_dir) -> DataFrame`` and works on
all that its predecessor kept.  All but the last return the columns of ``documents``; the last
returns one row per packed piece.  Between stages the rows are written as Parquet in the
shared folder of ``spark.checkpoint.dir`` and read again, so a lost executor costs one stage's
tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlake.llm.jaccard_join import keep_one
from feedlake.llm.packing import pack_documents
from feedlake.llm.quality import keep_good
from feedlake.llm.queries import table
from feedlake.llm.substring_dedup import drop_repeats
from feedlake.llm.toxicity import drop_toxic
from feedlake.session import bound_batches, ensure_checkpoint_dir, scratch_path, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps."""
    _ready(spark)
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the model learns from the labelled documents among
    those that arrive here."""
    _ready(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8, the smallest id."""
    _ready(spark)
    return keep_one(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word passages that an earlier document holds."""
    _ready(spark)
    return drop_repeats(docs, length=13)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, packed into sequences."""
    _ready(spark)
    return pack_documents(docs, "word_bpe_49k.json", end_id=1, capacity=4096)


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bound_batches(spark)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: The learned and iterative stages have no SQL form; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
