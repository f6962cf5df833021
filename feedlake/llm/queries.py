"""The registered queries: each applies one operator to its whole table and derives the
contract's columns.  ``QUERIES`` maps names to ``fn(spark, sf_dir)``; ``ORACLES`` holds DuckDB
SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.oracles import ORACLES  # noqa: F401  (read by the entry module)
from feedlake.session import bound_batches, ensure_checkpoint_dir, scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}



def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.byte_bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1, capacity=4096)


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.token_files import document_digests, write_token_files

    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=2)
    return document_digests(spark, path)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.substring_dedup import substring_digests

    return substring_digests(table(spark, sf_dir, "documents"), length=13)


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.suffix_index import suffix_digests

    return suffix_digests(table(spark, sf_dir, "documents"), length=100)


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=5, percent=80)


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("places")


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from feedlake.llm.phrases import phrases

    return phrases(table(spark, sf_dir, "documents"), least=30, longest=4, first=2000)
