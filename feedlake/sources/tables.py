"""Readers for the driver tables and the standard views built on them.

Views (all lazily defined; Catalyst prunes columns and pushes filters to the scans):

- ``feedback``      (row_id, text, level, ts, lang, source): documents with a rating and a
                    time borrowed from ``events``; documents without a matching event keep
                    null level and time.
- ``rated_orders``  (row_id, level, ts): orders as ratings over a long time span.
- ``vectors``       (row_id, embedding, level): the embeddings table, label as level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    # equi-join on a computed key; Spark shuffles both sides on the key (or broadcasts
    # the event side when its statistics say it is small)
    joined = docs.join(ev, ev.event_id == docs.doc_id * 10, "left")
    return joined.select(
        F.col("doc_id").alias("row_id"),
        F.col("text"),
        (F.lit(1) + F.col("user_id") % 5).cast("int").alias("level"),
        F.col("ts"),
        F.col("lang"),
        F.col("source"),
    )


def rated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"),
        F.col("o_orderdate").alias("ts"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").alias("level"))
