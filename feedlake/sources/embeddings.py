"""Embedding table: one vector per normalised text hash, append-only Parquet.

Layout: ``text_hash string, snippet string (first 500 chars), level int, ts timestamp_ntz,
embedding array<float>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.numbers import lenient_int
from feedlake.functions.text import snippet
from feedlake.functions.timeparts import parse_ts
from feedlake.operators.dedupe import first_per_key, new_rows, with_hash
from feedlake.operators.encode import Encoder, encode
from feedlake.operators.filters import non_blank
from feedlake.session import written_once
from feedlake.sources.roles import quoted, resolve_roles

EMBEDDING_SCHEMA = T.StructType(
    [
        T.StructField("text_hash", T.StringType(), False),
        T.StructField("snippet", T.StringType(), True),
        T.StructField("level", T.IntegerType(), True),
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    ]
)


def open_embeddings(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(EMBEDDING_SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], EMBEDDING_SCHEMA)
        raise


def embedding_rows(df: DataFrame, existing: DataFrame | None, encoder: Encoder | None = None, order: str = "row_id") -> DataFrame:
    """Rows to append: non-blank texts, one per hash (first in ``order``), minus stored
    hashes, encoded once each."""
    roles = resolve_roles(df).require("text")
    base = with_hash(non_blank(df, roles.text), roles.text)
    cols = ["text_hash", order, roles.text] + [c for c in (roles.level, roles.timestamp) if c]
    first = first_per_key(base.select(*[quoted(c) for c in dict.fromkeys(cols)]), "text_hash", order)
    level = lenient_int(quoted(roles.level)) if roles.level else F.lit(None).cast("int")
    ts = parse_ts(quoted(roles.timestamp), df.schema[roles.timestamp].dataType.simpleString()) if roles.timestamp else F.lit(None).cast("timestamp_ntz")
    shaped = first.select("text_hash", quoted(roles.text).alias("__text"), snippet(quoted(roles.text), 500).alias("snippet"), level.alias("level"), ts.alias("ts"))
    if existing is not None and not existing.isEmpty():  # the probe and the anti join both use the rows
        shaped = new_rows(written_once(shaped, "first-rows"), existing, "text_hash", probe=True)
    return encode(shaped, "__text", "embedding", encoder).select("text_hash", "snippet", "level", "ts", "embedding")


def append_new_embeddings(df: DataFrame, path: str, encoder: Encoder | None = None, order: str = "row_id") -> DataFrame:
    """Encode and append the texts whose hash is not stored yet; returns the whole table as
    written (a replayed load appends nothing)."""
    spark = df.sparkSession
    rows = embedding_rows(df, open_embeddings(spark, path), encoder, order)
    rows.write.mode("append").parquet(path)
    return open_embeddings(spark, path)


def attach_embeddings(df: DataFrame, path: str, encoder: Encoder | None = None, text: str = "text", order: str = "row_id") -> DataFrame:
    """Every non-blank row of ``df`` with its vector: stored vectors are reused by hash; the
    missing hashes are encoded once, appended to the table, then joined like the others."""
    append_new_embeddings(df, path, encoder, order)
    stored = open_embeddings(df.sparkSession, path).select("text_hash", "embedding")
    return with_hash(non_blank(df, text), text).join(stored, "text_hash", "left")
