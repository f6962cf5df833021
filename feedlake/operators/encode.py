"""Text -> vector encoding as an Arrow-batched pandas UDF.

The encoder is any function ``list[str] -> ndarray(n, dim)``; it is called once per Arrow
batch inside the executors (a model would be loaded once per Python worker by the caller's
function).  The default is a feature-hashing encoder over normalised words, which needs no
model file and gives the same vector for texts that normalise alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.text import normalize_text

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Feature hashing of the words of already-normalised texts into ``dim`` buckets,
    L2-normalised (the empty text maps to the zero vector)."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            if not t:
                continue
            idx = np.fromiter((zlib.crc32(w.encode("utf-8")) % dim for w in t.split(" ")), dtype=np.int64)
            counts = np.bincount(idx, minlength=dim).astype(np.float32)
            n = np.linalg.norm(counts)
            if n > 0:
                out[i] = counts / n
        return out

    return encode


def encoder_udf(encoder: Encoder, batch_size: int = 100):
    """A scalar-iterator pandas UDF applying ``encoder`` to chunks of ``batch_size`` texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vals = texts.fillna("").astype(str).tolist()
            parts = [encoder(vals[i : i + batch_size]) for i in range(0, len(vals), batch_size)]
            mat = np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.float32)
            yield pd.Series([row.astype(np.float32) for row in mat], dtype=object)

    return _encode


def encode(df: DataFrame, text: str = "text", out: str = "embedding", encoder: Encoder | None = None, normalize_first: bool = True, batch_size: int = 100) -> DataFrame:
    """Add a vector column ``out`` computed from ``text``."""
    enc = encoder or hashing_encoder()
    src: Column = normalize_text(F.col(text)) if normalize_first else F.col(text)
    return df.withColumn(out, encoder_udf(enc, batch_size)(src))

