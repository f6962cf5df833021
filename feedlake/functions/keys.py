"""Deterministic job keys: a normalised query text plus its parameters."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.text import content_hash


def params_key(params: dict) -> str:
    """8 hex characters identifying a parameter set (key order does not matter)."""
    import hashlib

    text = json.dumps(params, sort_keys=True, default=str)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:8]


def query_key(query_col, params: dict) -> Column:
    """``<16-char normalised text hash>_<8-char parameter hash>`` for every row."""
    return F.concat(content_hash(query_col), F.lit("_" + params_key(params)))
