"""Substring deduplication by seed and extend over words.

Documents meet on winnowed anchors: the least-hashed ``GRAM``-word gram of every window of
``length`` words.  A seed is the stretch of the windows that have chosen it and does not grow
along a matching document; seeds that agree in all their words match as a whole, the others are compared window by window.
What remains is the union of all matching windows, the maximal repeats of at least ``length``
words.  A window is a repeat if its words also start in a document with a smaller id.

``doc_id`` names a document.  Rows without id are compared with nothing and lose nothing; null
and empty texts have no words; rows that repeat an id with the same text give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.anchors import GONE, OPEN, Rule, contents, covered, resolve, scan, seeds, with_spans
from feedlake.llm.arrow_text import column
from feedlake.session import scratch_path

GRAM = 5


def repeated_windows(docs: DataFrame, length: int = 13, **limits) -> DataFrame:
    """``(doc_id, lo, n)``: ranges of window starts (word numbers) that repeat earlier text.
    ``limits`` are those of :class:`~feedlake.llm.anchors.Rule`; results do not depend on them."""
    rule = Rule("word", length, min(GRAM, length), same_document=False, **limits)
    path = scratch_path(docs.sparkSession, "seeds")
    scan(seeds(docs, rule), rule).filter(F.col("kind").isin(GONE, OPEN)).write.partitionBy("kind").parquet(path)
    found = docs.sparkSession.read.schema("h long, s long, doc_id long, lo long, n int, kind int").parquet(path)
    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    opened = resolve(contents(found.filter(F.col("kind") == OPEN).select("h", "doc_id", "lo", "n"), known, rule), rule)
    return found.filter(F.col("kind") == GONE).select("doc_id", "lo", "n").unionAll(opened)


def dedup_words(docs: DataFrame, length: int = 13, **limits) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns), ``n_words``, ``n_removed`` and ``kept``, the
    remaining words joined by one space."""
    two = docs.select("doc_id", "text")
    spans = repeated_windows(two, length, **limits)
    joined = with_spans(docs, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, some in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
                words = (text or "").encode().split()  # ASCII white space, as the definition of a word
                gone = 0
                total.append(len(words))
                if some:
                    mask = covered(some, length, len(words))
                    gone = int(mask.sum())
                    words = [w for w, out in zip(words, mask.tolist(), strict=True) if not out]
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])

    schema = joined.select("row").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("")}).schema
    return joined.mapInArrow(run, schema)


def substring_digests(docs: DataFrame, length: int = 13, **limits) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document."""
    done = dedup_words(docs.select("doc_id", "text"), length, **limits)
    return done.select("row.doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def drop_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """The documents with repeats removed from ``text``, all columns; a text that loses nothing
    stays as it is, and ``n_chars`` follows the text where there is such a column."""
    done = dedup_words(docs, length)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", size)
    return done.select(row.alias("row")).select("row.*")
