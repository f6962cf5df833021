"""Exact repeats of long byte strings through a logarithmic family of suffix-array levels.

A level is a sparse suffix array kept as a sorted table: one entry per run of suffixes that
share an anchor (see :mod:`~feedlake.llm.anchors`), in the order of the anchor's hash and of the
run, with the first place where the run occurs.  Sampling suffixes at anchors loses no match of
``length`` bytes or more, because equal strings of that length have the same anchor.

A new batch of documents gets its own suffix array, which is merge-scanned against the levels:
all are dealt by anchor and read in order, so equal entries lie next to each other.  The
batch's new entries (and a mark for each crowded anchor) become a level of rank 0; two levels of equal rank merge into one of the
next rank before the next batch, so ``n`` batches leave at most ``log2 n + 1`` levels and an
entry is rewritten at most ``log2 n`` times.

Batches must come in ascending order of ``doc_id``.  A byte is removed if it is covered by a
string of ``length`` bytes that also starts earlier: in a document with a smaller id or further
left in the same one.  Rows without id are compared with nothing and lose nothing; null and
empty texts have no bytes; rows that repeat an id with the same text give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.anchors import GONE, MARK, OLD, OPEN, SEED, SPAN_SCHEMA, Rule, contents, covered, packed, resolve, scan, seeds, with_spans
from feedlake.llm.arrow_text import column
from feedlake.session import scratch_path

GRAM = 20
#: The first batch of a one-off run is the smaller one: its level is dealt again with the second.
SHARES = (1, 3)
STORED = "h long, s long, doc_id long, lo long, n int, kind int"


class SuffixIndex:
    """Levels of suffix arrays; ``add`` takes the next batch and finds its repeats."""

    def __init__(self, spark: SparkSession, length: int = 100, **limits):
        self.spark, self.rule = spark, Rule("byte", length, min(GRAM, length), same_document=True, **limits)
        self.levels: list[tuple[int, str]] = []  # (rank, folder), the largest first

    def _read(self, path: str) -> DataFrame:
        rows = self.spark.read.schema(STORED).parquet(path).filter(F.col("kind").isin(SEED, MARK))
        return rows.select("h", "s", "doc_id", "lo", "n", "kind")

    def merge_levels(self) -> None:
        """Merge equal-ranked levels, the smallest first; entries of two levels never agree in
        (anchor, run), so merging is one sorted rewrite."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels[-2:]
            path = scratch_path(self.spark, "suffixes")
            both = self._read(a).unionAll(self._read(b))
            both.repartition("h").sortWithinPartitions("h", "s").write.partitionBy("kind").parquet(path)
            self.levels[-2:] = [(rank + 1, path)]

    def add(self, docs: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """(gone spans, open runs) of a batch.  ``keep=False`` scans without storing its level."""
        self.merge_levels()
        entries = seeds(docs, self.rule)
        for _, level in self.levels:
            old = self._read(level).withColumn("kind", F.when(F.col("kind") == SEED, F.lit(OLD)).otherwise(F.col("kind")))
            entries = entries.unionAll(packed(old))
        path = scratch_path(self.spark, "suffixes")
        wanted = [GONE, OPEN, SEED, MARK] if keep else [GONE, OPEN]
        scan(entries, self.rule).filter(F.col("kind").isin(*wanted)).write.partitionBy("kind").parquet(path)
        if keep:
            self.levels.append((0, path))
        found = self.spark.read.schema(STORED).parquet(path)
        return found.filter(F.col("kind") == GONE).select("doc_id", "lo", "n"), found.filter(F.col("kind") == OPEN).select("h", "doc_id", "lo", "n")


def batches_by_id(docs: DataFrame, shares: list[float]) -> list[DataFrame]:
    """``docs`` cut into ranges of ``doc_id`` that hold about these shares of the rows."""
    known = docs.filter(F.col("doc_id").isNotNull())
    ends = [sum(shares[: i + 1]) / sum(shares) for i in range(len(shares) - 1)]
    cuts = sorted(set(known.approxQuantile("doc_id", ends, 0.01))) if ends else []
    edges = [None, *cuts, None]
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = known if a is None else known.filter(F.col("doc_id") > a)
        out.append(part if b is None else part.filter(F.col("doc_id") <= b))
    return out


def repeated_strings(docs: DataFrame, length: int = 100, shares: tuple[float, ...] = SHARES, **limits) -> DataFrame:
    """``(doc_id, lo, n)``: ranges of starts of ``length``-byte strings that occur earlier."""
    spark = docs.sparkSession
    index = SuffixIndex(spark, length, **limits)
    gone, opened = spark.createDataFrame([], SPAN_SCHEMA), None
    parts = batches_by_id(docs, list(shares))
    for i, part in enumerate(parts):
        spans, runs = index.add(part, keep=i + 1 < len(parts))
        gone = gone.unionAll(spans)
        opened = runs if opened is None else opened.unionAll(runs)
    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return gone.unionAll(resolve(contents(opened.distinct(), known, index.rule), index.rule))


def removed_bytes(docs: DataFrame, length: int = 100, shares: tuple[float, ...] = SHARES, **limits) -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept`` (the remaining bytes)."""
    two = docs.select("doc_id", "text")
    joined = with_spans(docs, repeated_strings(two, length, shares, **limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, spans, kept = [], [], [], []
            for text, some in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
                data = (text or "").encode()
                total.append(len(data))
                if some:
                    mask = covered(some, length, len(data))
                    removed.append(int(mask.sum()))
                    spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                    data = np.frombuffer(data, np.uint8)[~mask].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(data)
            yield pa.RecordBatch.from_arrays([column(batch, "row"), *(pa.array(x, pa.int64()) for x in (total, removed, spans)), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = joined.select("row").withColumns({c: F.lit(0).cast("long") for c in ("n_bytes", "n_removed", "n_spans")}).withColumn("kept", F.lit(b"")).schema
    return joined.mapInArrow(run, schema)


def suffix_digests(docs: DataFrame, length: int = 100, shares: tuple[float, ...] = SHARES, **limits) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every document."""
    done = removed_bytes(docs.select("doc_id", "text"), length, shares, **limits)
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
