"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character 4-, 5- and 6-grams of the lower-cased whole text (white
space as one space, also before and after it), hashed
into ``2 ** BITS`` buckets.  For each bucket the ratio of its smoothed document counts in toxic
and other training texts gives a log-count ratio; a bucket's feature value is that ratio (Wang
and Manning, 2012).  A logistic model with L2 penalty on the scaled features gives the score.

Training reads labelled texts only: at most ``max_rows`` per label, the first in the order of
a hash of the document id, so the same rows whatever the partitioning.  The choice of rows is
the only bounded sample; scoring reads every text whole.  The model is one task's work on
those rows: buckets that occur in at least ``MIN_DOCS`` texts and have the strongest ratios,
``MAX_FEATURES`` at most.

Null and empty texts have no feature and get the score of the intercept.  Labels that are null
or not 0 or 1 are skipped; with one label or none in the training rows the score is the smoothed
share of label 1 (0 without any row).  Rows of ``documents`` or ``labels`` that repeat train once; an id
that names several texts trains with each of them, one with both labels under both, and ``max_rows``
holds for the rows that result, so it bounds what the fitting task reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column, gram_codes, mix, text_slices

ORDERS = (4, 5, 6)
BITS = 20
MIN_DOCS = 4
MAX_FEATURES = 1 << 15
MIN_RATIO = 1.0
PENALTY = 0.5
MAX_ROWS = 3000


@dataclass(frozen=True)
class Model:
    bucket: np.ndarray  # selected buckets
    weight: np.ndarray  # ratio times fitted coefficient of each
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.bucket] = self.weight
        return out


def _buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (bucket of each n-gram, text it is in); n-grams never cross texts."""
    points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(length + 1) - length - 1
    code = mix(points.astype(np.uint64) + np.uint64(1))
    for n in ORDERS:
        grams = gram_codes(code, n)
        ok = np.ones(len(grams), bool)
        for at in begin[1:] - 1:  # the separator before each text but the first
            ok[max(0, at - n + 1) : at + 1] = False
        place = np.flatnonzero(ok)
        bucket = (mix(grams[place] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32)
        yield bucket, np.searchsorted(begin, place, side="right") - 1


def presence(texts: list[str], selected: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs in order; with ``selected`` (a mask) only those buckets."""
    found = []
    for bucket, owner in _buckets(texts):
        if selected is not None:
            keep = selected[bucket]
            bucket, owner = bucket[keep], owner[keep]
        found.append(owner.astype(np.int64) << BITS | bucket)
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(owner: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> Model:
    """The model of (text, bucket) pairs, texts in ascending order, and the label of each text."""
    return fit_parts([(np.bincount(owner, minlength=len(label)), bucket)], label)


def fit_parts(parts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> Model:
    """Ratios, then the logistic fit by Newton-like steps with a per-feature curvature bound.

    ``parts`` hold consecutive texts: (number of buckets of each, the buckets).  Only pairs of chosen buckets are held
    together, so what a part needs besides its buckets is bounded by the part."""
    n_toxic, n_rest = int(label.sum()), int((1 - label).sum())
    nothing = np.zeros(0, np.int64)
    if not n_toxic or not n_rest:
        share = n_toxic / max(1, n_toxic + n_rest)
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(nothing, np.zeros(0), float(np.log(share / (1 - share))))
    toxic, rest, at = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), 0
    for sizes, bucket in parts:
        is_toxic = np.repeat(label[at : at + len(sizes)] == 1, sizes)
        toxic += np.bincount(bucket[is_toxic], minlength=1 << BITS)
        rest += np.bincount(bucket[~is_toxic], minlength=1 << BITS)
        at += len(sizes)
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((rest + 1) / (n_rest + 2))
    strong = np.flatnonzero((toxic + rest >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO))
    strength = np.abs(ratio[strong]) * np.sqrt((toxic + rest)[strong])
    strong = np.sort(strong[np.argsort(-strength, kind="stable")[:MAX_FEATURES]])
    number = np.full(1 << BITS, -1, np.int32)
    number[strong] = np.arange(len(strong))
    kept, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for sizes, bucket in parts:
        found = number[bucket]
        keep = found >= 0
        kept.append((np.repeat(np.arange(at, at + len(sizes)), sizes)[keep], found[keep].astype(np.int64)))
        at += len(sizes)
    row, col = (np.concatenate(v) for v in zip(*kept, strict=True))
    kept.clear()
    value = ratio[strong][col]
    rows, cols = len(label), len(strong)
    share = np.where(label == 1, rows / (2 * n_toxic), rows / (2 * n_rest))  # both classes weigh the same
    weight, bias = np.zeros(cols), 0.0
    scale = np.bincount(col, value * value * share[row], cols) / rows
    speed, last = np.zeros(cols), 0.0
    for _ in range(400):
        z = np.bincount(row, value * weight[col], rows) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = (p - label) * share
        grad = np.bincount(col, value * error[row], cols) / rows + PENALTY * weight / np.sqrt(rows)
        speed = 0.9 * speed - 0.05 * grad / (scale * 0.25 + 1e-3)
        weight += 0.2 * speed
        last = 0.9 * last - 0.05 * error.mean() / 0.25
        bias += 0.2 * last
    return Model(strong, weight * ratio[strong], bias)


def plain(text: str | None) -> str:
    """Lower case, white space as one space, a space at both ends."""
    return f" {' '.join((text or '').lower().split())} "


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [plain(t) for t in column(batch, name).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that never trains: CRC-32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents outside the held-out part."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = [usable.filter(F.col("label") == k).distinct().orderBy(order, "doc_id").limit(max_rows) for k in (0, 1)]
    few = F.broadcast(chosen[0].unionAll(chosen[1]))  # 2 * max_rows rows at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(few, "doc_id")
    rows = rows.select("label", order.alias("place"), F.xxhash64("text", F.length("text")).alias("mark"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            owner, bucket = presence(_texts(batch, "text"))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(cut, bucket.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("label", "place", "mark")), lists], ["label", "place", "mark", "bucket"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, parts = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                lists = column(some, "bucket")
                parts.append((lists.value_lengths().to_numpy(), lists.flatten().to_numpy()))
                label.append(column(some, "label").to_numpy())
        if label:
            m = fit_parts(parts, np.concatenate(label).astype(np.int64))
            yield pa.RecordBatch.from_pylist([{"bucket": m.bucket.tolist(), "weight": m.weight.tolist(), "intercept": m.intercept}], schema=pa.schema([("bucket", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64())), ("intercept", pa.float64())]))

    found = rows.mapInArrow(features, "label int, place long, mark long, bucket array<int>")
    once = found.groupBy("label", "place", "mark").agg(F.first("bucket").alias("bucket"))
    turn = Window.partitionBy("label").orderBy("place", "mark")
    bounded = once.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= max_rows)
    ordered = bounded.repartition(1).sortWithinPartitions("label", "turn").select("label", "bucket")
    fitted = ordered.mapInArrow(learn, "bucket array<int>, weight array<double>, intercept double").collect()
    if not fitted:
        return Model(np.zeros(0, np.int64), np.zeros(0), -30.0)
    return Model(np.array(fitted[0]["bucket"], np.int64), np.array(fitted[0]["weight"]), fitted[0]["intercept"])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, plus ``score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket, model.weight, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        table, selected = m.table(), np.zeros(1 << BITS, bool)
        selected[m.bucket] = True
        for batch in text_slices(batches, "body", limit=2 << 20):
            owner, bucket = presence(_texts(batch, "body"), selected)
            z = np.bincount(owner, table[bucket], batch.num_rows) + m.intercept
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["row", "score"])

    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("body"))
    schema = packed.select("row").withColumn("score", F.lit(0.0)).schema
    return packed.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **options))
    return scored.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents, all their columns, whose score is under ``threshold``."""
    return score(docs, train(docs, labels, **options)).filter(F.col("score") < threshold).select("row.*")
