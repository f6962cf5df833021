"""Ranked lexical search: item tiles times document impact tiles, multiplied densely.

The items to search for have a small vocabulary between them.  A document's impact on a term
is an integer of its own counts and of the corpus totals, a term's weight in an item another one,
and a score is their product summed over the terms: a matrix product of documents x terms with
terms x items.  The product runs in float64 through BLAS and is exact: the weights are cut along
the vocabulary so that no partial sum reaches 2**53, and the parts are added as 64-bit integers.

1. Items are dealt to tiles by a hash of their id, so many that a tile holds about ``TILE_ITEMS``
   items and ``TILE_TERMS`` terms; usually there is one tile.  Each tile is one round of the
   following steps, so what a round sends to the workers does not grow with the items.
2. Postings: every text is cut into terms once; a document keeps its number of terms and the counts of the
   terms that the tile's items use.  They are written to the shared folder.
3. Totals: documents with a term, all their terms, and documents per term of the vocabulary.
4. Scores: blocks of documents become dense tiles over the terms that occur in them, at most
   ``TILE_COLUMNS`` at a time.  A task keeps each item's ``k`` best documents so far, by score
   and then by id, so a tie is never cut the wrong way; the tasks' best are ranked by Spark in two steps.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased, and are compared
by 64-bit hashes.  Null and empty texts have no terms: as documents they count nowhere, as items
they find nothing.  Every row of the documents is a document, also where ids repeat (such rows are
ranked side by side); a row without id takes part and comes after equal scores with an id.
Rows of one item id are one item with the terms of all of them.  Documents score above 0 or are not
returned; without documents or items the result is empty.  Columns besides id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column, text_bytes, text_slices, words
from feedlake.session import scratch_path

TILE_ITEMS, TILE_TERMS = 512, 1 << 14
TILE_COLUMNS, TILE_DOCS = 4096, 1024
IMPACT_SCALE, K1, B = 1_000_000_000, 8, 75
MOST_IMPACT = IMPACT_SCALE // 1000
EXACT = 1 << 53
NO_ID = np.iinfo(np.int64).max

_TERM_BYTES = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM_BYTES[_low : _high + 1] = np.arange(_low, _high + 1)
_TERM_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term in text order, first one of each text)."""
    flat, offsets = text_bytes(texts)
    found = words(_TERM_BYTES[flat], offsets)
    return found.code, found.first


def counted(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, occurrences) of every term of every text, ascending by text and code."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[new], code[new], np.diff(np.concatenate([new, [len(code)]]))


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term, times)``: the terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            owner, code, times = counted(*terms(column(batch, "text")))
            ids = column(batch, "item_id").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([ids, pa.array(code.view(np.int64)), pa.array(times)], ["item_id", "term", "times"])

    found = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term long, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


@dataclass
class Items:
    """One tile of items: ids, vocabulary (ascending hashes), and the entries of the items x
    vocabulary matrix: ``times`` of term ``term`` in item ``item``."""

    ids: list
    vocabulary: np.ndarray
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def item_tile(rows: list) -> Items:
    ids = sorted({r["item_id"] for r in rows}, key=lambda i: (i is None, i))
    place = {i: n for n, i in enumerate(ids)}
    code = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
    vocabulary, term = np.unique(code, return_inverse=True)
    return Items(ids, vocabulary, np.array([place[r["item_id"]] for r in rows]), term, np.array([r["times"] for r in rows], np.int64))


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(doc_id, n, term, tf)`` per document with a term: ``n`` terms in all, and little-endian
    arrays of the places in ``vocabulary`` that occur and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one tile's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in text_slices(batches):
            code, first = terms(column(batch, "text"))
            n = np.diff(first)
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = np.concatenate([[0], np.cumsum(known[at] == code)])
            owner, term, tf = counted(at[known[at] == code], hit[first])
            cut = np.searchsorted(owner, np.arange(len(n) + 1))
            some = np.flatnonzero(n > 0)
            packed = ([x[cut[i] : cut[i + 1]].tobytes() for i in some.tolist()] for x in (term.astype("<i4"), tf.astype("<i8")))
            ids = column(batch, "doc_id").take(pa.array(some))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[some]), *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, term binary, tf binary")


def _joined(batch: pa.RecordBatch, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a column of packed arrays, first one of each row)."""
    cells = [np.frombuffer(v.as_buffer(), kind) for v in column(batch, name)]
    return np.concatenate(cells or [np.zeros(0, kind)]), np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)


def document_counts(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the ``size`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch, "term", "<i4")[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for row in found.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most a row per term
        df[row["term"]] = row["df"]
    return df


def weight_parts(items: Items, weight: np.ndarray) -> list[np.ndarray]:
    """The weights (times x term weight) of the entries as a sum of parts.  In a part the
    weights of an item add up to so little that a score made from them stays below 2**53; the weight of one
    entry may stand in several parts."""
    each = items.times * weight[items.term]
    order = np.lexsort((items.term, items.item))
    upto = np.cumsum(each[order])
    start = np.searchsorted(items.item[order], items.item[order])  # first entry of each entry's item
    upto -= (upto - each[order])[start]
    most = (EXACT - 1) // MOST_IMPACT
    parts = []
    for low in range(0, int(upto.max(initial=0)), most):
        part = np.zeros(len(each), np.int64)
        part[order] = np.clip(upto, low, low + most) - np.clip(upto - each[order], low, low + most)
        parts.append(part)
    return parts


def length_terms(n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """``m`` of documents with ``n`` terms."""
    size, place = np.unique(n, return_inverse=True)
    return np.array([100 - B + B * x * documents // all_terms for x in size.tolist()], np.int64)[place]


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return IMPACT_SCALE * tf // (1000 * tf + K1 * m)


class Best:
    """The ``k`` best documents so far of each item, by descending score and ascending id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items
        self.least = np.zeros(items, np.int64)  # a lower score cannot come in any more

    def add(self, scores: np.ndarray, doc: np.ndarray) -> None:
        """``scores``: documents x items."""
        for item in np.flatnonzero((scores.max(0) >= self.least) & (scores.max(0) > 0)).tolist():
            mine = scores[:, item]
            if len(mine) > self.k:  # ties with the k-th stay
                least = np.partition(mine, len(mine) - self.k)[len(mine) - self.k]
                at = np.flatnonzero((mine >= max(least, self.least[item])) & (mine > 0))
            else:
                at = np.flatnonzero(mine > 0)
            score, ids = np.concatenate([self.score[item], mine[at]]), np.concatenate([self.doc[item], doc[at]])
            first = np.lexsort((ids, -score))[: self.k]
            self.score[item], self.doc[item] = score[first], ids[first]
            if len(first) == self.k:
                self.least[item] = score[first[-1]]


def tile_scores(m: np.ndarray, term: np.ndarray, tf: np.ndarray, first: np.ndarray, items: Items, parts: list[np.ndarray]) -> np.ndarray:
    """Scores of a tile of documents for all items of a tile, documents x items."""
    owner = np.repeat(np.arange(len(m)), np.diff(first))
    impact = impacts(tf, m[owner]).astype(np.float64)
    scores = np.zeros((len(m), len(items.ids)), np.int64)
    used = np.unique(term)
    for begin in range(0, len(used), TILE_COLUMNS):
        columns = used[begin : begin + TILE_COLUMNS]
        place = np.full(len(items.vocabulary), -1)
        place[columns] = np.arange(len(columns))
        mine = np.flatnonzero(place[term] >= 0)
        left = np.zeros((len(m), len(columns)))
        left[owner[mine], place[term[mine]]] = impact[mine]
        wanted = np.flatnonzero(place[items.term] >= 0)
        for part in parts:
            right = np.zeros((len(columns), len(items.ids)))
            right[place[items.term[wanted]], items.item[wanted]] = part[wanted]
            scores += (left @ right).astype(np.int64)
    return scores


def tile_best(found: DataFrame, items: Items, parts: list[np.ndarray], documents: int, all_terms: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: each task's ``k`` best documents of each item (its place in the tile)."""
    shared = found.sparkSession.sparkContext.broadcast((items, parts))  # one tile's items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, parts = shared.value
        best = Best(len(items.ids), k)
        for whole in batches:
            for at in range(0, whole.num_rows, TILE_DOCS):
                batch = whole.slice(at, TILE_DOCS)
                doc = column(batch, "doc_id").fill_null(NO_ID).to_numpy()
                term, first = _joined(batch, "term", "<i4")
                m = length_terms(column(batch, "n").to_numpy(), documents, all_terms)
                best.add(tile_scores(m, term, _joined(batch, "tf", "<i8")[0], first, items, parts), doc)
        item = np.repeat(np.arange(len(items.ids)), [len(s) for s in best.score])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(best.doc)), pa.array(np.concatenate(best.score))], ["item", "doc_id", "score"])

    return found.mapInArrow(run, "item long, doc_id long, score long")


def _first(df: DataFrame, k: int, *by: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    wanted = _written(item_terms(items), "items")
    size = wanted.agg(F.countDistinct("item_id").alias("items"), F.count("*").alias("terms")).first()
    tiles = max(1, -(-size["items"] // TILE_ITEMS), -(-size["terms"] // TILE_TERMS))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for number in range(tiles):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(tiles)) == number).collect()  # one tile's terms
        if not rows:
            continue
        tile = item_tile(rows)
        found = _written(postings(docs, tile.vocabulary), "postings")
        total = found.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
        documents, all_terms = total["documents"], total["terms"] or 0
        df = document_counts(found, len(tile.vocabulary))
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        best = tile_best(found, tile, weight_parts(tile, weight), documents, all_terms, k)
        dealt = best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256)))
        ranked = _first(_first(dealt, k, "item", "part").drop("rank", "part"), k, "item")
        names = spark.createDataFrame(list(enumerate(tile.ids)), "item long, item_id long")
        one = ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = out.unionAll(one)
    return out
