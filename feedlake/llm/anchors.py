"""Repeated windows by content-chosen anchors (shared by the substring operators).

A *window* is ``length`` consecutive elements (bytes or words) of one document.  Its *anchor* is
the leftmost least hash among its ``gram``-element grams, so equal windows have equal anchors at
the same place.  Consecutive windows with one anchor form a *run*; a document of ``n`` elements
has about ``2 n / (length - gram)`` runs, and a run is known by three numbers: the anchor's
hash ``h``, a hash ``s`` of all its elements, and its place.

Which windows occur earlier is then decided in three steps, none of which moves every window:

- runs with equal ``s`` are equal as a whole: all but the first are gone;
- a run whose anchor occurs in no other run is new as a whole;
- runs that share an anchor but not all elements stay *open*: only these, a few per edit or
  passage end, are compared window by window, from their elements.

Skew: a task first drops runs it has already seen itself, so a run in a third of all documents
reaches the shuffle once per slice of a task.  An anchor with many different runs in one slice
(the ends of a common passage) is opened at once and leaves only a marker behind, and open
groups above ``hot_group`` runs are dealt by window instead of by anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import BYTE_CODE, column, gram_codes, mix, sliding_argmin, spread, text_bytes, text_slices, words

GONE, MARK, OPEN, SEED, OLD = 0, 1, 2, 3, 4
#: What is shuffled for a run: ``place`` holds its first window, how many, and its kind.
SEED_SCHEMA = "h long, s long, doc_id long, place long"
MOST_WINDOWS = (1 << 16) - 1
SPAN_SCHEMA = "doc_id long, lo long, n int"


@dataclass(frozen=True)
class Rule:
    """What a window is, and which earlier occurrence counts: any (``same_document``) or only
    one in a document with a smaller id."""

    unit: str  # "byte" or "word"
    length: int
    gram: int
    same_document: bool
    segment: int = 1 << 19  # elements hashed at a time
    hot_in_slice: int = 8  # runs of an anchor in one slice of a task that open it at once
    hot_group: int = 20_000  # open runs of an anchor above which they are dealt by window


def decoded(rule: Rule, stored: list[bytes]) -> np.ndarray:
    """Codes of stored elements: bytes are stored as they are, words by their codes."""
    data = b"".join(stored)
    return BYTE_CODE[np.frombuffer(data, np.uint8)] if rule.unit == "byte" else np.frombuffer(data, np.uint64)


def elements(rule: Rule, texts: pa.Array) -> tuple[Callable[[int, int], np.ndarray], np.ndarray, Callable[[int, int], bytes]]:
    """(codes of the elements a .. b, first element of each text and, last, their number, the
    elements a .. b as they are stored)."""
    flat, offsets = text_bytes(texts)
    if rule.unit == "byte":
        return lambda a, b: BYTE_CODE[flat[a:b]], offsets, lambda a, b: flat[a:b].tobytes()
    w = words(flat, offsets)
    return lambda a, b: w.code[a:b], w.first, lambda a, b: w.code[a:b].tobytes()


def runs(rule: Rule, codes: Callable[[int, int], np.ndarray], first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``(h, s, start, n)`` of the runs of all texts, a bounded segment at a time.  A run that
    meets a segment's end is cut there; its parts are opened if need be, like other runs."""
    total, length = int(first[-1]), rule.length
    for a in range(0, max(0, total - length + 1), rule.segment):
        code = codes(a, min(total, a + rule.segment + length - 1))
        ok = np.ones(len(code) - length + 1, bool)
        inner = first[np.searchsorted(first, a, side="right") : np.searchsorted(first, a + len(code))] - a
        for cut in np.unique(inner):
            ok[max(0, cut - length + 1) : cut] = False
        start = np.flatnonzero(ok)
        if not len(start):
            continue
        gram = mix(gram_codes(code, rule.gram))
        window = mix(gram_codes(code, length))
        at = sliding_argmin(gram, length - rule.gram + 1)[start]
        begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        n = np.diff(np.concatenate([begin, [len(start)]]))
        lo = start[begin]
        # Two windows cover the run, which is shorter than they are together.
        whole = mix(window[lo] * np.uint64(3) + mix(window[lo + n - 1] + n.astype(np.uint64)))
        # 48 bits tell anchors apart; those that agree by chance only open runs without need.
        yield gram[at[begin]] >> np.uint64(16), whole, lo + a, n


def cut_spans(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges of at most ``MOST_WINDOWS`` each."""
    times = -(-n // MOST_WINDOWS)
    step = spread(times) * MOST_WINDOWS
    return np.repeat(doc, times), np.repeat(lo, times) + step, np.minimum(np.repeat(n, times) - step, MOST_WINDOWS)


def merge_spans(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges of equal documents, joined where they touch; rows sorted by (doc, lo)."""
    if not len(doc):
        return doc, lo, n
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > lo[:-1] + n[:-1])]))
    return doc[begin], lo[begin], np.maximum.reduceat(lo + n, begin) - lo[begin]


def _rows(kind, h, s, doc, lo, n) -> pa.RecordBatch:
    place = lo.astype(np.int64) << 20 | np.asarray(n, np.int64) << 4 | np.asarray(kind, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), s.view(np.int64), doc, place)], ["h", "s", "doc_id", "place"])


def packed(rows: DataFrame) -> DataFrame:
    """``h, s, doc_id, lo, n, kind`` in the form that is shuffled."""
    place = F.shiftleft(F.col("lo").cast("long"), 20).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 4)).bitwiseOR(F.col("kind").cast("long"))
    return rows.select("h", "s", "doc_id", place.alias("place"))


def unpacked(rows: DataFrame) -> DataFrame:
    place = F.col("place")
    return rows.select("h", "s", "doc_id", F.shiftright(place, 20).alias("lo"), F.shiftright(place, 4).bitwiseAND(F.lit(MOST_WINDOWS)).cast("int").alias("n"), place.bitwiseAND(F.lit(15)).cast("int").alias("kind"))


def _slice_rows(rule: Rule, h, s, doc, lo, n) -> pa.RecordBatch:
    """Runs of one slice, less those that equal an earlier run of the slice."""
    order = np.lexsort((lo, doc, s))
    h, s, doc, lo, n = (x[order] for x in (h, s, doc, lo, n))
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.concatenate([begin, [len(s)]]))
    leader = np.repeat(begin, size)
    later = (doc != doc[leader]) | ((lo != lo[leader]) if rule.same_document else False)
    keep = ~later
    gone = np.flatnonzero(later)
    gone = gone[np.lexsort((lo[gone], doc[gone]))]
    g_doc, g_lo, g_n = cut_spans(*merge_spans(doc[gone], lo[gone], n[gone]))
    h, s, doc, lo, n = (x[keep] for x in (h, s, doc, lo, n))
    by = np.lexsort((s, h))
    new_h = np.concatenate([[True], h[by][1:] != h[by][:-1]])
    new_s = new_h | np.concatenate([[True], s[by][1:] != s[by][:-1]])
    group = np.cumsum(new_h) - 1
    crowded = np.bincount(group, new_s) > rule.hot_in_slice
    kind = np.empty(len(h), np.int32)
    kind[by] = np.where(crowded[group], OPEN, SEED)
    marks = h[by][new_h][crowded]
    zero = np.zeros(len(marks), np.int64)
    least = np.full(len(marks), 1 << 63, np.uint64)  # as a long, before all runs
    none = np.zeros(len(g_doc), np.uint64)
    return _rows(
        np.concatenate([kind, np.full(len(marks), MARK), np.full(len(g_doc), GONE)]),
        np.concatenate([h, marks, none]),
        np.concatenate([s, least, none]),
        np.concatenate([doc, zero, g_doc]),
        np.concatenate([lo, zero, g_lo]),
        np.concatenate([n, zero, g_n]),
    )


def seeds(docs: DataFrame, rule: Rule) -> DataFrame:
    """Runs of all documents (``doc_id`` not null, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            codes, first, _ = elements(rule, column(batch, "text"))
            ids = column(batch, "doc_id").to_numpy()
            found = list(runs(rule, codes, first))
            if found:
                h, s, lo, n = (np.concatenate(x) for x in zip(*found, strict=True))
                text = np.searchsorted(first, lo, side="right") - 1
                yield _slice_rows(rule, h, s, ids[text], lo - first[text], n)

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, SEED_SCHEMA)


def scan(entries: DataFrame, rule: Rule) -> DataFrame:
    """Merge-scan of runs, sorted by (anchor, run, document, place).

    Out come ``GONE`` runs, ``OPEN`` runs, as ``SEED`` the first run of each (h, s) that was not
    ``OLD``, and a ``MARK`` for each crowded anchor, whose runs are all open.  The state between batches is the last run and, while an anchor has only
    one run so far, that run's rows of its first document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last anchor that are not decided, in front of the next batch
        for batch in batches:
            h, s, doc, place = (column(batch, c).to_numpy() for c in ("h", "s", "doc_id", "place"))
            kind, lo, n = place & 15, place >> 20, place >> 4 & MOST_WINDOWS
            passed = (kind == GONE) | (kind == OPEN)
            if passed.any():
                yield _rows(kind[passed], h[passed], s[passed], doc[passed], lo[passed], n[passed])
            rows = [x[~passed] for x in (kind, h, s, doc, lo, n)]
            if not len(rows[0]):
                continue
            rows = [*rows, np.zeros(len(rows[0]), bool)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            out, held = _scan_rows(rule, rows, last=False)
            if out is not None:
                yield out
        if held is not None:
            out, _ = _scan_rows(rule, held, last=True)
            if out is not None:
                yield out

    by_anchor = F.col("place").bitwiseAND(F.lit(15)).isin(SEED, MARK, OLD)
    deal = F.when(by_anchor, F.col("h")).otherwise(F.xxhash64("doc_id", "place"))
    return unpacked(entries.repartition(deal).sortWithinPartitions("h", "s", "doc_id", "place").mapInArrow(run, SEED_SCHEMA))


def _scan_rows(rule: Rule, rows: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray] | None]:
    """Decide the anchors in ``rows``; the last one waits while it has a single run, unless
    these are the ``last`` rows.  Rows marked ``seen`` were decided before."""
    kind, h, s, doc, lo, n, seen = rows
    real = kind != MARK
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_s = real & (new_h | np.concatenate([[True], s[1:] != s[:-1]]))
    leader = np.maximum.accumulate(np.where(new_s, np.arange(len(h)), 0))
    elsewhere = lo != lo[leader]
    later = real & ~new_s & ((doc != doc[leader]) | (elsewhere if rule.same_document else False))
    candidate = real & ~later & ~seen & (new_s | elsewhere)
    group = np.cumsum(new_h) - 1
    crowd = (np.bincount(group, new_s) + 2 * np.bincount(group, ~real))[group]
    tail = (group == group[-1]) & (not last)
    waiting = tail & candidate & (crowd <= 1)
    masks = {GONE: later & ~seen & (kind != OLD), OPEN: candidate & (crowd > 1), SEED: new_s & ~seen & (kind == SEED) & ~waiting, MARK: ~real & ~seen & new_h}
    at = np.concatenate([np.flatnonzero(m) for m in masks.values()])
    names = np.repeat(list(masks), [int(m.sum()) for m in masks.values()])
    out = _rows(names, h[at], s[at], doc[at], lo[at], n[at]) if len(at) else None
    if last:
        return out, None
    if crowd[-1] <= 1:
        return out, [x[waiting] for x in rows]
    stand = leader[-1:] if (tail & real).any() else np.zeros(0, np.int64)
    mark = (MARK, h[-1], np.iinfo(np.int64).min, 0, 0, 0, True)
    held = [np.concatenate([np.array([m], x.dtype), x[stand]]) for m, x in zip(mark, rows, strict=True)]
    held[6][:] = True
    return out, held


def contents(open_runs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """``(key, doc_id, lo, n, codes)``: open runs with their elements, keyed by their anchor.

    Runs of an anchor with more than ``hot_group`` of them are cut into single windows, keyed by
    the window; of equal ones in a batch only the first stays.  Rows without codes are gone.
    """
    hot = open_runs.groupBy("h").count().filter(F.col("count") > rule.hot_group).select("h", F.lit(True).alias("hot"))
    marked = open_runs.join(hot, "h", "left")
    per_doc = marked.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "n", "h", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    rows = docs.join(per_doc, "doc_id").select("doc_id", "text", "runs")
    schema = "key long, doc_id long, lo long, n int, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            codes, first, stored = elements(rule, column(batch, "text"))
            lists = column(batch, "runs")
            size = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            lo, n, h, split = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "n", "h", "hot"))
            owner = np.repeat(np.arange(batch.num_rows), size)
            doc = column(batch, "doc_id").to_numpy()[owner]
            fits = first[owner] + lo + n + rule.length - 1 <= first[owner + 1]  # else the id names several texts
            lo, n, h, split, owner, doc = (x[fits] for x in (lo, n, h, split, owner, doc))
            begin = first[owner] + lo
            end = begin + n + rule.length - 1
            plain = np.flatnonzero(~split)
            yield _content_rows(h[plain], doc[plain], lo[plain], n[plain], [stored(a, b) for a, b in zip(begin[plain].tolist(), end[plain].tolist(), strict=True)])
            cut = np.flatnonzero(split)
            if len(cut):
                m = n[cut].astype(np.int64)
                window = np.concatenate([mix(gram_codes(codes(a, b), rule.length)) for a, b in zip(begin[cut].tolist(), end[cut].tolist(), strict=True)])
                source, step = np.repeat(cut, m), spread(m)
                place = lo[source] + step
                order = np.lexsort((place, doc[source], window))
                new = np.concatenate([[True], window[order][1:] != window[order][:-1]])
                leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                gone = (doc[source[order]] != doc[source[leader]]) | ((place[order] != place[leader]) if rule.same_document else False)
                keep, drop = order[~gone], order[gone]
                one = np.ones(len(order), np.int32)
                yield _content_rows(window[keep].view(np.int64), doc[source[keep]], place[keep], one[: len(keep)], [stored(a, a + rule.length) for a in (begin[source[keep]] + step[keep]).tolist()])
                yield _content_rows(window[drop].view(np.int64), doc[source[drop]], place[drop], one[: len(drop)], [None] * len(drop))

    return rows.mapInArrow(run, schema)


def _content_rows(key, doc, lo, n, codes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(lo), pa.array(n, pa.int32()), pa.array(codes, pa.binary())], ["key", "doc_id", "lo", "n", "codes"])


def resolve(open_contents: DataFrame, rule: Rule) -> DataFrame:
    """``(doc_id, lo, n)`` of the windows in open runs that occur earlier, from their elements.

    Sorted by (key, document, place), a window's first row is its first occurrence, so the
    state between batches is the distinct windows of the last key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = (none, none.view(np.uint64), none, none)  # key, window, document, place
        for batch in batches:
            known = column(batch, "codes").is_null().to_numpy(zero_copy_only=False)
            spans = [tuple(column(batch, c).to_numpy()[known].astype(np.int64) for c in ("doc_id", "lo", "n"))]
            rows = batch.filter(pa.array(~known))
            if rows.num_rows:
                key, doc, lo, n = (column(rows, c).to_numpy().astype(np.int64) for c in ("key", "doc_id", "lo", "n"))
                code = decoded(rule, column(rows, "codes").to_pylist())
                size = n + rule.length - 1
                begin = np.cumsum(size) - size
                window = mix(gram_codes(code, rule.length))[np.repeat(begin, n) + spread(n)]
                new = (np.repeat(key, n), window, np.repeat(doc, n), np.repeat(lo, n) + spread(n))
                key, window, doc, lo = (np.concatenate(x) for x in zip(held, new, strict=True))
                order = np.lexsort((lo, doc, window, key))
                k, w, d, p = key[order], window[order], doc[order], lo[order]
                lead = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])
                leader = np.maximum.accumulate(np.where(lead, np.arange(len(k)), 0))
                gone = (d != d[leader]) | ((p != p[leader]) if rule.same_document else False)
                spans.append((d[gone], p[gone], np.ones(int(gone.sum()), np.int64)))
                last = lead & (k == key[-1])
                held = (k[last], w[last], d[last], p[last])
            doc, lo, n = (np.concatenate(x) for x in zip(*spans, strict=True))
            order = np.lexsort((lo, doc))
            doc, lo, n = cut_spans(*merge_spans(doc[order], lo[order], n[order]))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo), pa.array(n, pa.int32())], ["doc_id", "lo", "n"])

    return open_contents.repartition("key").sortWithinPartitions("key", "doc_id", "lo").mapInArrow(run, SPAN_SCHEMA)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` and ``spans``: the ranges of its repeated
    windows, null if none.  A range is one number, ``lo << 16 | n``, a quarter of what a struct
    would move.

    Texts are dealt by ``doc_id`` here as in :func:`contents`, from an equal plan if ``docs`` has
    no other columns, so Spark then shuffles them once.  Rows without id take no part."""
    one = F.shiftleft(F.col("lo"), 16).bitwiseOR(F.col("n").cast("long"))
    name = "spans"
    while name in docs.columns:
        name += "_"
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(one).alias(name))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    joined = docs.filter(F.col("doc_id").isNotNull()).join(per_doc, "doc_id", "left")
    nameless = docs.filter(F.col("doc_id").isNull()).select(row, "text", F.lit(None).cast("array<bigint>").alias("spans"))
    return joined.select(row, "text", F.col(name).alias("spans")).unionAll(nameless)


def covered(spans, length: int, size: int) -> np.ndarray:
    """Mask of the elements covered by windows that start in the ranges."""
    edge = np.zeros(size + 1, np.int64)
    spans = np.array(spans, np.int64)
    lo = np.minimum(spans >> 16, size)
    hi = np.minimum((spans >> 16) + (spans & MOST_WINDOWS) + length - 1, size)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:-1]) > 0
