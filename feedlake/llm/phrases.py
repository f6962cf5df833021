"""Phrase collocation mining by set-oriented relations (SETM).

An occurrence relation ``Rk`` holds a row ``(block, place, code)`` for every frequent ``k``-word sequence
of the corpus.  ``code`` is a hash of the language and the words; consecutive words of a piece have
consecutive places, and a piece is followed by a gap, so "same piece, next position" is "same block, next
place".  Each relation is written to the shared folder, sorted by block and place, with a block's rows
packed into one row, so that no task reads half a piece.  A packed row holds the words that its sequences cover, each
once and as its number in the order of falling frequency, and marks where a sequence begins; codes are formed from the
words where they are needed.  So a relation costs one or two bytes a word, however long and however many its sequences.
The ``most`` most frequent words have numbers, in a broadcast; other frequent ones stand with their codes.  One level:

1. merge-join: a row of ``Rk`` and the row of the next place make a longer row (for the first level, every
   word of the texts is one);
2. group-count: each task counts its own codes, cut to their first ``SHORT_BITS`` bits, and deals them by code to
   buckets, whose number grows with the relation; Spark shuffles the buckets, as steps from code to code, and a
   bucket of bounded size is added up at a time.  A short code counts at least as often as each of its codes, so those
   that occur ``least`` times or more miss no frequent code.  They are kept as a Bloom filter, bucket by bucket, of at
   most ``FILTER_BYTES``.  Words are dealt as texts, which names the frequent ones;
3. semi-join: each task gets the filter, and the longer rows that pass it are written as ``Rk+1``.  A rare code among
   them does no harm: whatever holds a rare sequence is rare.  The same rows are counted exactly: each task counts its
   own, deals them to buckets as the numbers of their words, and ``Ck+1`` holds the codes whose sum is ``least`` or more.

The longer rows are formed to be counted, to be written and to be counted exactly, because most of them are rare
and are never stored; the longest are not written, as nothing is joined to them.
The count tables carry the phrase and the counts of its
beginnings and ends, handed on from the shorter phrases, so the scores need no look at the corpus.
A phrase lies inside a longer candidate only if it lies inside one that is a single word longer and
at least as frequent, so dropping compares neighbouring levels.

A text is lower-cased (A-Z only), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``.
Null and empty texts have no words; a null language is ``und``; every row is a document, so repeated rows and ids count
as often as they occur, and null ids are like others; columns besides text and language are not read.  No documents or
no candidates: an empty result.  Equal scores are ordered by frequency, then by the UTF-8 bytes of the phrase.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import MULT, column, mix, spread, text_bytes, text_slices, words
from feedlake.session import scratch_path

BLOCK_BYTES = 1 << 17
MOST_DISTINCT = 100_000
BUCKET_CODES, WORD_BYTES = 500_000, 6
SHORT_BITS = 44
#: Words with a number, in a broadcast of 12 bytes each.
MOST_BROADCAST = 1_000_000
#: A filter has so many bits a code, and bytes at most; above that more rare codes pass.
FILTER_BITS, PROBES, FILTER_BYTES = 12, 3, 24 << 20
_SEEDS = np.arange(1, PROBES + 1, dtype=np.uint64) * MULT
CUT_SCALE = 2_000_000
COVER_PERCENT = 80

_TEXT = np.arange(256, dtype=np.uint8)
_TEXT[ord("A") : ord("Z") + 1] += 32
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_TEXT[_PIECE_END] = 0x0A

RELATION = "block long, place binary, codes binary, code long, head long, tail long, times long"
SCHEMA = pa.schema([("block", pa.int64()), ("place", pa.binary()), ("codes", pa.binary()), ("code", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("times", pa.int64())])


def _slices_of(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = flat[np.repeat(start, size) + spread(size)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _language_codes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    known = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    return known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)


def _tallied(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, first row of each, sum of ``times`` of each)."""
    order = np.argsort(code, kind="stable")
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), np.diff(code[order]) != 0]))
    return code[order][new], order[new], np.add.reduceat(times[order], new) if len(new) else times[:0]


class Tally:
    """Counts of codes with further columns that depend on the code, handed on when many."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray, list[pa.Array]]] = []

    def add(self, code: np.ndarray, times: np.ndarray, more: list[pa.Array]) -> None:
        self.held.append((code, times, more))

    def _one(self) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        code, times = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        distinct, at, total = _tallied(code, times)
        columns = [pa.concat_arrays(list(parts)) for parts in zip(*(h[2] for h in self.held), strict=True)]
        return distinct, total, [c.take(pa.array(at)) for c in columns]

    def full(self) -> bool:
        """Whether many distinct codes are held; adds equal ones up first."""
        if sum(len(h[0]) for h in self.held) <= 2 * MOST_DISTINCT:
            return False
        self.held = [self._one()]
        return len(self.held[0][0]) > MOST_DISTINCT

    def rows(self) -> Iterator[tuple[pa.Array, pa.Array, list[pa.Array]]]:
        """The counts so far: (codes, times, further columns)."""
        if self.held:
            code, times, more = self._one()
            yield pa.array(code.view(np.int64)), pa.array(times), more
            self.held = []


def _freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; what Arrow keeps of a used one is given back to the system."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def _word_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Per block of text: (bytes, starts and ends of words, codes, places, language of each word)."""
    for batch in text_slices(_freeing(batches), limit=BLOCK_BYTES):
        raw, offsets = text_bytes(column(batch, "text"))
        flat = _TEXT[raw]
        found = words(flat, offsets)
        if not len(found.code):
            continue
        owner = np.repeat(np.arange(batch.num_rows), np.diff(found.first))
        langs = column(batch, "lang")
        code = mix(found.code ^ _language_codes(langs)[owner])
        cuts = np.concatenate([[0], np.cumsum(flat == 0x0A)])
        gap = (cuts[found.start[1:]] > cuts[found.end[:-1]]) | (owner[1:] != owner[:-1])
        yield flat, np.stack([found.start, found.end]), code, np.concatenate([[0], np.cumsum(1 + gap)]), langs.take(pa.array(owner))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))


def _planes(numbers: np.ndarray) -> bytes:
    """How many bytes the largest number needs, the lowest bytes of the numbers, then the next ones: equal bytes stand
    together and cost little to send."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _of_planes(cell: pa.Scalar) -> np.ndarray:
    data = np.frombuffer(cell.as_buffer(), np.uint8)
    planes = data[1:].reshape(int(data[0]), -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values that stand together."""
    cuts = [*(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [*zip([0, *cuts[:-1]], cuts, strict=True)] if len(values) else []


def _bucket(short: np.ndarray, buckets: int) -> np.ndarray:
    return (short * np.uint64(buckets) >> np.uint64(SHORT_BITS)).astype(np.int64)


def _dealt(slices: Iterator[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """``(bucket, codes, times)``: counts of the short codes, dealt by range to buckets; a cell holds their ascending
    steps."""
    tally = Tally()

    def out() -> Iterator[pa.RecordBatch]:
        for code, times, _ in tally.rows():
            code, times = code.to_numpy().view(np.uint64), times.to_numpy()
            bucket = _bucket(code, buckets)
            runs = _runs(bucket)
            cells = [[_planes(x) for x in (np.diff(code[i:j], prepend=np.uint64(0)), times[i:j])] for i, j in runs]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[[i for i, _ in runs]]), *(pa.array([c[k] for c in cells], pa.binary()) for k in (0, 1))], ["bucket", "codes", "times"])

    for code in slices:
        distinct, _, times = _tallied(_short(code), np.ones(len(code), np.int64))
        tally.add(distinct, times, [])
        if tally.full():
            yield from out()
    yield from out()


def _probe(short: np.ndarray, size: np.ndarray | np.uint64, i: int) -> np.ndarray:
    """The ``i``-th place of codes in segments of so many bits."""
    return ((mix(short + _SEEDS[i]) >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64)


def _segment(short: np.ndarray, most_bits: int) -> bytes:
    """The bits of some codes of one bucket."""
    bits = np.zeros(-(-max(64, min(most_bits, FILTER_BITS * len(short))) // 8) * 8, bool)
    for i in range(PROBES):
        bits[_probe(short, np.uint64(len(bits)), i)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Bloom filter of short codes in segments, one a bucket of codes."""

    def __init__(self, segments: pa.Table, buckets: int):
        segments = segments.sort_by("bucket")
        cells = segments["bits"].to_pylist()
        self.buckets, self.size, self.first = buckets, np.zeros(buckets, np.uint64), np.zeros(buckets, np.int64)
        self.size[segments["bucket"].to_numpy()] = size = np.array([8 * len(c) for c in cells], np.uint64)
        self.first[segments["bucket"].to_numpy()] = np.cumsum(size, dtype=np.int64) - size.astype(np.int64)
        self.bits = np.frombuffer(b"".join(cells), np.uint8)

    def places(self, short: np.ndarray) -> np.ndarray:
        """Places of the codes that pass: all that were put in, and few others."""
        bucket = _bucket(short, self.buckets)
        at = np.flatnonzero(self.size[bucket] > 0)
        for i in range(PROBES):
            of = bucket[at]
            place = self.first[of] + _probe(short[at], self.size[of], i)
            at = at[(self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
        return at


def _counted(cells: DataFrame, least: int, buckets: int) -> Filter:
    """Of the ``short`` codes that occur ``least`` times or more: a task adds up bucket by bucket."""
    most_bits = 8 * FILTER_BYTES // buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, last = Tally(), None
        for batch in _freeing(batches):
            for bucket, codes, times in zip(*(column(batch, c) for c in ("bucket", "codes", "times")), strict=True):
                if last is not None and bucket.as_py() != last:
                    yield from frequent(last, tally)
                last = bucket.as_py()
                tally.add(np.cumsum(_of_planes(codes), dtype=np.uint64), _of_planes(times).view(np.int64), [])
        yield from frequent(last, tally)

    def frequent(bucket: int, tally: Tally) -> Iterator[pa.RecordBatch]:
        for code, times, _ in tally.rows():
            kept = code.to_numpy().view(np.uint64)[times.to_numpy() >= least]
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([_segment(kept, most_bits)])], ["bucket", "bits"])

    segments = cells.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, bits binary")
    return Filter(segments.toArrow(), buckets)


CELLS = "bucket long, codes binary, times binary"
WORD_CELLS = "bucket long, langs array<string>, sizes array<int>, words binary, times binary"


def _short(code: np.ndarray) -> np.ndarray:
    return code >> np.uint64(64 - SHORT_BITS)


def buckets_for(codes: int) -> int:
    """So many that a bucket has at most about ``BUCKET_CODES`` codes."""
    return 1 + codes // BUCKET_CODES


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """``(code, lang, word, a)``: every frequent word, and without code and word the numbers ``a`` of words of a
    language, in parts.  A word is dealt as its text and not as its code, so that frequent ones have names."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = buckets_for(size // WORD_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for flat, span, code, _, langs in _word_slices(batches):
            distinct, at, times = _tallied(code, np.ones(len(code), np.int64))
            tally.add(distinct, times, [langs.take(pa.array(at)), _slices_of(flat, *span[:, at])])
            if tally.full():
                yield from cells(tally)
        yield from cells(tally)

    def cells(tally: Tally) -> Iterator[pa.RecordBatch]:
        for code, times, (langs, found) in tally.rows():
            code, times, coded = code.to_numpy().view(np.uint64), times.to_numpy(), langs.dictionary_encode()
            bucket, lang = (code % np.uint64(buckets)).astype(np.int64), coded.indices.to_numpy()
            order = np.lexsort((code, lang, bucket))
            bucket, lang, runs = bucket[order], lang[order], _runs(bucket[order])
            flat, offsets = text_bytes(pc.binary_join_element_wise(found.take(pa.array(order)), "", " "))
            parts = _runs(bucket * len(coded.dictionary) + lang)
            first = np.array([a for a, _ in parts], np.int64)
            of = pa.array(np.searchsorted(first, [*(a for a, _ in runs), len(order)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[[a for a, _ in runs]]),
                    pa.ListArray.from_arrays(of, coded.dictionary.take(pa.array(lang[first]))),
                    pa.ListArray.from_arrays(of, pa.array([b - a for a, b in parts], pa.int32())),
                    pa.array([flat[offsets[a] : offsets[b]].tobytes() for a, b in runs], pa.binary()),
                    pa.array([_planes(times[order[a:b]]) for a, b in runs], pa.binary()),
                ],
                ["bucket", "langs", "sizes", "words", "times"],
            )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals, last = [], Counter(), None
        for batch in _freeing(batches):
            for bucket, *cell in zip(*(column(batch, c) for c in ("bucket", "langs", "sizes", "words", "times")), strict=True):
                if last is not None and bucket.as_py() != last:
                    yield from frequent(held, totals)
                    held = []
                last = bucket.as_py()
                held.append((cell[0].as_py(), cell[1].as_py(), cell[2].as_py(), _of_planes(cell[3]).view(np.int64)))
        if held:
            yield from frequent(held, totals)
        none = pa.nulls(len(totals))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(list(totals), pa.string()), none.cast(pa.string()), pa.array(list(totals.values()), pa.int64())], names)

    def frequent(held: list[tuple], totals: Counter) -> Iterator[pa.RecordBatch]:
        """Of one bucket, of bounded size."""
        flat = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
        coded = pa.array([x for h in held for x in h[0]], pa.string()).dictionary_encode()
        lang = np.repeat(coded.indices.to_numpy(), [x for h in held for x in h[1]])
        n = np.concatenate([h[3] for h in held])
        known = coded.dictionary.to_pylist()
        totals.update(dict(zip(known, np.bincount(lang, n, len(known)).astype(np.int64).tolist(), strict=True)))
        found = words(flat, np.array([0, len(flat)]))
        code, at, a = _tallied(mix(found.code ^ _language_codes(coded.dictionary)[lang]), n)
        code, at, a = code[a >= least], at[a >= least], a[a >= least]
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), coded.dictionary.take(pa.array(lang[at])), _slices_of(flat, found.start[at], found.end[at]), pa.array(a)], names)

    names = ["code", "lang", "word", "a"]
    return _texts(docs).mapInArrow(deal, WORD_CELLS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, "code long, lang string, word string, a long")


def ranked_codes(words_of: DataFrame, most: int) -> np.ndarray:
    """The codes of the most frequent words, by falling frequency; at most ``most``."""
    return words_of.orderBy(F.desc("a"), "code").limit(most).select("code").toArrow()["code"].to_numpy().view(np.uint64)


def word_filter(words_of: DataFrame, n: int) -> Filter:
    """Of the ``n`` frequent words."""
    buckets = buckets_for(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt((column(batch, "code").to_numpy().view(np.uint64) for batch in batches), buckets)

    return _counted(words_of.select("code").mapInArrow(run, CELLS), 1, buckets)


def _pack(block: int, place: np.ndarray, number: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block of a relation: the steps from word to word, with a bit for those that begin a sequence, the numbers of the
    words, and in ``times`` how many sequences there are."""
    if start.any():
        steps = np.diff(place, prepend=0).astype(np.uint64) << np.uint64(1) | start.astype(np.uint64)
        none = [pa.nulls(1, pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_planes(steps)]), pa.array([_planes(number)]), *none, pa.array([np.count_nonzero(start)], pa.int64())], schema=SCHEMA)


def word_relation(docs: DataFrame, ranked: np.ndarray, rest: Filter | None) -> DataFrame:
    """``R1``: the occurrences of frequent words, those of ``ranked`` as their places there, those of ``rest`` as codes."""
    order = np.argsort(ranked)
    shared = docs.sparkSession.sparkContext.broadcast((ranked[order], order.astype(np.int32), rest))  # at most ``most`` codes, ``FILTER_BYTES``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        known, number_of, others = shared.value
        for _, _, code, place, _ in _word_slices(batches):
            block += 1
            keep, number = np.zeros(len(code), bool), code.copy()
            if len(known):
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                keep = known[at] == code
                number[keep] = number_of[at[keep]]
            if others is not None:
                more = np.flatnonzero(~keep)
                keep[more[others.places(_short(code[more]))]] = True
            yield from _pack(block, place[keep], number[keep], np.ones(np.count_nonzero(keep), bool))

    return _texts(docs).mapInArrow(run, RELATION)


def _codes(number: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """The codes of words from their numbers."""
    return np.where(number < len(ranked), ranked[np.minimum(number, np.uint64(len(ranked) - 1))], number) if len(ranked) else number


def _of_parts(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The codes of sequences whose first words but one have the code ``head`` and the last ones ``tail``."""
    return mix(mix(head) * MULT + tail)


def _joined(batches: Iterator[pa.RecordBatch], ranked: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Merge-join of the packed blocks of ``Rk`` with themselves by the next place: (block, places and numbers of
    the words, which of them begin a longer sequence, codes of these)."""
    for batch in _freeing(batches):
        for block, steps, numbers in zip(*(column(batch, c) for c in ("block", "place", "codes")), strict=True):
            steps, number = _of_planes(steps), _of_planes(numbers)
            place, start = np.cumsum(steps >> np.uint64(1), dtype=np.int64), (steps & np.uint64(1)).astype(bool)
            at = np.flatnonzero(start[1:] & start[:-1] & (place[1:] == place[:-1] + 1))
            if len(at):
                code = _codes(number, ranked)
                for _ in range(k - 1):
                    code = _of_parts(code[:-1], code[1:])
                yield block.as_py(), place, number, at, _of_parts(code[at], code[at + 1])


def longer_filter(relation: DataFrame, ranked: Broadcast, k: int, n: int, least: int) -> Filter:
    """Of the first bits of the codes of all frequent sequences that are a word longer than the ``n`` of ``Rk``, and
    perhaps of a few others."""
    buckets = buckets_for(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt((code for *_, code in _joined(batches, ranked.value, k)), buckets)

    return _counted(relation.mapInArrow(run, CELLS), least, buckets)


def longer_relation(relation: DataFrame, ranked: Broadcast, kept: Broadcast, k: int) -> DataFrame:
    """``Rk+1``: the occurrences of the sequences, a word longer than those of ``Rk``, that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, place, number, at, code in _joined(batches, ranked.value, k):
            start = np.zeros(len(place), bool)
            start[at[kept.value.places(_short(code))]] = True
            cover = start.copy()
            for j in range(1, k + 1):
                cover[j:] |= start[:-j]
            yield from _pack(block, place[cover], number[cover], start[cover])

    return relation.mapInArrow(run, RELATION)


def longer_counts(relation: DataFrame, ranked: Broadcast, kept: Broadcast, k: int, n: int, least: int) -> DataFrame:
    """``(code, head, tail, times)`` of the frequent ones among these sequences, with their exact counts.  They are dealt
    to buckets as the numbers of their words: steps of the first, which ascends, and the others."""
    buckets = buckets_for(n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for _, _, number, at, code in _joined(batches, ranked.value, k):
            some = kept.value.places(_short(code))
            distinct, first, times = _tallied(code[some], np.ones(len(some), np.int64))
            tally.add(distinct, times, [pa.array(number[at[some[first]] + j]) for j in range(k + 1)])
            if tally.full():
                yield from cells(tally)
        yield from cells(tally)

    def cells(tally: Tally) -> Iterator[pa.RecordBatch]:
        for code, times, numbers in tally.rows():
            bucket, number = _bucket(_short(code.to_numpy().view(np.uint64)), buckets), np.stack([x.to_numpy() for x in numbers])
            order = np.lexsort((*number[::-1], bucket))
            bucket, number, times = bucket[order], number[:, order], times.to_numpy()[order]
            runs = _runs(bucket)
            found = [np.concatenate([np.diff(number[0, a:b], prepend=np.uint64(0)), *number[1:, a:b]]) for a, b in runs]
            columns = [[_planes(x) for x in found], [_planes(times[a:b]) for a, b in runs]]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[[a for a, _ in runs]]), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "codes", "times"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in _freeing(batches):
            for bucket, numbers, times in zip(*(column(batch, c) for c in ("bucket", "codes", "times")), strict=True):
                if last is not None and bucket.as_py() != last:
                    yield from frequent(held)
                    held = []
                last = bucket.as_py()
                number = _of_planes(numbers).reshape(k + 1, -1)
                held.append((np.concatenate([np.cumsum(number[:1], axis=1, dtype=np.uint64), number[1:]]), _of_planes(times).view(np.int64)))
        if held:
            yield from frequent(held)

    def frequent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Of one bucket, of bounded size."""
        code = _codes(np.concatenate([x for x, _ in held], axis=1), ranked.value)
        while len(code) > 2:
            code = _of_parts(code[:-1], code[1:])
        distinct, at, times = _tallied(_of_parts(*code), np.concatenate([x for _, x in held]))
        often = times >= least
        at, none = at[often], [pa.nulls(np.count_nonzero(often), SCHEMA.field(i).type) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*none, *(pa.array(x.view(np.int64)) for x in (distinct[often], code[0, at], code[1, at])), pa.array(times[often])], schema=SCHEMA)

    return relation.mapInArrow(deal, CELLS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, RELATION)


def _written(df: DataFrame, name: str) -> DataFrame:
    """The table written and read again.  A row of a relation is a block of some hundred KB; a page, which is compressed
    and read as one, ends with the row that fills it, and not with the hundredth at the earliest."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.page.size.row.check.min", 1).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_level(frequent: DataFrame) -> DataFrame:
    """``C1``: frequent words ``(code, a, lang, phrase, last, heads, tails)``."""
    return frequent.select("code", "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("a").alias("heads"), F.array("a").alias("tails"))


def next_level(relation: DataFrame, shorter: DataFrame, least: int) -> DataFrame:
    """``Ck+1``, counted exactly, from its relation and ``Ck``.  ``heads`` and ``tails`` hold the counts
    of the first and last 1, 2, ... words; ``head`` and ``tail`` are the codes of the parts in ``Ck``."""
    counts = relation.filter(F.col("block").isNull()).groupBy("code").agg(F.sum("times").alias("a"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    front = shorter.select(F.col("code").alias("head"), "lang", F.col("phrase").alias("front"), F.col("heads").alias("front_heads"))
    back = shorter.select(F.col("code").alias("tail"), "last", F.col("tails").alias("back_tails"))
    return counts.filter(F.col("a") >= least).join(front, "head").join(back, "tail").select(
        "code", "a", "lang", F.concat_ws(" ", "front", "last").alias("phrase"), "last",
        F.concat("front_heads", F.array("a")).alias("heads"), F.concat("back_tails", F.array("a")).alias("tails"), "head", "tail",
    )


def scored(counts: DataFrame, length: int) -> DataFrame:
    """Candidates of ``length`` words with their lowest-scoring cut.  Products may pass 64 bits, so they
    are decimals; ``div`` of these is exact."""
    cuts = []
    for k in range(1, length):
        left, right = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        score = F.expr(f"({CUT_SCALE} * cast(a as decimal(20,0))) div (cast(heads[{k - 1}] as decimal(20,0)) + cast(tails[{length - k - 1}] as decimal(20,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    lowest = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return counts.withColumn("cut", lowest).select("code", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def phrases(docs: DataFrame, least: int = 30, longest: int = 4, first: int = 2000, most: int = MOST_BROADCAST) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``first`` phrases of each language."""
    counted = _written(word_counts(docs, least), "words")
    words_of = counted.filter(F.col("code").isNotNull())
    total = counted.filter(F.col("code").isNull()).groupBy("lang").agg(F.sum("a").alias("n"))
    counts = [first_level(words_of)]
    known, context = ranked_codes(words_of, most), docs.sparkSession.sparkContext
    frequent = words_of.count()
    relation = _written(word_relation(docs, known, word_filter(words_of, frequent) if frequent > len(known) else None), "occurrences")
    ranked = context.broadcast(known)  # at most ``most``
    for k in range(1, longest):
        n = relation.agg(F.sum("times").alias("n")).first()["n"] or 0
        kept = context.broadcast(longer_filter(relation, ranked, k, n, least))  # at most ``FILTER_BYTES``
        counts.append(_written(next_level(longer_counts(relation, ranked, kept, k, n, least), counts[-1], least), "level"))
        if k + 1 < longest:
            relation = _written(longer_relation(relation, ranked, kept, k), "occurrences")
    found = None
    for length in range(2, longest + 1):
        level = scored(counts[length - 1], length)
        if length < longest:
            longer = counts[length]
            cover = longer.select(F.col("head").alias("code"), F.col("a").alias("cover")).unionAll(longer.select("tail", "a")).groupBy("code").agg(F.max("cover").alias("cover"))
            keep = F.col("cover").isNull() | (100 * F.col("cover").cast("decimal(20,0)") < COVER_PERCENT * F.col("a").cast("decimal(20,0)"))
            level = level.join(cover, "code", "left").filter(keep).drop("cover")
        found = level if found is None else found.unionAll(level)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
