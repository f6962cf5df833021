"""Best-fit packing of documents into sequences, after a dominance reduction.

Documents become pieces of at most ``capacity`` tokens.  How pieces of equal length are packed
does not depend on which document they come from, so the plan is made from the histogram of
lengths, at most ``capacity`` counts whatever the corpus:

1. Dominance (Martello and Toth): for the longest open length, a small set of lengths is fixed
   as a finished sequence when it provably dominates every other set that could share a
   sequence with it; the instance shrinks and the test starts again.
2. Best-fit decreasing for the rest, on counts: many equal sequences are filled at a time.

Pieces are then numbered within their length by a range partition on (length, document,
piece), so a length shared by a third of all pieces is dealt over many tasks, and each piece
finds its sequence and offset by its number.

Null and empty texts give one piece that holds the end id.  Repeated rows are packed each on
its own.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column, text_slices
from feedlake.llm.token_files import encoder
from feedlake.session import scratch_path

Group = tuple[tuple[tuple[int, int], ...], int]  # ((length, pieces of it in a sequence), ...), sequences


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the ids of each text and ``end_id``, cut
    only where they are longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            flat, n = encoder(tokenizer, end_of_word=True).encode(column(batch, "text"))
            rows, at = [], 0
            for i, m in enumerate(n.tolist()):
                ids = np.append(flat[at : at + m], np.uint32(end_id)).astype("<u4")
                at += m
                for piece, a in enumerate(range(0, len(ids), capacity)):
                    some = ids[a : a + capacity]
                    rows.append((i, piece, a, len(some), zlib.crc32(some.tobytes())))
            i, piece, a, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(i)), pa.array(piece.astype(np.int32)), pa.array(a), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def dominating_set(sizes: list[int], count: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """Lengths that, with the longest open length ``a``, dominate every sequence holding ``a``.

    ``sizes`` are the open lengths, ascending.  With ``room = capacity - a`` and ``b`` the
    longest length that fits in it (one copy of ``a`` set apart):

    - nothing fits: ``{a}`` alone;
    - ``b`` fills the room: ``{a, b}``, because whatever else shares a sequence with ``a``
      sums to at most ``b`` and can take its place;
    - no two lengths fit together, or every two that do sum to at most ``b``, and no three
      fit: ``{a, b}`` likewise;
    - at most two fit and in every such pair the shorter is at most ``c``, the longest that
      fits beside ``b``: ``{a, b, c}``.
    """
    a = sizes[-1]
    room = capacity - a
    left = {s: count[s] - (s == a) for s in sizes if s <= room and count[s] - (s == a) > 0}
    if not left:
        return (a,)
    small = sorted(left)
    b = small[-1]
    if b == room:
        return (a, b)
    least = [s for s in small[:3] for _ in range(min(3, left[s]))][:3]
    if len(least) < 2 or least[0] + least[1] > room:
        return (a, b)
    if len(least) == 3 and sum(least) <= room:
        return None
    best_pair, longest_second = 0, 0
    for i, y in enumerate(small):
        j = bisect.bisect_right(small, room - y) - 1
        if j < i or (j == i and left[y] < 2):
            continue
        best_pair = max(best_pair, y + small[j])
        longest_second = max(longest_second, y)
    if best_pair <= b:
        return (a, b)
    beside = [s for s in small if s <= room - b and left[s] - (s == b) > 0]
    if beside and longest_second <= beside[-1]:
        return (a, b, beside[-1])
    return None


def reduce_by_dominance(count: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """(finished sequences, counts of the rest).  A length that no set dominates is set aside
    and the test goes on with the next shorter one; exact fits are found for every length."""
    count = {s: n for s, n in count.items() if n > 0}
    done: list[Group] = []
    aside: dict[int, int] = {}
    while count:
        sizes = sorted(count)
        chosen = dominating_set(sizes, count, capacity)
        a = sizes[-1]
        if chosen is None or (aside and max(aside) + a <= capacity and len(chosen) < 2):
            aside[a] = count.pop(a)
            continue
        # A set is only provably dominating among all open pieces when none set aside would fit too.
        if aside and min(aside) <= capacity - a and sum(chosen) < capacity:
            aside[a] = count.pop(a)
            continue
        need: dict[int, int] = {}
        for s in chosen:
            need[s] = need.get(s, 0) + 1
        # Beyond exact fits the proof looks at which lengths are open, so it is renewed when one runs out.
        times = min(count[s] // k for s, k in need.items())
        done.append((tuple(sorted(need.items(), reverse=True)), times))
        for s, k in need.items():
            count[s] -= k * times
            if not count[s]:
                del count[s]
    return done, aside


def best_fit(count: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing on counts.  Open sequences are kept by the room left in them; a
    length goes to the least room that holds it, as often as it fits."""
    open_: dict[int, list[Group]] = {}
    rooms: list[int] = []
    for s in sorted((s for s, n in count.items() if n), reverse=True):
        n = count[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                content, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, content, bins = capacity, (), -(-n // (capacity // s))
            each = room // s
            full = min(bins, n // each)
            rest = n - full * each if full < bins else 0
            rest = min(rest, each - 1) if full < bins else 0
            for pieces, times in ((each, full), (rest, 1 if rest else 0), (0, bins - full - (1 if rest else 0))):
                if times:
                    left = room - pieces * s
                    if left not in open_:
                        open_[left] = []
                        bisect.insort(rooms, left)
                    open_[left].append(((*content, (s, pieces)) if pieces else content, times))
            n -= full * each + rest
    return [g for groups in open_.values() for g in groups]


def plan(count: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first number, first sequence, pieces in a sequence, offset)`` rows, ascending:
    the pieces of a length from ``first number`` on fill the sequences from ``first sequence``
    on, that many in each, from that offset."""
    done, rest = reduce_by_dominance(dict(count), capacity)
    rows, sequence, taken = [], 0, {}
    for content, times in [*done, *best_fit(rest, capacity)]:
        offset = 0
        for length, pieces in content:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, pieces, offset))
            taken[length] = first + pieces * times
            offset += length * pieces
        sequence += times
    return sorted(rows)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with ``doc_id``, ``piece`` and ``length``) plus ``sequence_id`` and
    ``offset``.  The numbered pieces are written once to the shared folder, because their
    ranges must not be dealt anew between counting and placing."""
    spark = pieces.sparkSession
    names = [f for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            length = column(batch, "length").to_numpy()
            if not len(length):
                continue
            begin = np.flatnonzero(np.concatenate([[True], length[1:] != length[:-1]]))
            run = np.diff(np.concatenate([begin, [len(length)]]))
            place = np.arange(len(length)) - np.repeat(begin, run)
            if length[0] == last:
                place[: run[0]] += seen
            last, seen = length[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), shard, np.int32)), pa.array(place)], [*batch.schema.names, "shard", "place"])

    # Range partitioning reads its input twice, so texts are tokenized into a table before.
    path = scratch_path(spark, "tokenized")
    pieces.write.parquet(path)
    pieces = spark.read.schema(pieces.schema).parquet(path)
    path = scratch_path(spark, "pieces")
    ordered = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    ordered.mapInArrow(number, f"{schema}, shard int, place long").write.parquet(path)
    numbered = spark.read.parquet(path)
    # A length lies in consecutive shards, so there are at most shards + capacity of these rows.
    runs = sorted(tuple(r) for r in numbered.groupBy("length", "shard").count().collect())
    base, count = {}, {}
    for length, shard, n in runs:
        base[length, shard] = count.get(length, 0)
        count[length] = count.get(length, 0) + n
    table = np.array(plan(count, capacity), np.int64).reshape(-1, 5)
    keys = np.array(sorted(base), np.int64).reshape(-1, 2)
    first = np.array([base[tuple(k)] for k in keys.tolist()], np.int64)
    span = np.int64(int(max(count.values(), default=0)) + 1)
    shards = np.int64(int(keys[:, 1].max()) + 1 if len(keys) else 1)
    shared = spark.sparkContext.broadcast((table, keys[:, 0] * shards + keys[:, 1], first))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, run_key, first = shared.value
        entry = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = column(batch, "length").to_numpy()
            at = np.searchsorted(run_key, length * shards + column(batch, "shard").to_numpy())
            number = column(batch, "place").to_numpy() + first[at]
            row = table[np.searchsorted(entry, length * span + number, side="right") - 1]
            ahead = number - row[:, 1]
            sequence, offset = row[:, 2] + ahead // row[:, 3], row[:, 4] + ahead % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(column(batch, f.name) for f in names), pa.array(sequence), pa.array(offset)], [*(f.name for f in names), "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), capacity)
