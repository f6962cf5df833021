"""Whole texts as numpy arrays, straight from Arrow buffers (helpers of the operators here).

A batch of texts is one ``uint8`` array of UTF-8 bytes plus offsets, so that words, lines and
windows of millions of characters are found and hashed without a Python object per word.
Null texts count as empty ones.  All 64-bit hashes wrap modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 20
U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * MULT)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


_WORKER: dict[str, object] = {}


def worker_state(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks (vocabularies, caches), for one operator at a
    time: workers are reused by later stages, and the memory of an earlier one is given back."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets of each text in them)."""
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = offsets[0] if len(offsets) else 0
    return flat[base : offsets[-1] if len(offsets) else 0], offsets - base


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch: byte ranges, hash, and per text the range
    ``first[i]:first[i+1]`` of its words."""

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray


def _segments(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of bounded size that no word crosses: cut at text starts or white space."""
    at, n = 0, len(flat)
    while at < n:
        to = min(n, at + SEGMENT_BYTES)
        if to < n:
            text = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
            if text > at:
                to = text
            else:
                space = np.flatnonzero(_SPACE[flat[at:to]])
                while not len(space) and to < n:  # one word longer than a segment
                    to = min(n, to + SEGMENT_BYTES)
                    space = np.flatnonzero(_SPACE[flat[at:to]])
                if len(space) and to < n:
                    to = at + int(space[-1]) + 1
                following = int(offsets[np.searchsorted(offsets, at, side="right")]) if offsets[-1] > at else n
                to = min(to, following) if following > at else to
        yield at, to
        at = to


def words(flat: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    starts, ends, codes = [], [], []
    edge = np.zeros(0, bool)
    for a, b in _segments(flat, offsets):
        part = flat[a:b]
        if lower:
            part = _LOWER[part]
        ink = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        cuts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a
        edge[cuts] = True
        edge[0] = edge[-1] = True
        before = np.empty(len(part), dtype=bool)
        before[0] = True
        np.logical_not(ink[:-1], out=before[1:])
        s = np.flatnonzero(ink & (before | edge[:-1]))
        after = np.empty(len(part), dtype=bool)
        after[-1] = True
        np.logical_not(ink[1:], out=after[:-1])
        e = np.flatnonzero(ink & (after | edge[1:])) + 1
        if not len(s):
            continue
        length = e - s
        power = np.cumprod(np.concatenate([[U64(1)], np.full(int(length.max()), MULT, U64)]))
        place = np.arange(len(part))
        gap = np.diff(np.concatenate([s, [len(part)]]))
        place[s[0] :] -= np.repeat(s, gap)
        value = BYTE_CODE[part]
        value[~ink] = 0
        place[~ink] = 0
        value[s[0] :] *= power[place[s[0] :]]
        codes.append(mix(np.add.reduceat(value, s) + length.astype(U64) * U64(0xD6E8FEB86659FD93)))
        starts.append(s + a)
        ends.append(e + a)
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    return Words(
        start,
        np.concatenate(ends) if ends else empty,
        np.concatenate(codes) if codes else np.zeros(0, U64),
        np.searchsorted(start, offsets),
    )


def gram_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive elements, by doubling: no tables, O(log k) passes."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done = None, 0
    block, size = code, 1  # block[i] covers elements i .. i + size - 1
    power = MULT  # MULT ** size
    shift = U64(1)  # MULT ** done
    rest = k
    while rest:
        if rest & 1:
            part = block[done : done + n]
            with np.errstate(over="ignore"):
                out = part.copy() if out is None else out + part * shift
                shift = U64(int(shift) * int(power) & 0xFFFFFFFFFFFFFFFF)
            done += size
        rest >>= 1
        if rest:
            with np.errstate(over="ignore"):
                block = block[: len(block) - size] + block[size:] * power
                power = U64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
            size *= 2
    return out


def sliding_argmin(value: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every ``width`` consecutive values."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, where, size = value, np.arange(len(value), dtype=np.int64), 1
    while size < width:
        step = min(size, width - size)
        m = len(best) - step
        right = best[step:] < best[:m]
        where = np.where(right, where[step:], where[:m])
        best = np.where(right, best[step:], best[:m])
        size += step
    return where[:n]


def within(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask over ``n - length + 1`` window starts: true where the window stays in one text.
    ``first`` holds the first element of each text and, last, the number of elements."""
    ok = np.ones(max(0, n - length + 1), dtype=bool)
    for cut in np.unique(first[1:-1]):
        ok[max(0, cut - length + 1) : cut] = False
    return ok


def spread(lengths: np.ndarray) -> np.ndarray:
    """0 .. length-1 for each length, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def as_long(code: np.ndarray) -> np.ndarray:
    return code.view(np.int64)
