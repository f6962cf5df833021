"""Tokenize whole texts through their distinct chunks (helper of the tokenizing operators).

A chunk runs from one safe cut to the next.  A cut is safe before a single space that has
no white space on either side: no pre-tokenizer used here ever matches across it, so the
tokens of a text are those of its chunks, one after the other.  Arrow splits and
dictionary-encodes the chunks of a slice of texts; only distinct chunks reach Python, and a
bounded two-generation cache keeps the frequent ones for the life of the worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from feedlake.llm.arrow_text import SLICE_BYTES, spread

SAFE_CUT = regex.compile(r"(?<!\s) (?!\s)")
#: Empty, or white space at either end (what ``\s`` and ``str.isspace`` know together).
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD_EDGE = f"^$|^[{SPACES}]|[{SPACES}]$"
CACHE_ENTRIES = 200_000


class TwoGenerations:
    """Mapping of bounded size: when the young half is full it becomes the old one; a hit in
    the old half moves the entry back to the young one."""

    def __init__(self, make: Callable[[list[str]], list], entries: int = CACHE_ENTRIES):
        self.make, self.entries = make, entries
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def many(self, keys: list[str]) -> list:
        young, old = self.young, self.old
        out = [young.get(k) for k in keys]
        missing = [i for i, v in enumerate(out) if v is None]
        fresh = []
        for i in missing:
            v = old.get(keys[i])
            if v is None:
                fresh.append(i)
            else:
                out[i] = young[keys[i]] = v
        if fresh:
            for i, v in zip(fresh, self.make([keys[i] for i in fresh]), strict=True):
                out[i] = young[keys[i]] = v
        if len(young) > self.entries:
            self.young, self.old = {}, young
        return out


class ChunkEncoder:
    """``encode(texts)`` gives (token ids of all texts in a row, number of tokens per text).

    ``make`` maps distinct chunks to the little-endian unsigned 32-bit ids of each.  With
    ``keep_space`` a chunk holds the space before it (byte-level vocabularies); without,
    spaces are dropped and every space is a safe cut.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], keep_space: bool = True, entries: int = CACHE_ENTRIES):
        self.cache, self.keep_space = TwoGenerations(make, entries), keep_space

    def _segments(self, text: str) -> list[str]:
        """One very long text, cut at safe cuts into parts of bounded size where it has any."""
        out, at = [], 0
        while len(text) - at > SLICE_BYTES:
            cut = SAFE_CUT.search(text, at + SLICE_BYTES // 2)
            if cut is None:
                break
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Per chunk its place among the distinct chunks, those chunks, chunks per text."""
        parts = pc.split_pattern(pc.fill_null(texts.cast(pa.large_utf8()), ""), " ")
        per_text = np.diff(parts.offsets.to_numpy())
        coded = parts.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not self.keep_space:
            return which, distinct, per_text
        odd = pc.match_substring_regex(coded.dictionary, ODD_EDGE).to_numpy(zero_copy_only=False)
        first = np.cumsum(per_text) - per_text
        # A text whose pieces begin or end with white space is cut by the pattern; the rest
        # differ from the pieces only in the first chunk, which has no space before it.
        bad = np.flatnonzero(np.logical_or.reduceat(odd[which], first)) if len(which) else np.zeros(0, np.int64)
        whole = {int(i): SAFE_CUT.split(texts[int(i)].as_py() or "") for i in bad}
        chunks = [" " + w for w in distinct]
        table: dict[str, int] = {}

        def place(chunk: str) -> int:
            if chunk not in table:
                table[chunk] = len(chunks)
                chunks.append(chunk)
            return table[chunk]

        heads = np.fromiter((place(distinct[w]) for w in which[first]), np.int64, len(first))
        which[first] = heads
        if whole:
            pieces, at = [], 0
            per_text = per_text.copy()
            for i, cut in whole.items():
                pieces.append(which[at : first[i]])
                pieces.append(np.array([place(c if j == 0 else " " + c) for j, c in enumerate(cut)], np.int64))
                at = first[i] + per_text[i]
                per_text[i] = len(cut)
            which = np.concatenate([*pieces, which[at:]])
        held = np.zeros(len(chunks), bool)
        held[which] = True
        return (np.cumsum(held) - 1)[which], [chunks[i] for i in np.flatnonzero(held).tolist()], per_text

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(texts) == 1 and texts.nbytes > 2 * SLICE_BYTES:
            parts = [self.encode(pa.array([p]))[0] for p in self._segments(texts[0].as_py())]
            ids = np.concatenate(parts)
            return ids, np.array([len(ids)])
        which, distinct, per_text = self._chunks(texts)
        packed = self.cache.many(distinct)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        flat = np.frombuffer(b"".join(packed), dtype="<u4")
        begin = np.cumsum(size) - size
        length = size[which]
        ids = flat[np.repeat(begin[which], length) + spread(length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(ends)

    def total(self, texts: pa.Array) -> np.ndarray:
        """Per text, the sum of what ``make`` gives for its chunks, here a number each."""
        if not len(texts):
            return np.zeros(0, np.int64)
        which, distinct, per_text = self._chunks(texts)
        value = np.array(self.cache.many(distinct), dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(value[which])])[np.concatenate([[0], np.cumsum(per_text)])]
        return np.diff(ends)
