"""Byte-level BPE encoding and decoding by ranked merges over distinct words.

``encode_batches`` is the main path: each task folds the ranked merges over the byte arrays of
its *distinct* words only, all words of a batch at once in numpy, and texts are put together
from the cached words.  Decoding concatenates the byte piece of every id.  The results are
those of the public ``tiktoken`` library: the lowest rank first, the leftmost on ties, and any
two neighbours whose joined bytes are in the vocabulary may merge.

``encode_words_native`` is the same fold as Spark higher-order functions with a literal rank
map, over a table of distinct words.  It gives equal ids, but its interpreted lambdas cost far
more per word (figures in the README), so it serves tables of words and the tests.

Null and empty texts have no tokens.  Repeated rows are encoded each on its own; ids repeat.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column, mix, spread, text_slices, worker_state
from feedlake.llm.chunks import ChunkEncoder
from feedlake.llm.vocab import PATTERN, load_ranks

SHIFT = np.uint64(20)
NO_RANK = np.int64(1 << 40)
SEGMENT_TOKENS = 1 << 18


class RankFold:
    """Ranked merges over many byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        self._build(np.array(keys, np.uint64), np.array(values, np.int64))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open-addressing table of pair -> rank, four times larger than its content."""
        bits = int(4 * len(keys)).bit_length()
        self.down = np.uint64(64 - bits)
        self.key = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.value = np.full(1 << bits, NO_RANK)
        slot = mix(keys) >> self.down
        todo = np.arange(len(keys))
        while len(todo):
            free = self.key[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            at, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.key[at], self.value[at] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed)
            slot[todo] = (slot[todo] + np.uint64(1)) & np.uint64(len(self.key) - 1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.uint64) << SHIFT | b.astype(np.uint64)
        slot = (mix(want) >> self.down).astype(np.int64)
        found = self.key[slot]
        out = np.where(found == want, self.value[slot], NO_RANK)
        open_ = np.flatnonzero((found != want) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.key) - 1)
            found = self.key[slot[open_]]
            hit = found == want[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out

    def fold(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as packed little-endian unsigned 32-bit numbers."""
        out = [b""] * len(words)
        whole = [self.ranks.get(w) for w in words]
        open_ = np.array([i for i, (w, r) in enumerate(zip(words, whole, strict=True)) if r is None and w], np.int64)
        for i, r in enumerate(whole):
            if r is not None:
                out[i] = int(r).to_bytes(4, "little")
        length = np.array([len(words[i]) for i in open_], np.int64)
        token = self.byte_id[np.frombuffer(b"".join([words[i] for i in open_]), np.uint8)]
        word = np.repeat(open_, length)
        while len(token):
            rank = np.full(len(token), NO_RANK)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.pair_ranks(token[inside], token[inside + 1])
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.concatenate([begin, [len(word)]]))
            least = np.minimum.reduceat(rank, begin)
            done = np.repeat(least == NO_RANK, size)
            if done.any():
                packed = token[done].astype("<u4").tobytes()
                ended = np.flatnonzero(least == NO_RANK)
                to = np.cumsum(size[ended]) * 4
                for i, a, b in zip(word[begin[ended]].tolist(), (to - size[ended] * 4).tolist(), to.tolist(), strict=True):
                    out[i] = packed[a:b]
            hit = np.flatnonzero((rank == np.repeat(least, size)) & ~done)
            if not len(hit):
                break
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the leftmost of each word
            token[hit] = rank[hit]
            keep = ~done
            keep[hit + 1] = False
            token, word = token[keep], word[keep]
        return out

    def make(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: pattern matches are folded separately, each distinct one once."""
        parts = [[p.encode() for p in PATTERN.findall(c)] for c in chunks]
        words = list({p for c in parts for p in c})
        ids = dict(zip(words, self.fold(words), strict=True))
        return [b"".join([ids[p] for p in c]) for c in parts]


class Decoder:
    """Ids to bytes (and to decimal text) by gathering from tables of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.tables = {"bytes": self._table(pieces), "text": self._table([b"%d," % i for i in range(len(pieces))])}

    @staticmethod
    def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in pieces], np.int64)
        return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size

    def parts(self, ids: np.ndarray, kind: str) -> Iterator[bytes]:
        flat, begin, size = self.tables[kind]
        for at in range(0, len(ids), SEGMENT_TOKENS):
            some = ids[at : at + SEGMENT_TOKENS]
            n = size[some]
            yield flat[np.repeat(begin[some], n) + spread(n)].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.parts(ids, "bytes"))


def worker(ranks_file: str) -> tuple[ChunkEncoder, Decoder]:
    """Encoder and decoder of this Python worker, built once."""
    ranks = load_ranks(ranks_file)
    return worker_state(f"byte_bpe {ranks_file}", lambda: (ChunkEncoder(RankFold(ranks).make), Decoder(ranks)))


def encode(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = worker(ranks_file)
        for batch in text_slices(batches):
            ids, n = encoder.encode(column(batch, "text"))
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.ListArray.from_arrays(offsets, ids.astype(np.int32))], ["doc_id", "ids"])

    return _two(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded binary)``: the pieces of the ids, concatenated (null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = worker(ranks_file)
        for batch in batches:
            out = [decoder.decode(np.array(x.as_py() or [], np.int64)) for x in column(batch, "ids")]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    two = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return two.mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, decoded binary")


def round_trip_digests(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and hash in one pass without a shuffle: ``(doc_id, n_tokens,
    ids_sha256, decoded_sha256)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker(ranks_file)
        for batch in text_slices(batches):
            ids, n = encoder.encode(column(batch, "text"))
            ends = np.cumsum(n)
            shown, restored = [], []
            for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
                as_text, as_bytes = hashlib.sha256(), hashlib.sha256()
                held = b""
                for part in decoder.parts(ids[a:b], "text"):
                    as_text.update(held)
                    held = part
                as_text.update(held[:-1])  # no comma after the last id
                for part in decoder.parts(ids[a:b], "bytes"):
                    as_bytes.update(part)
                shown.append(as_text.hexdigest())
                restored.append(as_bytes.hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(shown, pa.string()), pa.array(restored, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _two(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def rank_map(ranks: dict[bytes, int], buckets: int) -> Column:
    """The ranks as one literal: an array of small maps, because Spark looks a key up in a map
    by scanning it.  The bucket of a piece is its CRC-32 modulo ``buckets``."""
    import zlib

    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        maps[zlib.crc32(piece) % buckets][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words_native(words: DataFrame, ranks: dict[bytes, int], buckets: int = 1 << 14) -> DataFrame:
    """``(word, ids)`` for a table of distinct words, with higher-order functions only.

    A word is an array of byte pieces (as hex).  Every step of the fold ranks all neighbours,
    takes the least rank, the leftmost first, and joins that pair; at most ``length - 1``
    steps are needed.  Null words give null, empty ones an empty array.
    """
    table = rank_map(ranks, buckets)

    def rank(piece: Column) -> Column:
        return F.get(table, F.pmod(F.crc32(F.unhex(piece)), F.lit(buckets)).cast("int"))[piece]

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(
            F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.coalesce(rank(F.concat(F.get(parts, i - 1), F.get(parts, i))), F.lit(1 << 30)),
        )
        folded = F.transform(
            F.array(F.struct(F.array_min(pairs).alias("least"), pairs.alias("pairs"))),
            lambda b: F.when(F.coalesce(b["least"], F.lit(1 << 30)) == F.lit(1 << 30), parts).otherwise(
                F.transform(
                    F.array(F.array_position(b["pairs"], b["least"]).cast("int")),
                    lambda p: F.concat(
                        F.slice(parts, F.lit(1), p - 1),
                        F.array(F.concat(F.get(parts, p - 1), F.get(parts, p))),
                        F.slice(parts, p + 2, F.size(parts)),
                    ),
                )[0]
            ),
        )
        return folded[0]

    coded = F.hex(F.encode(F.col("word"), "UTF-8"))
    n = (F.length(coded) / 2).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    pieces = F.aggregate(steps, F.transform(steps, lambda i: F.substring(coded, i * 2 - 1, F.lit(2))), step)
    return words.select("word", F.when(F.col("word").isNotNull(), F.transform(pieces, rank)).alias("ids"))
