"""Token counts by a compiled finite-state transducer.

Byte-pair encoding has one right token ending at each prefix of a word: the only token whose
pair with the last token of the shorter prefix is stable (no merge crosses their border).
That makes the encoding a deterministic machine.  A state is the set of live starts: for each
place where an unfinished token may have begun, its node in the vocabulary's trie, the last
token before it and the token count there relative to now.  Reading a byte moves the live
starts along the trie and emits the change of the token count (which can be negative: a
longer token replaces several).  States are built when first reached and kept in a bounded
table, so the words of a corpus compile the machine they need.

Long texts are cut into pieces.  A piece's state map is (text up to its first safe cut, count
between the cuts, text after the last): whatever comes before, everything behind a safe cut is
read from the start state.  Maps compose associatively, so pieces of one text are read in
different tasks and joined by a prefix scan over their maps.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows are counted each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column, text_slices, worker_state
from feedlake.llm.chunks import ChunkEncoder, TwoGenerations
from feedlake.llm.vocab import PATTERN, SYMBOL, load_merges

MAX_STATES = 200_000
PIECE_CHARS = 1 << 16
INNER_CUT = regex.compile(r"(?<=\S) (?=\S)")


class CountTransducer:
    def __init__(self, name: str):
        vocab, merges, self.special = load_merges(name)
        byte_of = {s: b for b, s in enumerate(SYMBOL)}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, rank)
        for r, (a, b) in enumerate(merges):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            self.halves.setdefault(both, (left, right, r))
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token: list[int] = [-1]
        self.leaf: list[bool] = [True]
        for piece, token in vocab.items():
            if piece in self.special:
                continue
            node = 0
            for s in piece:
                key = node << 8 | byte_of[s]
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.leaf[node] = False
                    self.token.append(-1)
                    self.leaf.append(True)
                node = self.child[key]
            self.token[node] = token
        self.stable_pairs: dict[int, bool] = {}
        self.edges: dict[int, list[tuple[int, float]]] = {}  # at most two per token
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, 0),)
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.move: dict[int, tuple[int, int]] = {}  # state << 8 | byte -> (state, emitted)

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The pieces that stand at one edge of a token while it is being merged, shortest
        first, each with the rank of the merge that ends it."""
        key = token << 1 | right
        if key not in self.edges:
            out, ended = [], float("inf")
            while True:
                out.append((token, ended))
                if token not in self.halves:
                    break
                left, other, ended = self.halves[token]
                token = other if right else left
            self.edges[key] = out[::-1]
        return self.edges[key]

    def stable(self, a: int, b: int) -> bool:
        """True if the merges of ``a`` and ``b`` leave their border alone.

        Both edges grow in rank order.  While a pair of edge pieces stands, a merge across the
        border happens if it ranks before whatever ends one of them; at equal rank the merge
        further left goes first.
        """
        if a < 0:
            return True
        key = a << 20 | b
        known = self.stable_pairs.get(key)
        if known is not None:
            return known
        left, right = self._edge(a, True), self._edge(b, False)
        i = j = 0
        good = True
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            across = self.rank.get((x, y))
            if across is not None and across < x_end and across <= y_end:
                good = False
                break
            if x_end == y_end == float("inf"):
                break
            if x_end <= y_end:
                i += 1
            if y_end <= x_end:
                j += 1
        if len(self.stable_pairs) > 500_000:
            self.stable_pairs.clear()
        self.stable_pairs[key] = good
        return good

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        alive, last, count = [], None, 0
        for node, before, relative in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if last is None and self.token[node] >= 0 and self.stable(before, self.token[node]):
                last, count = self.token[node], relative + 1
            if not self.leaf[node]:
                alive.append((node, before, relative))
        if last is None:
            raise ValueError("the vocabulary does not cover this byte sequence")
        new = (*((n, b, r - count) for n, b, r in alive), (0, last, 0))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        self.move[state << 8 | byte] = (number, count)
        return number, count

    def count_word(self, word: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self._reset()
        state = total = 0
        move = self.move
        for byte in word:
            to = move.get(state << 8 | byte)
            state, emitted = to if to is not None else self._step(state, byte)
            total += emitted
        return total

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk: special strings count one each, pattern matches are read
        from the start state, each distinct one once."""
        totals, words, owner = [0] * len(chunks), [], []
        for i, chunk in enumerate(chunks):
            parts = [chunk]
            if any(s in chunk for s in self.special):
                parts = regex.split("|".join(map(regex.escape, self.special)), chunk)
                totals[i] = len(parts) - 1
            for part in parts:
                found = PATTERN.findall(part)
                words += found
                owner += [i] * len(found)
        for i, n in zip(owner, self.words.many(words), strict=True):
            totals[i] += n
        return totals

    @property
    def words(self) -> TwoGenerations:
        if not hasattr(self, "_words"):
            self._words = TwoGenerations(lambda some: [self.count_word(w.encode()) for w in some])
        return self._words

    @property
    def chunks(self) -> TwoGenerations:
        if not hasattr(self, "_chunks"):
            self._chunks = TwoGenerations(self.count_chunks)
        return self._chunks


def transducer(name: str) -> CountTransducer:
    return worker_state(f"transducer {name}", lambda: CountTransducer(name))


def join_maps(a: tuple, b: tuple, count) -> tuple:
    """Composition of two neighbouring state maps ``(has a cut, head, tokens, tail)``."""
    if not a[0] and not b[0]:
        return (False, a[1] + b[1], 0, "")
    if not a[0]:
        return (True, a[1] + b[1], b[2], b[3])
    if not b[0]:
        return (True, a[1], a[2], a[3] + b[1])
    middle = a[3] + b[1]
    return (True, a[1], a[2] + sum(map(count, _cut(middle))) + b[2], b[3])


def _cut(text: str) -> list[str]:
    """Chunks of a stretch that ends at a cut and begins at a cut or the text's start."""
    out, at = [], 0
    for m in INNER_CUT.finditer(text):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def close_map(m: tuple, count) -> int:
    """Tokens of a whole text from its state map."""
    return sum(map(count, _cut(m[1]))) + (m[2] + sum(map(count, _cut(m[3]))) if m[0] else 0)


def scan_maps(maps: list[tuple], count) -> tuple:
    """Prefix scan's last value, by pairwise composition."""
    while len(maps) > 1:
        maps = [join_maps(maps[i], maps[i + 1], count) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def piece_map(text: str, count) -> tuple:
    cuts = [m.start() for m in INNER_CUT.finditer(text)]
    if not cuts:
        return (False, text, 0, "")
    inner = text[cuts[0] : cuts[-1]]
    return (True, text[: cuts[0]], sum(map(count, _cut(inner))) if inner else 0, text[cuts[-1] :])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text.

    Texts of up to ``piece_chars`` bytes are one piece and are counted where they are read;
    the pieces of longer ones are read in parallel tasks' rows and joined by their maps.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    short, long_ = rows.filter(F.col("n_bytes") <= piece_chars), rows.filter(F.col("n_bytes") > piece_chars)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_counter(tokenizer)
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(encoder(column(batch, "text")), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        count = lambda c: machine.chunks.many([c])[0]
        for batch in text_slices(batches, "piece"):
            done = [piece_map(p or "", count) for p in column(batch, "piece").to_pylist()]
            cut, head, n, tail = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "row", "n_bytes", "place")), pa.array(cut), pa.array(head, pa.string()), pa.array(n, pa.int64()), pa.array(tail, pa.string())], ["doc_id", "row", "n_bytes", "place", "cut", "head", "n", "tail"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        count = lambda c: machine.chunks.many([c])[0]
        for batch in batches:
            totals = [close_map(scan_maps([(p["cut"], p["head"], p["n"], p["tail"]) for p in some], count), count) for some in column(batch, "some").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    schema = f"doc_id {kind}, n_bytes long, n_tokens long"
    pieces = long_.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "row", "n_bytes", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{piece_chars}}}"), F.lit(0))).alias("place", "piece")
    )
    read = pieces.mapInArrow(maps, f"doc_id {kind}, row long, n_bytes long, place int, cut boolean, head string, n long, tail string")
    grouped = read.groupBy("doc_id", "row", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("place", "cut", "head", "n", "tail"))).alias("some"))
    counted = short.mapInArrow(whole, schema).unionByName(grouped.mapInArrow(scan, schema))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def chunk_counter(tokenizer: str):
    """Counter of whole texts by their distinct chunks, built once per worker."""
    return worker_state(f"counter {tokenizer}", lambda: ChunkEncoder(transducer(tokenizer).count_chunks).total)
