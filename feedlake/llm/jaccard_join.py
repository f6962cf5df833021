"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds the hashes of its distinct ``k``-word shingles.  Hashing shingles into
groups gives a vector of group counts, and the overlap of two sets is at most the sum of the
coordinate minima of their vectors.  The number of groups is a power of two that grows with
the set, about one for every four shingles, because a vector of few large counts bounds
nothing; vectors of two sizes meet by folding the longer one.  The join links every pair of documents whose sets
have a Jaccard similarity of ``percent`` or more, and returns the components of the links:

1. Documents with equal sets are one class, linked to its smallest id; classes never meet pair
   by pair.  Up to ``MOST_COPIES`` other ids of classes are sent to the tasks, and these have no keys; with more of
   them, a hash of the set tells the copies in a block.
2. Blocks: each set is ordered by how common its shingles are, rare ones first, and its first
   ``n - ceil(percent * n) + 1`` shingles are its keys.  Two sets that link share a key.  The order
   by corpus counts of heavy shingles keeps a passage that many documents share out of the keys
   of all documents that hold enough other text.
3. Rounds of few pairs: every document proposes at most ``PROPOSALS`` neighbours in an order of
   its blocks that differs from block to block, in later rounds only neighbours from other
   components.  Parity bound (see 4), then exact comparison; the links found join most of a block.
4. Exact for the rest: in blocks that still hold several components (one of those with the same members),
   an R-tree over the count vectors (leaves packed by set size, nodes with coordinate maxima) finds every
   pair of different components that the bound lets through.  A second bound, the bits in which the
   parities of finer group counts differ, never more than the elements that only one set holds, leaves
   the pairs near the threshold, and these are compared.  Blocks of at most ``LARGE`` members are bounded by parities
   alone, without trees; those with the same first document are one task's, which gets each parity once.
5. A large block in which more than ``DENSE`` pairs a member are left (pages of one template, just under
   the threshold) hands on its members instead of its pairs.  They are dealt by size band and salt into parts of
   about ``PART`` sets; each pair of parts that may link is a tile, compared whole in one task, and
   only links that join components leave it.

The rounds only spare work, steps 4 and 5 lose no link.  No step forms a pair inside a component, and
none writes more than ``DENSE`` rows for a member of a large block, so a group of near copies costs rows in proportion
to its size; the comparisons inside the tiles of a dense block still grow with its square.  Documents without words have the empty set, which links with nothing; rows without
id are compared with nothing and get no component; an id that repeats with the same text is one
document reported once per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column, gram_codes, mix, text_bytes, text_slices, words
from feedlake.operators.components import connected_components
from feedlake.session import scratch_path

LEAST_GROUPS, MOST_GROUPS, PER_GROUP = 128, 1 << 14, 4
HEAVY = 1 << 16
LEAF, FANOUT = 16, 16
NO_BOUND = 1 << 20
LARGE = 64
PROPOSALS, ROUNDS = 8, 2
DENSE, PART = 8, 1024
COLUMNS = 2048
BUFFER_ROWS, BUFFER_BYTES = 100_000, 16 << 20
CHUNK_PAIRS = 1 << 19
MOST_COPIES = 4_000_000


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending in each text; first one of each text)."""
    flat, offsets = text_bytes(texts)
    w = words(flat, offsets, lower=True)
    count = np.diff(w.first)
    grams = mix(gram_codes(w.code, k))
    owner = np.repeat(np.arange(len(count)), count)
    inside = np.flatnonzero(owner[: len(grams)] == owner[k - 1 :][: len(grams)])
    code, of = [grams[inside]], [owner[inside]]
    for size in range(1, k):  # a text with fewer words is one shingle
        few = np.flatnonzero(count == size)
        if len(few):
            short = mix(mix(gram_codes(w.code, size)[w.first[few]]) + np.uint64(size))
            code.append(short)
            of.append(few)
    code, of = np.concatenate(code), np.concatenate(of)
    order = np.lexsort((code, of))
    code, of = code[order], of[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    code, of = code[new], of[new]
    return code, np.searchsorted(of, np.arange(len(count) + 1))


def group_count(n: np.ndarray) -> np.ndarray:
    """Groups of a set of ``n`` shingles."""
    want = np.clip(n // PER_GROUP, LEAST_GROUPS, MOST_GROUPS)
    return (1 << np.ceil(np.log2(want)).astype(np.int64)).astype(np.int64)


def folded(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of ``width`` groups (a divisor of their own numbers), counts added up; 255
    stands for 255 or more and stays infinite."""
    out = np.zeros((len(vectors), width), np.int32)
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, np.uint8).reshape(-1, width).astype(np.int32)
        out[i] = x.sum(0) + NO_BOUND * (x == 255).any(0)
    return np.minimum(out, NO_BOUND)


def _sums(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """One row per document: ``n`` shingles, a 128-bit hash of the set (``s1``, ``s2``), the
    count vector and the parities of four times as many groups; and rows with null ``vector``: shingles (``s1``) that ``n`` documents of one
    slice share, where these are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2 << 20):
            code, first = shingle_sets(column(batch, "text"), k)
            n = np.diff(first)
            rows = batch.num_rows
            owner = np.repeat(np.arange(rows), n)
            width = group_count(n)
            begin = np.cumsum(width) - width
            vector = np.bincount(begin[owner] + (code >> np.uint64(7)).astype(np.int64) % width[owner], minlength=int(width.sum()))
            packed = np.minimum(vector, 255).astype(np.uint8)
            place = 4 * begin[owner] + (code >> np.uint64(23)).astype(np.int64) % (4 * width[owner])
            parity = np.packbits(np.bincount(place, minlength=4 * int(width.sum())).astype(np.uint8) & 1, bitorder="little")
            s1, s2 = _sums(mix(code), first), _sums(mix(code ^ np.uint64(0x5851F42D4C957F2D)), first)
            yield _signature_rows(column(batch, "doc_id"), n, s1, s2, *(pa.array([x[a : a + m].tobytes() for a, m in zip(at, size, strict=True)], pa.binary()) for x, at, size in ((packed, begin, width), (parity, begin // 2, width // 2))))
            shared, times = np.unique(code, return_counts=True)
            many = times >= max(8, rows // 100)
            shared, times = shared[many], times[many]
            yield _signature_rows(pa.nulls(len(shared), pa.int64()), times, shared, shared, pa.nulls(len(shared), pa.binary()), pa.nulls(len(shared), pa.binary()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, vector binary, parity binary")


def _signature_rows(ids, n, s1, s2, vector, parity) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int32)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), vector, parity], ["doc_id", "n", "s1", "s2", "vector", "parity"])


def copies(vectors: DataFrame, same: DataFrame, most: int = MOST_COPIES) -> np.ndarray | None:
    """The ids, ascending, that have the set of a smaller id in all their rows, if there are at most ``most``
    (32 MB)."""
    ends = [f(c).alias(f"{c}_{name}") for c in ("n", "s1", "s2") for name, f in (("min", F.min), ("max", F.max))]
    mixed = vectors.groupBy("doc_id").agg(*ends).filter("n_min != n_max or s1_min != s1_max or s2_min != s2_max").select(F.col("doc_id").alias("a"))
    found = same.select("a").join(mixed, "a", "leftanti").limit(most + 1).toArrow()["a"].to_numpy()
    return np.sort(found) if len(found) <= most else None


def keys(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], k: int, percent: int, later: np.ndarray | None = None) -> DataFrame:
    """``(key, n, s1, doc_id)``: the rarest shingles of each set, enough that linked sets share
    one.  ``heavy`` are common shingles, ascending, and their ranks (1: the least common).  With the ids ``later`` of all
    copies, these have no keys, and ``s1``, which tells copies in a block, is left out."""
    shared = docs.sparkSession.sparkContext.broadcast((*heavy, later))  # at most HEAVY and MOST_COPIES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank, later = shared.value
        for batch in text_slices(batches, limit=2 << 20):
            if later is not None and len(later):
                own = column(batch, "doc_id").to_numpy()
                batch = batch.filter(pa.array(later[np.minimum(np.searchsorted(later, own), len(later) - 1)] != own))
                if not batch.num_rows:
                    continue
            code, first = shingle_sets(column(batch, "text"), k)
            n = np.diff(first)
            owner = np.repeat(np.arange(batch.num_rows), n)
            weight = np.zeros(len(code), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, code), len(common) - 1)
                weight = np.where(common[at] == code, rank[at], 0)
            order = np.lexsort((code, weight, owner))
            s1 = _sums(mix(code), first)
            wanted = n - -(-percent * n // 100) + 1
            place = np.arange(len(code)) - first[owner]
            chosen = place < wanted[owner]  # owners are in order, so places hold after sorting too
            key, of = code[order][chosen], owner[chosen]
            doc = column(batch, "doc_id").to_numpy()
            by = np.lexsort((doc[of], s1[of], n[of], key))
            key, of = key[by], of[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (n[of[1:]] != n[of[:-1]]) | (s1[of[1:]] != s1[of[:-1]])
            key, of = key[new], of[new]
            sets = {} if later is not None else {"s1": pa.array(s1[of].view(np.int64))}
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(n[of].astype(np.int32)), **sets, "doc_id": pa.array(doc[of])})

    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return known.mapInArrow(run, f"key long, n int, {'' if later is not None else 's1 long, '}doc_id long")


def blocks(postings: DataFrame, percent: int) -> DataFrame:
    """Members of keys that several classes share: ``(key, doc_id, n, before, before_n, leader,
    leader_n)``, one member per class, in an order that differs from block to block, with the member before
    it and the leader: the first member of the block, or the last that was too small for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "n", "before", "before_n", "leader", "leader_n"]
        open_: list | None = None  # (key, n, s1, doc, leader doc, leader n, handed out)
        for batch in batches:
            key, n, s1, doc = (column(batch, c).to_numpy().astype(np.int64) for c in ("key", "n", "s1", "doc_id"))
            out = True
            if open_ is not None:
                key, n, s1, doc = (np.concatenate([[h], x]) for h, x in zip(open_[:4], (key, n, s1, doc), strict=True))
                out = open_[6]
            if not len(key):
                continue
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            fresh = new_key.copy()
            fresh[1:] |= (n[1:] != n[:-1]) | (s1[1:] != s1[:-1])
            key, n, s1, doc, new_key = key[fresh], n[fresh], s1[fresh], doc[fresh], new_key[fresh]
            # The leader changes where a member is too large to link with the one so far.
            leader, leader_n = doc.copy(), n.copy()
            if open_ is not None:
                leader[0], leader_n[0] = open_[4], open_[5]
            inner = np.flatnonzero(~new_key)
            for i in inner.tolist():
                if 100 * leader_n[i - 1] >= percent * n[i]:
                    leader[i], leader_n[i] = leader[i - 1], leader_n[i - 1]
            size = np.diff(np.concatenate([np.flatnonzero(new_key), [len(key)]]))
            group = np.cumsum(new_key) - 1
            shown = size[group] > 1
            had = open_ is not None and out
            if open_ is not None:
                if had:
                    shown[0] = False  # handed out with the batch before
                    shown[1 : size[0]] = True
            before = np.concatenate([[-1], doc[:-1]])
            before_n = np.concatenate([[0], n[:-1]])
            before_n = np.where(new_key, 0, before_n)
            at = np.flatnonzero(shown)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (key, doc, n, before, before_n, leader, leader_n)], names)
            open_ = [key[-1], n[-1], s1[-1], doc[-1], leader[-1], leader_n[-1], bool(shown[-1]) or (had and len(key) == 1)]

    dealt = postings.repartition("key")
    dealt = dealt if "s1" in dealt.columns else dealt.withColumn("s1", F.col("doc_id"))  # without copies
    turned = dealt.withColumn("turn", F.xxhash64("key", "s1"))  # after the shuffle
    ordered = turned.sortWithinPartitions("key", "turn", "n", "s1", "doc_id").drop("turn")
    return ordered.mapInArrow(run, "key long, doc_id long, n long, before long, before_n long, leader long, leader_n long")


def _bound_ok(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """True where the summed coordinate minima allow the overlap that a link needs."""
    return (100 + percent) * np.minimum(a, b).sum(-1, dtype=np.int64) >= percent * (na + nb)


def bounded(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose parities allow a link: half the bytes of the count vectors, and few
    pairs that do not link pass."""
    side = lambda c: signed.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n = np.concatenate([column(batch, c).to_numpy().astype(np.int64) for c in ("na", "nb")])
            parities = [*column(batch, "pa").to_pylist(), *column(batch, "pb").to_pylist()]
            both = np.stack([np.arange(rows), np.arange(rows) + rows], 1)
            at = pa.array(np.sort(parity_allows(both, n, parities, percent)[:, 0]))
            yield pa.RecordBatch.from_arrays([column(batch, "a").take(at), column(batch, "b").take(at)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def proposed(asks: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)`` from ``(doc_id, other)``, at most ``PROPOSALS`` for a document."""
    mine = Window.partitionBy("doc_id").orderBy(F.xxhash64("doc_id", "other"), "other")
    few = asks.filter("doc_id != other").distinct().withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= PROPOSALS)
    return few.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def few_or_shuffled(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``ids`` to be joined to texts: broadcast if a count shows that there are at most ``most``
    (8 MB), so that the texts stay where they are; otherwise both sides are shuffled."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def shingle_codes(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``(doc_id, codes)``: the shingle hashes, ascending, of the documents among ``ids``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2 << 20):
            code, first = shingle_sets(column(batch, "text"), k)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([code[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc_id", "codes"])

    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return known.join(few_or_shuffled(ids), "doc_id", "leftsemi").mapInArrow(sets, "doc_id long, codes binary")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sets link, compared shingle by shingle."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "ca"), column(batch, "cb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(len(a) > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(mask), column(batch, "b").filter(mask)], ["a", "b"])

    own = shingle_codes(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), k)
    joined = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("codes").alias("ca")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("codes").alias("cb")), "b")
    return joined.select("a", "b", "ca", "cb").mapInArrow(compare, "a long, b long")


class CountTree:
    """Packed R-tree over count vectors of one width.  Points are sorted by set size; every node
    keeps the coordinate maxima and the least and largest size below it."""

    def __init__(self, vectors: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((vectors[:, 0], n))
        self.vectors, self.n = vectors[self.order], n[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        top, low, high, fan = self.vectors, self.n, self.n, LEAF
        while len(top) > 1:
            begin = np.arange(0, len(top), fan)
            top, low, high = np.maximum.reduceat(top, begin), np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)
            self.levels.append((top, low, high, fan))
            fan = FANOUT

    def search(self, vector: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Points (in the caller's numbering) that may link with the vector."""
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, fan = self.levels[depth]
            fits = (100 * high[nodes] >= percent * n) & (100 * n >= percent * low[nodes])
            nodes = nodes[fits]
            nodes = nodes[_bound_ok(top[nodes], vector, np.maximum(low[nodes], percent * n // 100), np.int64(n), percent)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.n)
            nodes = (nodes[:, None] * fan + np.arange(fan)).reshape(-1)
            nodes = nodes[nodes < below]
        nodes = nodes[(100 * self.n[nodes] >= percent * n) & (100 * n >= percent * self.n[nodes])]
        return self.order[nodes[_bound_ok(self.vectors[nodes], vector, self.n[nodes], np.int64(n), percent)]]


def block_pairs(n: np.ndarray, comp: np.ndarray, vectors: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members of a block, members of other components that the bound lets through.

    There is a tree for each vector width.  A member asks the tree of its width, unless it is in
    the block's largest component (the others find those), and the tree of half its width, where
    smaller sets that may still link with it are.
    """
    names, size = np.unique(comp, return_counts=True)
    largest = names[np.argmax(size)]
    width = group_count(n)
    trees = {}
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        trees[w] = (own, CountTree(folded([vectors[i] for i in own], w), n[own]))
    for i in range(len(n)):
        w = int(width[i])
        for want in (w, w // 2):
            if want not in trees or (want == w and comp[i] == largest):
                continue
            own, tree = trees[want]
            hits = own[tree.search(folded([vectors[i]], want)[0], int(n[i]), percent)]
            hits = hits[comp[hits] != comp[i]]
            if len(hits):
                yield i, hits


def small_block_pairs(group: np.ndarray, size: np.ndarray, n: np.ndarray, comp: np.ndarray, point: np.ndarray, percent: int) -> np.ndarray:
    """Pairs ``(x, y)`` of points, each once, of different components and fitting sizes in blocks
    of at most ``LARGE`` members; all blocks at a time."""
    found = [np.zeros(0, np.int64)]
    small = size[group] <= LARGE
    for ahead in range(1, LARGE):
        i = np.flatnonzero((group[ahead:] == group[:-ahead]) & small[ahead:])
        if not len(i):
            break
        j = i + ahead
        keep = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        x, y = point[i[keep]], point[j[keep]]
        found.append(np.minimum(x, y) << 32 | np.maximum(x, y))
    return pairs_of(np.unique(np.concatenate(found)))


def pairs_of(codes: np.ndarray) -> np.ndarray:
    """Pairs ``(x, y)`` from ``x << 32 | y``."""
    return np.stack([codes >> 32, codes & 0xFFFFFFFF], 1)


def chunks_of_blocks(size: np.ndarray, most: int = CHUNK_PAIRS) -> list[tuple[int, int]]:
    """Ranges of consecutive blocks that make about ``most`` pairs each."""
    part = np.cumsum(size * (size - 1) // 2) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def parity_allows(pairs: np.ndarray, n: np.ndarray, parities: list[bytes], percent: int) -> np.ndarray:
    """The pairs of points whose parities differ in no more bits than the sets of a link differ in
    elements.  A wider parity is folded to the other one's width."""
    width = group_count(n)
    least = np.minimum(width[pairs[:, 0]], width[pairs[:, 1]])
    out = [np.zeros((0, 2), np.int64)]
    for w in np.unique(least).tolist():
        some = pairs[least == w]
        used, place = np.unique(some, return_inverse=True)
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(parities[i], np.uint8).reshape(-1, w // 2), 0) for i in used]).view(np.uint64)
        place = place.reshape(-1, 2)
        step = max(1, (1 << 22) // w)
        for at in range(0, len(some), step):
            x, y = place[at : at + step].T
            differ = np.bitwise_count(rows[x] ^ rows[y]).sum(1, dtype=np.int64)
            out.append(some[at : at + step][(100 + percent) * differ <= (100 - percent) * (n[used[x]] + n[used[y]])])
    return np.concatenate(out)


def with_vectors(members: DataFrame, own: DataFrame) -> DataFrame:
    """``(home, key, doc_id, n, comp, vector, parity)`` from ``(home, large, key, doc_id, comp)``: the members of blocks, and
    without key the parities of a home's documents, once for all its blocks; count vectors only for large blocks."""
    once = members.select("home", "large", "doc_id", "comp").distinct().join(own.select("doc_id", "n", "vector", "parity"), "doc_id")
    vector = F.when(F.col("large"), F.col("vector")).alias("vector")
    wide = once.select("home", F.lit(None).cast("long").alias("key"), "doc_id", "n", "comp", vector, "parity")
    none = [F.lit(None).cast(wide.schema[c].dataType).alias(c) for c in ("n", "comp", "vector", "parity")]
    return wide.unionAll(members.select("home", "key", "doc_id", *none))


def rest_pairs(members: DataFrame, percent: int, own: DataFrame | None = None) -> DataFrame:
    """``(a, b, dense)``: pairs of different components in a block that the parities (in a large block both bounds) let through, or,
    where a large block has more than ``DENSE`` of them for a member, one row per member ``b`` that is in
    any, under the name ``a`` of the least of these.  ``members``: ``(home, large, key, doc_id, comp)``, vectors from ``own``, or
    ``(key, doc_id, n, comp, vector, parity)``, every block its own home.  Blocks of one home meet in one
    task; small blocks are paired many at a time, but at most about ``CHUNK_PAIRS`` pairs, and a pair that
    several of these propose is bounded once; large ones get trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BUFFER_ROWS or sum(b.nbytes for b in held) >= BUFFER_BYTES:
                table = pa.Table.from_batches(held)
                home = table["home"].to_numpy()
                last = int(np.flatnonzero(home != home[-1])[-1]) + 1 if (home != home[-1]).any() else 0
                yield from found(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
                del table
                pa.default_memory_pool().release_unused()
        if held:
            yield from found(pa.Table.from_batches(held))

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        wide, blocked = table.filter(table["key"].is_null()), table.filter(table["key"].is_valid())
        wide = wide.take(pa.array(np.argsort(wide["vector"].is_null().to_numpy(), kind="stable")))  # a row with vector first
        names, first = np.unique(wide["doc_id"].to_numpy().astype(np.int64), return_index=True)
        wide = wide.take(pa.array(first))
        size_of, comp_of = (wide[c].to_numpy().astype(np.int64) for c in ("n", "comp"))
        vectors, parities = (wide[c].to_pylist() for c in ("vector", "parity"))
        key, doc = (blocked[c].to_numpy().astype(np.int64) for c in ("key", "doc_id"))
        point = np.searchsorted(names, doc)
        n, comp = size_of[point], comp_of[point]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([begin, [len(key)]]))
        pairs, dense = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        is_small = size <= LARGE
        rows = np.repeat(is_small, size)
        small_size, small_end = size[is_small], np.cumsum(size[is_small])
        n_, comp_, point_ = n[rows], comp[rows], point[rows]
        for i, j in chunks_of_blocks(small_size):
            at = slice(int(small_end[i] - small_size[i]), int(small_end[j - 1]))
            some = small_size[i:j]
            small = small_block_pairs(np.repeat(np.arange(j - i), some), some, n_[at], comp_[at], point_[at], percent)
            pairs.append(parity_allows(small, size_of, parities, percent))
        for a, m in zip(begin[size > LARGE].tolist(), size[size > LARGE].tolist(), strict=True):
            own, some, many = point[a : a + m], [np.zeros((0, 2), np.int64)], 0
            in_any = np.zeros(m, bool)
            place = np.full(len(names), -1)
            place[own] = np.arange(m)
            for i, hits in block_pairs(n[a : a + m], comp[a : a + m], [vectors[p] for p in own], percent):
                x, y = np.full(len(hits), own[i]), own[hits]
                both = parity_allows(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), size_of, parities, percent)
                in_any[place[both.reshape(-1)]] = True
                many += len(both)
                if many <= DENSE * m:
                    some.append(both)
                else:
                    some = some[:1]
            if many <= DENSE * m:
                pairs += some
            else:
                hot = own[in_any]
                dense.append(np.stack([np.full(len(hot), hot.min()), hot], 1))
        for rows, is_dense in ((pairs, False), (dense, True)):
            both = np.unique(np.concatenate(rows), axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(names[both[:, 0]]), pa.array(names[both[:, 1]]), pa.array(np.full(len(both), is_dense))], ["a", "b", "dense"])

    if own is None:
        members, own = members.withColumn("home", F.col("key")).withColumn("large", F.lit(True)), members.dropDuplicates(["doc_id"])
    ordered = with_vectors(members, own).repartition("home").sortWithinPartitions("home", "key", "doc_id")  # nulls first
    return ordered.select("home", "key", "doc_id", "n", "comp", "vector", "parity").mapInArrow(run, "a long, b long, dense boolean")


def tiles(groups: DataFrame, percent: int, part: int = PART) -> DataFrame:
    """``(grp, band, salt, other_band, other_salt, side, doc_id, n, comp)`` from ``(grp, doc_id, n, comp)``: every
    member once in each tile of its part.  Sizes of a band differ by less than a link allows, so
    a part meets the parts of its own band and the next one."""
    banded = groups.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / min(percent, 99))) + F.lit(1e-9)).cast("int"))
    parts = banded.groupBy("grp", "band").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    near = lambda step, name: parts.select("grp", (F.col("band") + step).alias("band"), F.col("parts").alias(name))
    dealt = banded.join(parts, ["grp", "band"]).join(near(-1, "above"), ["grp", "band"], "left").join(near(1, "below"), ["grp", "band"], "left")
    salt = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    tile = lambda a, b, c, d, side: F.struct(a.alias("band"), b.alias("salt"), c.alias("other_band"), d.alias("other_salt"), F.lit(side).alias("side"))
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    band, salt_, next_, last = F.col("band"), F.col("salt"), F.col("band") + 1, F.col("band") - 1
    same = F.transform(upto(F.col("parts")), lambda x: tile(band, F.least(salt_, x), band, F.greatest(salt_, x), 0).withField("side", F.when(salt_ <= x, 0).otherwise(1)))
    up = F.transform(upto(F.col("above")), lambda x: tile(band, salt_, next_, x, 0))
    down = F.transform(upto(F.col("below")), lambda x: tile(last, x, band, salt_, 1))
    spread_ = dealt.withColumn("salt", salt).withColumn("tile", F.explode(F.concat(same, up, down)))
    return spread_.select("grp", "tile.*", "doc_id", "n", "comp")


def tile_links(side: np.ndarray, n: np.ndarray, comp: np.ndarray, codes: list[np.ndarray], whole: bool, percent: int) -> list[tuple[int, int]]:
    """Links between the sides of a tile (with ``whole``: between all of it) that join its components, at most
    one less than it has components.  Overlaps are counted exactly, ``COLUMNS`` shingles at a time."""
    left, right = (np.arange(len(n)),) * 2 if whole else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    owner = np.repeat(np.arange(len(n)), [len(c) for c in codes])
    _, code, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], (np.cumsum(times > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(left), len(right)), np.float32)  # counts far below 2**24
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [at, at + COLUMNS])
        held = np.zeros((len(n), COLUMNS), np.float32)
        held[owner[a:b], code[a:b] - at] = 1
        both += held[left] @ held[right].T
    link = ((100 + percent) * both.astype(np.int64) >= percent * (n[left][:, None] + n[right][None, :])) & (comp[left][:, None] != comp[right][None, :])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for i, j in zip(*np.nonzero(link), strict=True):
        x, y = find(int(comp[left[i]])), find(int(comp[right[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(left[i]), int(right[j])))
    return out


def dense_links(groups: DataFrame, docs: DataFrame, k: int, percent: int, part: int = PART) -> DataFrame:
    """Links ``(a, b)`` that join the components of each group ``(grp, doc_id, n, comp)``."""
    by = ["grp", "band", "salt", "other_band", "other_salt"]
    own = shingle_codes(docs, groups.select("doc_id").distinct(), k)
    placed = tiles(groups, percent, part).join(own, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        doc, n, comp, side = (table[c].to_numpy().astype(np.int64) for c in ("doc_id", "n", "comp", "side"))
        whole = table["band"][0] == table["other_band"][0] and table["salt"][0] == table["other_salt"][0]
        found = tile_links(side, n, comp, [np.frombuffer(c.as_buffer(), np.uint64) for c in table["codes"].combine_chunks()], whole, percent)
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": doc[ends].min(1, initial=1 << 62) if len(ends) else doc[:0], "b": doc[ends].max(1, initial=-1 << 62) if len(ends) else doc[:0]})

    return placed.groupBy(*by).applyInArrow(run, "a long, b long")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs``."""
    signed = _written(signatures(docs, k), "signatures")
    vectors = signed.filter(F.col("vector").isNotNull())
    own = vectors.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)).dropDuplicates(["doc_id"])

    tally = signed.filter(F.col("vector").isNull()).groupBy("s1").agg(F.sum("n").alias("times"))
    common = tally.orderBy(F.desc("times"), "s1").limit(HEAVY).collect()
    codes = np.array([r["s1"] for r in common], np.int64).view(np.uint64)
    order = np.argsort(codes)
    heavy = (codes[order], (len(codes) - np.arange(len(codes)))[order])

    classes = own.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("b"), F.count("*").alias("size")).filter("size > 1").drop("size")
    same = own.select(F.col("doc_id").alias("a"), "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).filter("a != b").select("a", "b")

    block = _written(blocks(keys(docs, heavy, k, percent, copies(vectors, same)), percent), "blocks")
    fits = lambda other: (F.col(other) > 0) & (100 * F.least("n", other) >= percent * F.greatest("n", other))
    ask = lambda other: block.filter(fits(f"{other}_n")).select("doc_id", F.col(other).alias("other"))
    links = verified(_written(bounded(proposed(ask("before").unionAll(ask("leader"))), own, percent), "pairs"), docs, k, percent)
    near = _written(connected_components(links.unionAll(same)), "components")

    def members(placed: DataFrame, once: bool = False) -> DataFrame:
        """``(home, large, key, doc_id, n, comp)`` of those among the blocks that hold several components; with ``once``, one of
        the blocks that hold the same documents (by number and a 128-bit hash of the ids).  Small blocks with the same first
        document have one home.  The rows go to their blocks once: what is asked of a block is asked over windows."""
        comp = F.coalesce("root", "doc_id").alias("comp")
        placed = placed.select("key", "doc_id", "n").join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", comp)
        block_of = Window.partitionBy("key")
        asked = {"x": F.min("comp"), "y": F.max("comp"), "size": F.count("*"), "least": F.min("doc_id")}
        asked |= {f"h{seed}": F.bit_xor(F.xxhash64("doc_id", F.lit(seed))) for seed in (1, 2)} if once else {}
        split = placed.select("*", *(value.over(block_of).alias(name) for name, value in asked.items())).filter("x != y")
        if once:
            split = split.withColumn("first", F.min("key").over(Window.partitionBy("size", "h1", "h2"))).filter("key = first")
        large = F.col("size") > LARGE
        return split.select(F.when(large, F.col("key")).otherwise(F.col("least")).alias("home"), large.alias("large"), "key", "doc_id", "n", "comp")

    open_ = block
    for number in range(ROUNDS):
        turn = Window.partitionBy("key").orderBy(F.xxhash64("key", "doc_id", F.lit(number)))
        placed = members(open_).select("key", "doc_id", "n", "comp", *(F.lag(c).over(turn).alias(f"{c}_before") for c in ("doc_id", "n", "comp")))
        open_ = placed = _written(placed, "open")  # components only grow, so no other block opens again
        asks = placed.filter((F.col("comp") != F.col("comp_before")) & fits("n_before")).select("doc_id", F.col("doc_id_before").alias("other"))
        more = verified(_written(bounded(proposed(asks), own, percent), "pairs"), docs, k, percent)
        known = near.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b")
        near = _written(connected_components(known.unionAll(more)), "components")

    left = _written(members(open_, once=True), "left")
    pairs = _written(rest_pairs(left, percent, own).distinct(), "pairs")
    rest = verified(pairs.filter("not dense").select("a", "b"), docs, k, percent)
    hot = pairs.filter("dense").select(F.col("a").alias("grp"), F.col("b").alias("doc_id"))
    if not hot.isEmpty():
        comps = hot.join(own.select("doc_id", "n"), "doc_id").join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        rest = rest.unionAll(dense_links(comps.select("grp", "doc_id", "n", F.coalesce("root", "doc_id").alias("comp")), docs, k, percent))

    edges = near.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b").unionAll(rest)
    roots = connected_components(edges).withColumnRenamed("node", "doc_id")
    out = vectors.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
    return out.join(roots, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that have the smallest id of their component; rows without
    id stay."""
    drop = jaccard_components(docs.select("doc_id", "text"), k, percent).filter("component_id != doc_id").select("doc_id").distinct()
    path = scratch_path(docs.sparkSession, "dropped")
    drop.write.parquet(path)
    drop = few_or_shuffled(docs.sparkSession.read.schema(drop.schema).parquet(path))
    return docs.join(drop, "doc_id", "leftanti").select(*docs.columns)
