import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlake.llm import jaccard_join, substring_dedup, suffix_index
from tests.llm import brute
from tests.llm.conftest import texts_of

HOT = {"hot_in_slice": 1, "hot_group": 2, "segment": 301}


@pytest.fixture(scope="module")
def copies(shipped):
    """Passages, copies and near copies of a few texts, many times over."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(120)] for _ in range(4)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(160):
        words = list(base[i % 4]) if i % 3 else [rng.choice(vocab) for _ in range(90)]
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if i % 2:
            words[30:30] = passage
        rows.append((i, " ".join(words)))
    rows += [(500 + i, " ".join(base[0])) for i in range(20)]
    return shipped.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("limits", [{}, HOT])
def test_substring_dedup(docs, real, copies, limits):
    for df in (docs, copies, *([real] if not limits else [])):
        want = brute.substring_rows(texts_of(df), 13)
        got = {r[0]: tuple(r)[1:] for r in substring_dedup.substring_digests(df, 13, **limits).collect()}
        assert got == want


@pytest.mark.parametrize(("limits", "shares"), [({}, (1, 3)), (HOT, (1, 1, 1, 1, 1))])
def test_suffix_index(docs, real, copies, limits, shares):
    for df in (docs, copies, *([real] if not limits else [])):
        want = brute.suffix_rows(texts_of(df), 100)
        got = {r[0]: tuple(r)[1:] for r in suffix_index.suffix_digests(df, 100, shares, **limits).collect()}
        assert got == want


def test_levels_merge_geometrically(shipped, copies):
    index = suffix_index.SuffixIndex(shipped, 100)
    sizes = []
    for part in suffix_index.batches_by_id(copies, [1] * 7):
        index.add(part)
        sizes.append([rank for rank, _ in index.levels])
    assert sizes == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0], [2, 0, 0], [2, 1, 0]]


def test_jaccard_components(docs, real, copies):
    for df in (docs, copies, real):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
        assert got == brute.jaccard_rows(texts_of(df))


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(2)
    vectors = rng.integers(0, 4, (300, 128)).astype(np.int32)
    vectors[100:200] = vectors[:100] + (rng.random((100, 128)) < 0.05)
    n = vectors.sum(1).astype(np.int64)
    tree = jaccard_join.CountTree(vectors, n)
    for i in range(0, 300, 7):
        ok = jaccard_join._bound_ok(vectors, vectors[i], n, n[i], 80) & (100 * np.minimum(n, n[i]) >= 80 * np.maximum(n, n[i]))
        assert sorted(tree.search(vectors[i], int(n[i]), 80).tolist()) == np.flatnonzero(ok).tolist()


def test_block_pairs_lose_no_link():
    """Sets of very different sizes, some of them close: every close pair of different
    components is proposed, whatever the widths of its vectors."""
    rng = np.random.default_rng(3)
    sets = []
    for size in rng.integers(100, 3000, 60):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[: int(size * 0.93)], rng.integers(0, 1 << 62, size // 9).astype(np.uint64)]))]
    n = np.array([len(s) for s in sets], np.int64)
    width = jaccard_join.group_count(n)
    vectors = [np.bincount((s >> np.uint64(7)).astype(np.int64) % w, minlength=w).astype(np.uint8).tobytes() for s, w in zip(sets, width, strict=True)]
    comp = np.arange(len(sets))
    comp[::5] = 0
    proposed = {frozenset((i, int(j))) for i, hits in jaccard_join.block_pairs(n, comp, vectors, 80) for j in hits}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if comp[i] != comp[j] and 100 * both >= 80 * (n[i] + n[j] - both):
                assert frozenset((i, j)) in proposed
    assert len(proposed) < 300


def template_pages(number: int) -> list[tuple[int, str]]:
    """Pages of one template: 200 words of it, then 26 to 29 own ones (similarity of about 0.78), and every 25th
    page is a near copy of the one before with an own word changed."""
    rng = random.Random(number)
    rows = []
    for i in range(number):
        own = [f"own{i}x{j}" for j in range(26 + i % 4)]
        if i % 25 == 24:
            own = [*rows[-1][1].split()[200:], f"last{i}"]
        rows.append((rng.randrange(10) + 10 * i, " ".join([f"t{j}" for j in range(200)] + own)))
    return rows


def test_dense_block_rows_grow_with_its_members(shipped):
    """A block of pages just under the threshold: its members leave the task, not its pairs, and
    the tiles give exactly the links."""
    for number in (150, 300):
        df = shipped.createDataFrame(template_pages(number), "doc_id long, text string").repartition(3)
        signed = jaccard_join.signatures(df, 5).filter("vector is not null")
        members = signed.select(F.lit(1).cast("long").alias("key"), "doc_id", F.col("n").cast("long").alias("n"), F.col("doc_id").alias("comp"), "vector", "parity")
        rows = jaccard_join.rest_pairs(members, 80).collect()
        assert {r["dense"] for r in rows} == {True} and len(rows) <= number
        groups = members.join(shipped.createDataFrame(rows).select(F.col("a").alias("grp"), F.col("b").alias("doc_id")), "doc_id").select("grp", "doc_id", "n", "comp")
        for part in (40, 1024):
            links = sorted((r["a"], r["b"]) for r in jaccard_join.dense_links(groups, df, 5, 80, part).collect())
            texts = sorted(texts_of(df).items())
            assert links == [(texts[i - 1][0], texts[i][0]) for i in range(24, number, 25)]


def test_template_pages_through_the_join(shipped):
    df = shipped.createDataFrame(template_pages(200), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute.jaccard_rows(texts_of(df))


def test_tiles_meet_every_pair_of_fitting_sizes_once(shipped):
    sizes = [1, 2, 3, 4, 5, 6, 80, 99, 100, 101, 124, 125, 126, 156, 157, 1000, 1250, 1251] * 3
    rows = [(7, i, n, i) for i, n in enumerate(sizes)]
    df = jaccard_join.tiles(shipped.createDataFrame(rows, "grp long, doc_id long, n long, comp long"), 80, part=4)
    met: dict = {}
    for r in df.collect():
        met.setdefault(tuple(r)[:5], ([], []))[r["side"]].append(r["doc_id"])
    pairs = []
    for (_, band, salt, other, salt2), (left, right) in met.items():
        if (band, salt) == (other, salt2):
            assert not right
            pairs += [frozenset((a, b)) for i, a in enumerate(left) for b in left[:i]]
        else:
            pairs += [frozenset((a, b)) for a in left for b in right]
    assert len(pairs) == len(set(pairs))
    fitting = {frozenset((i, j)) for i in range(len(sizes)) for j in range(i) if 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])}
    assert fitting <= set(pairs)


def test_parities_lose_no_link():
    rng = np.random.default_rng(4)
    sets = []
    for size in rng.integers(50, 3000, 40):
        base = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        sets += [base, np.unique(np.concatenate([base[: int(len(base) * 0.9)], rng.integers(0, 1 << 62, size // 9).astype(np.uint64)]))]
    n = np.array([len(s) for s in sets], np.int64)
    bits = [4 * int(w) for w in jaccard_join.group_count(n)]
    parities = [np.packbits(np.bincount((s >> np.uint64(23)).astype(np.int64) % b, minlength=b).astype(np.uint8) & 1, bitorder="little").tobytes() for s, b in zip(sets, bits, strict=True)]
    pairs = np.array([(j, i) for i in range(len(sets)) for j in range(i) if 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j])])
    kept = {tuple(p) for p in jaccard_join.parity_allows(pairs, n, parities, 80).tolist()}
    for j, i in pairs.tolist():
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (n[i] + n[j] - both):
            assert (j, i) in kept
    assert len(kept) < 80


def test_null_and_repeated_ids(shipped):
    words = " ".join(f"w{i}" for i in range(60))
    df = shipped.createDataFrame([(None, words), (None, words), (7, words), (7, words), (8, words), (9, None)], "doc_id long, text string")
    sub = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.substring_digests(df).collect())
    assert sub == [(0, 0), (0, 0), (7, 0), (7, 0), (8, 60), (9, 0)]
    cut = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_index.suffix_digests(df).collect())
    assert cut == [(0, 0), (0, 0), (7, 0), (7, 0), (8, len(words)), (9, 0)]
    comp = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.jaccard_components(df).collect())
    assert comp == [(0, 56, 0), (0, 56, 0), (7, 56, 7), (7, 56, 7), (8, 56, 7), (9, 0, 9)]
    assert sorted((r["doc_id"] or 0) for r in jaccard_join.keep_one(df).collect()) == [0, 0, 7, 7, 9]


def test_empty_tables(empty):
    assert substring_dedup.substring_digests(empty).count() == 0
    assert suffix_index.suffix_digests(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_columns_with_clashing_names(copies):
    df = copies.withColumns({c: F.lit(1) for c in ("n_words", "n_removed", "kept", "spans", "row", "lo", "n", "h", "key", "comp", "root", "n_chars")})
    out = substring_dedup.drop_repeats(df)
    assert out.columns == df.columns
    want = brute.substring_rows(texts_of(copies), 13)
    for r in out.collect():
        assert hashlib.sha256(" ".join(brute.WORD.findall(r["text"])).encode()).hexdigest() == want[r["doc_id"]][2]
    assert jaccard_join.keep_one(df).columns == df.columns
    assert suffix_index.removed_bytes(df).select("row.*").columns == df.columns


def test_small_blocks_send_a_parity_once_for_their_home(shipped):
    """Documents that meet in many blocks: a home gets one parity of each, no count vector, and the pairs are
    those of the blocks; a document that a large block holds as well still has its vector there."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join([*base, *(f"own{i}x{j}" for j in range(rng.randrange(3, 9)))])) for i in range(70)]
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    own = jaccard_join.signatures(df, 5).filter("vector is not null")
    member = "home long, large boolean, key long, doc_id long, comp long"
    small = [(0, False, key, doc, doc) for key in range(20) for doc in range(5)]
    left = shipped.createDataFrame(small, member)
    wide = jaccard_join.with_vectors(left, own).filter("parity is not null").collect()
    assert sorted(r["doc_id"] for r in wide) == list(range(5)) and {r["vector"] for r in wide} == {None}
    got = sorted(tuple(r) for r in jaccard_join.rest_pairs(left, 80, own).collect())
    assert got == [(a, b, False) for a in range(5) for b in range(a + 1, 5)]
    both = left.unionAll(shipped.createDataFrame([(99, True, 99, doc, doc) for doc in range(70)], member))
    got = {r["b"] for r in jaccard_join.rest_pairs(both, 80, own).collect() if r["dense"]}
    assert got == set(range(70))


def test_copies_have_no_keys(shipped):
    """Copies are left out of the blocks, but not an id that repeats with another text."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, text), (3, text), (3, text), (4, text), (4, "other " + text), (5, text + " x")]
    df = shipped.createDataFrame(rows, "doc_id long, text string").repartition(2)
    vectors = jaccard_join.signatures(df, 5).filter("vector is not null")
    same = shipped.createDataFrame([(2, 1), (3, 1), (4, 1)], "a long, b long")
    later = jaccard_join.copies(vectors, same)
    assert later.tolist() == [2, 3] and jaccard_join.copies(vectors, same, most=1) is None
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keyed = jaccard_join.keys(df, none, 5, 80, later)
    assert "s1" not in keyed.columns and {r["doc_id"] for r in keyed.collect()} == {1, 4, 5}
    assert {r["component_id"] for r in jaccard_join.jaccard_components(df).collect()} == {1}
    blocked = jaccard_join.blocks(keyed, 80).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "n").alias("members"))
    assert blocked.filter("n != members").isEmpty()
