import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from feedlake.llm import byte_bpe, packing, token_counts, token_files
from feedlake.llm.vocab import PATTERN, load_ranks, load_tokenizer
from feedlake.session import scratch_path
from tests.llm.conftest import texts_of

RANKS, BYTE_LEVEL, WORD_LEVEL = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def test_byte_bpe_digests(docs, real, tik):
    for df in (docs, real):
        texts = texts_of(df)
        rows = byte_bpe.round_trip_digests(df, RANKS).collect()
        assert len(rows) == len(texts)
        for r in rows:
            text = texts[r["doc_id"]] or ""
            ids = tik.encode_ordinary(text)
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_interface(docs, empty, tik):
    coded = byte_bpe.encode(docs, RANKS)
    texts = texts_of(docs)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {d: tik.encode_ordinary(t or "") for d, t in texts.items()}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(coded, RANKS).collect()} == {d: (t or "").encode() for d, t in texts.items()}
    assert byte_bpe.round_trip_digests(empty, RANKS).count() == 0


def test_native_fold_agrees(shipped, docs):
    words = sorted({w for t in texts_of(docs).values() for w in PATTERN.findall(t or "") if len(w) < 40})
    df = shipped.createDataFrame([(w,) for w in [*words, None, ""]], "word string")
    ranks = load_ranks(RANKS)
    fold = byte_bpe.RankFold(ranks)
    got = {r["word"]: r["ids"] for r in byte_bpe.encode_words_native(df, ranks).collect()}
    assert got.pop(None) is None and got.pop("") == []
    for w, packed in zip(words, fold.fold([w.encode() for w in words]), strict=True):
        assert got[w] == np.frombuffer(packed, "<u4").tolist()


def test_bit_packing():
    for width in (1, 5, 16, 17, 31):
        ids = np.random.default_rng(width).integers(0, 1 << width, 999)
        block = token_files.pack(ids, width)
        assert len(block) == -(-999 * width // 8)
        assert (token_files.unpack(block, width, 0, 999) == ids).all()
        assert (token_files.unpack(block, width, 500, 123) == ids[500:623]).all()
    assert token_files.crc_join(zlib.crc32(b"abc"), zlib.crc32(b"defg"), 4) == zlib.crc32(b"abcdefg")


@pytest.mark.parametrize("block_ids", [50, token_files.BLOCK_IDS])
def test_token_files(shipped, docs, empty, block_ids):
    tok = load_tokenizer(BYTE_LEVEL)
    path = scratch_path(shipped, "t")
    token_files.write_token_files(docs.repartition(3), path, BYTE_LEVEL, 2, block_ids=block_ids)
    got = sorted(tuple(r) for r in token_files.document_digests(shipped, path).collect())
    want, at = [], 0
    for d, t in sorted(texts_of(docs).items()):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    some = token_files.read_parts(shipped, path, [9, 12]).orderBy("start").collect()
    assert {r["doc_id"] for r in some} == {9, 12}
    assert sum((r["ids"] for r in some if r["doc_id"] == 12), []) == tok.encode("a  b\t c\n\n d ", add_special_tokens=False).ids + [2]
    path = scratch_path(shipped, "t")
    token_files.write_token_files(empty, path, BYTE_LEVEL, 2)
    assert token_files.document_digests(shipped, path).count() == 0


def test_token_files_null_and_repeated_ids(shipped):
    df = shipped.createDataFrame([(None, "x y"), (5, "a"), (5, "b c"), (5, "a")], "doc_id long, text string")
    path = scratch_path(shipped, "t")
    token_files.write_token_files(df, path, BYTE_LEVEL, 2)
    rows = token_files.document_digests(shipped, path).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == [(None, 0, 3), (5, 3, 2), (5, 5, 2), (5, 7, 3)]


@pytest.mark.parametrize("piece", [7, 200, token_counts.PIECE_CHARS])
def test_token_counts(docs, real, empty, piece):
    tok = load_tokenizer(BYTE_LEVEL)
    df = docs if piece < 1000 else real.select("doc_id", "text").unionAll(docs.select(F.col("doc_id") + 100000, "text"))
    texts = texts_of(df)
    rows = token_counts.token_counts(df, BYTE_LEVEL, 512, piece_chars=piece).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert token_counts.token_counts(empty, BYTE_LEVEL).count() == 0


def test_state_maps_are_associative(docs):
    machine = token_counts.transducer(BYTE_LEVEL)
    count = lambda c: machine.chunks.many([c])[0]
    rng = random.Random(1)
    for text in texts_of(docs).values():
        text = (text or "")[:400]
        cuts = sorted(rng.sample(range(len(text) + 1), min(5, len(text) + 1)))
        pieces = [token_counts.piece_map(text[a:b], count) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        left = pieces[0]
        for p in pieces[1:]:
            left = token_counts.join_maps(left, p, count)
        tree = token_counts.scan_maps(pieces, count)
        assert token_counts.close_map(left, count) == token_counts.close_map(tree, count) == sum(map(count, [text]))


def test_packing_plan():
    rng = random.Random(3)
    for _ in range(200):
        cap = rng.choice([10, 30, 100])
        count = {rng.randint(1, cap): rng.randint(0, 6) for _ in range(rng.randint(1, 12))}
        done, rest = packing.reduce_by_dominance(dict(count), cap)
        bins = [*done, *packing.best_fit(rest, cap)]
        used = {}
        for content, times in bins:
            assert times > 0 and sum(s * k for s, k in content) <= cap
            for s, k in content:
                used[s] = used.get(s, 0) + k * times
        assert used == {s: n for s, n in count.items() if n}
        plain = sum(t for _, t in packing.best_fit({s: n for s, n in count.items() if n}, cap))
        assert sum(t for _, t in bins) <= plain


def fewest(sizes, cap):
    """Least number of sequences by trying all, for tiny instances."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= sizes[i]}:
            at = rooms.index(r)
            go(i + 1, rooms[:at] + [r - sizes[i]] + rooms[at + 1 :])
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        count = {s: sizes.count(s) for s in sizes}
        done, rest = packing.reduce_by_dominance(count, 20)
        left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(t for _, t in done) + fewest(left, 20) == fewest(sizes, 20)


def test_packing(docs, empty):
    tok = load_tokenizer(WORD_LEVEL)
    for capacity in (16, 4096):
        rows = packing.pack_documents(docs, WORD_LEVEL, 1, capacity).collect()
        sequences, pieces = {}, {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            pieces.setdefault(r["doc_id"], []).append(r)
        for content in sequences.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= capacity
        for d, t in texts_of(docs).items():
            ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
            own = sorted(pieces[d], key=lambda r: r["piece"])
            assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
            for r in own:
                assert r["start"] == r["piece"] * capacity
                assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
            assert sum(r["length"] for r in own) == len(ids)
    assert packing.pack_documents(empty, WORD_LEVEL, 1, 4096).count() == 0
