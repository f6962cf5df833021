"""Ranked search, phrase mining and license scan against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedlake.llm import license_scan as L
from feedlake.llm import phrases as P
from feedlake.llm import ranked_search as R
from tests.llm.conftest import tricky

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOC_SCHEMA = "doc_id long, text string, lang string"


def terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


# --- ranked search -------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    cut = [(d, terms(t)) for d, t in docs]
    cut = [(d, w) for d, w in cut if w]
    n_docs, n_terms = len(cut), sum(len(w) for _, w in cut)
    df = Counter(x for _, w in cut for x in set(w))
    wanted = defaultdict(Counter)
    for i, t in items:
        wanted[i].update(terms(t))
    out = []
    for i, asked in wanted.items():
        found = []
        for d, w in cut:
            tf, m = Counter(w), 25 + 75 * len(w) * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x, q in asked.items() if tf[x])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "ß9", "Ab"]
    docs = [(i * 7, sentence(rng, words, rng.randint(1, 30))) for i in range(150)]
    docs += [(5000, docs[3][1]), (4000, docs[3][1]), (21, "w1 w2"), (21, "w1 w2"), (None, docs[3][1]), (9, None), (10, ""), (11, " .;"), (12, "w1 " * 5000)]
    items = [(i, sentence(rng, words, 6)) for i in range(30)] + [(100, None), (101, ""), (102, "absent"), (3, "w5 w5 w5"), (None, "w7")]
    return docs, items


@pytest.mark.parametrize(("tile_items", "columns", "tile_docs"), [(512, 4096, 1024), (5, 7, 16)])
def test_search_equals_plain(shipped, corpus, monkeypatch, tile_items, columns, tile_docs):
    monkeypatch.setattr(R, "TILE_ITEMS", tile_items)
    monkeypatch.setattr(R, "TILE_COLUMNS", columns)
    monkeypatch.setattr(R, "TILE_DOCS", tile_docs)
    docs, items = corpus
    left = shipped.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, rank string, score int")
    right = shipped.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    assert rows(R.ranked_search(left, right)) == plain_search(docs, items)


def test_search_without_documents_or_items(shipped):
    docs = shipped.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = shipped.createDataFrame([(1, "a")], "item_id long, text string")
    assert R.ranked_search(docs.limit(0), items).collect() == []
    assert R.ranked_search(docs, items.limit(0)).collect() == []
    assert R.ranked_search(shipped.createDataFrame([(1, None)], "doc_id long, text string"), items).collect() == []


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(1, 10**7)), min_size=1, max_size=40, unique_by=lambda e: e[:2]))
@settings(max_examples=60, deadline=None)
def test_parts_stay_exact_and_add_up(entries):
    entries.sort()
    item, term, times = (np.array(x) for x in zip(*entries, strict=True))
    tile = R.Items(list(range(4)), np.arange(10, dtype=np.uint64), item, term, times.astype(np.int64))
    weight = np.full(10, 25_000, np.int64)
    parts = R.weight_parts(tile, weight)
    assert (sum(parts) == times * 25_000).all()
    for part in parts:
        assert (part >= 0).all()
        assert max(np.bincount(item, part.astype(float))) * R.MOST_IMPACT < 2**53


# --- phrases -------------------------------------------------------------------------------


def plain_phrases(docs, least, longest=4, first=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = (b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def speech():
    rng = random.Random(5)
    words = ["the", "The", "old", "new", "É", "x\x1cy", "-", "日本", "house", "of"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "? "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for i in range(120)]
    docs += [(1, None, "en"), (2, "", "fr"), (3, ".,;", "fr"), (None, "the old house of the old house of", "en"), (5, "the old " * 4000, "en")]
    return docs + docs[:20]


@pytest.mark.parametrize(("least", "first", "most"), [(5, 2000, 1_000_000), (3, 4, 1), (30, 2000, 0)])
def test_phrases_equal_plain(shipped, speech, least, first, most):
    """Also where the frequent codes are too many to broadcast."""
    df = shipped.createDataFrame([(*d, 1, "z") for d in speech], DOC_SCHEMA + ", block int, code string").repartition(5)
    assert phrase_rows(P.phrases(df, least=least, first=first, most=most)) == plain_phrases(speech, least, first=first)


def test_phrases_of_small_blocks_and_full_tallies(shipped, speech, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 200)
    monkeypatch.setattr(P, "MOST_DISTINCT", 3)
    df = shipped.createDataFrame(speech, DOC_SCHEMA).repartition(2)
    assert phrase_rows(P.phrases(df, least=4)) == plain_phrases(speech, 4)


def test_phrases_of_tricky_and_empty_tables(shipped, empty, docs):
    assert phrase_rows(P.phrases(docs, least=3)) == plain_phrases([(d, t, lang) for d, t, lang, *_ in tricky()], 3)
    assert P.phrases(empty).collect() == []


def test_words_are_named_once(shipped, speech):
    """However many tasks hold a word; the language totals come along."""
    df = shipped.createDataFrame(speech, DOC_SCHEMA).repartition(9)
    rows = P.word_counts(df, 5).collect()
    named = [(r.lang, r.word) for r in rows if r.code is not None]
    assert len(named) == len(set(named)) > 10 and all(r.a >= 5 for r in rows if r.code is not None)
    totals = Counter()
    for r in rows:
        totals[r.lang] += r.a if r.code is None else 0
    want = Counter()
    for _, text, lang in speech:
        want["und" if lang is None else lang] += len(re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", text or ""))
    assert {k: v for k, v in totals.items() if v} == {k: v for k, v in want.items() if v}


def test_cells_of_short_codes_cost_few_bytes():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 2**63, 50_000, dtype=np.uint64) * np.uint64(2)
    batch = next(P._dealt(iter([code]), 3))
    back = [np.cumsum(P._of_planes(c), dtype=np.uint64) for c in batch.column(1)]
    assert np.array_equal(np.concatenate(back), np.unique(P._short(code)))
    assert sum(int(P._of_planes(c).sum()) for c in batch.column(2)) == len(code)
    sent = sum(len(pa.compress(c.as_py(), "lz4", asbytes=True)) for i in (1, 2) for c in batch.column(i))
    assert sent < 5 * len(code)


def test_pages_of_a_relation_hold_few_blocks(shipped):
    """The first page of a column with blocks of 256 KB, by its header: its kind and its size as variable-length numbers."""
    rows = [(bytearray(np.random.default_rng(i).bytes(1 << 18)),) for i in range(40)]
    written = P._written(shipped.createDataFrame(rows, "codes binary").coalesce(1), "pages")
    assert sorted(bytes(r[0]) for r in written.collect()) == sorted(bytes(r[0]) for r in rows)
    path = written.inputFiles()[0].removeprefix("file:").replace("///", "/")
    with open(path, "rb") as f:
        f.seek(pq.ParquetFile(path).metadata.row_group(0).column(0).data_page_offset)
        head = f.read(16)
    size, at, shift = 0, 3, 0  # after the mark and the number of the kind, and the mark of the size
    while True:
        size, shift, at = size | (head[at] & 127) << shift, shift + 7, at + 1
        if head[at - 1] < 128:
            break
    assert 0 < size >> 1 < 4 << 20


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_relations_are_blocks_of_few_bytes_a_word(shipped, monkeypatch, most):
    """However many codes are frequent: no row is stored for a sequence, and the longest are not stored."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=400)), "en") for i in range(60)]
    df = shipped.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    stored, written = [], P._written
    monkeypatch.setattr(P, "_written", lambda table, name: stored.append((name, written(table, name))) or stored[-1][1])
    found = P.phrases(df, least=3, most=most)
    relations = [t for name, t in stored if name == "occurrences"]
    assert len(relations) == 3
    for t in relations:
        assert t.count() <= 60 and t.filter("block is null").count() == 0
        assert t.selectExpr("sum(octet_length(place) + octet_length(codes)) as n").first()["n"] <= (3 if most else 9) * 60 * 400 + 2 * 60
    assert phrase_rows(found) == plain_phrases(rows, 3)


def test_a_filter_passes_all_its_codes_and_few_others(shipped):
    rng = np.random.default_rng(2)
    code = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
    often, rare = code[:2000], code[2000:]
    cells = shipped.createDataFrame(pa.Table.from_batches([*P._dealt(iter([often, rare, often]), 5)]).to_pandas(), P.CELLS)
    found = P._counted(cells, 2, 5)
    assert len(found.places(P._short(often))) == len(often)
    assert len(found.places(P._short(rare))) < 100
    assert len(P.Filter(pa.table({"bucket": pa.array([], pa.int64()), "bits": pa.array([], pa.binary())}), 3).places(P._short(rare))) == 0


def test_rare_codes_of_a_relation_are_left_out(shipped):
    words = shipped.createDataFrame([(i, 9, "en", w, w, [9], [9]) for i, w in enumerate("ab")], "code long, a long, lang string, phrase string, last string, heads array<long>, tails array<long>")
    relation = shipped.createDataFrame([(None, None, None, 7, 0, 1, 2), (None, None, None, 7, 0, 1, 3), (None, None, None, 8, 1, 0, 4)], P.RELATION)
    assert [(r.code, r.a, r.phrase) for r in P.next_level(relation, words, 5).collect()] == [(7, 5, "a b")]


def test_scores_past_64_bits(shipped):
    big = 6 * 10**12  # times 2,000,000 is more than a long holds
    df = shipped.createDataFrame([(1, big, "en", "a b", "b", [big + 1, big], [big + 3, big], 0, 0)], "code long, a long, lang string, phrase string, last string, heads array<long>, tails array<long>, head long, tail long")
    assert P.scored(df, 2).first()["score"] == 2_000_000 * big // (2 * big + 4)


# --- license scan --------------------------------------------------------------------------


def plain_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    at = lambda phrase: [i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base = [(i, label) for phrase, label in L.BASE.items() for i in at(phrase)]
    more = {label for phrase, label in (L.NOTICES | L.BASE).items() if at(phrase)}
    places = [i for i, _ in base]
    return (len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base}))), more


LICENSE_TEXTS = [
    None,
    "",
    "All rights\nreserved. all RIGHTS, reserved",
    "CC-BY and cc by-nc 4.0; xcc by",
    "GNU Lesser General Public License general public license",
    "all rights reserved all rights reserved " * 3000,
    "mit dem Hund; isc",
    "Permission is hereby granted, free of charge, to any person",
    "é cc by ü CC/BY ccby",
]


def test_scan_equals_plain(shipped, real):
    texts = [(i % 7 if i else None, t) for i, t in enumerate(LICENSE_TEXTS)] + [(r["doc_id"], r["text"]) for r in real.collect()]
    df = shipped.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, labels string")
    key = lambda t: repr(t)
    got = L.license_scan(df).collect()
    assert sorted(((r["doc_id"], *tuple(r)[1:6]) for r in got), key=key) == sorted(((d, *plain_scan(t)[0]) for d, t in texts), key=key)
    want = defaultdict(list)
    for d, t in texts:
        want[d].append(plain_scan(t)[1])
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        assert any(more <= set(r["labels"].split(",")) | {""} for more in want[r["doc_id"]])
    assert L.license_scan(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT", "mit", 0.1),
        ("SPDX-License-Identifier: MIT OR GPL-2.0-only", "mit", 0.1),
        ("SPDX-License-Identifier: GPL-2.0-only OR MIT AND MPL-2.0", "mit,mpl", 0.4),
        ("SPDX-License-Identifier: (GPL-2.0-only OR MIT) AND MPL-2.0", "mit,mpl", 0.4),
        ("SPDX-License-Identifier: GPL-2.0-only AND (MIT OR MPL-2.0)", "gpl,mit", 0.7),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 OR LicenseRef-x", "gpl", 0.7 * 0.75),
        ("SPDX-License-Identifier: LicenseRef-x */", "other", 0.6),
        ("SPDX-License-Identifier: ((MIT", "mit", 0.1),
        ("SPDX-License-Identifier: MIT OR (", "mit", 0.1),
        ("SPDX-License-Identifier: MIT AND ( OR GPL-2.0", "mit", 0.1),
        ("SPDX-License-Identifier: )", "", 0.0),
        ("SPDX-License-Identifier:\nGPL-3.0", "", 0.0),
        ("It is licensed under the MPL-2.0 or the rest.", "mpl", 0.4),
        ("It is licensed under terms of mine", "", 0.0),
        ("Released under the MIT License.", "mit", 0.1),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 0.85),
    ],
)
def test_expressions(text, labels, score):
    got = L.summary(L.scan(text.encode(), L.automaton()))
    assert (got[5], got[6]) == (labels, score)


@given(st.lists(st.sampled_from([b"(", b")", b"mit", b"gpl-2.0", b"and", b"or", b"with", b"foo", b"the", b"*/"]), max_size=14), st.booleans())
@settings(max_examples=400, deadline=None)
def test_any_expression_has_a_value_or_none(tokens, strict):
    value = L.evaluate(b" ".join(tokens), strict)
    assert value is None or 0 <= value.restriction <= 1
