import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedlake.llm import embedding_dedup, quality, toxicity
from tests.llm import brute
from tests.llm.conftest import SF, texts_of

MID = "/root/testdata/sf0.01"


def test_quality_counts(docs, real):
    for df in (docs, real):
        texts = texts_of(df)
        for r in quality.quality(df).collect():
            n, chars, symbols, dup, repeat = brute.quality_counts(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
            assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
            assert not (r["base_failed"] and r["kept"])


def test_quality_agrees_with_labels(shipped):
    judged = quality.quality(shipped.read.parquet(f"{MID}/documents.parquet")).filter("not base_failed")
    rows = judged.join(shipped.read.parquet(f"{MID}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.97


def test_estimate_finds_the_unreliable_rule():
    # Rule 0 is right, rule 1 votes bad on good and bad texts alike.
    votes = {"0111111": 700, "0211111": 200, "2211111": 80, "2111111": 20}
    posterior = quality.estimate(votes)
    assert posterior["0211111"] > 0.5 > posterior["2111111"]
    assert quality.estimate({}) == {}


def test_toxicity_held_out(shipped):
    docs, labels = (shipped.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    y = np.array([r["toxic"] for r in rows])
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean(y == [r["predicted"] for r in rows]) > 0.955
    order = np.argsort([r["score"] for r in rows])
    rank = np.empty(len(rows))
    rank[order] = np.arange(len(rows))
    assert (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum())) > 0.95


def test_toxicity_edges(shipped, docs, empty):
    labels = shipped.createDataFrame([(0, 1), (3, 0), (9, None), (None, 1), (12, 7)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.limit(0)
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(empty, labels).count() == 0


def test_held_out_rows_do_not_train(shipped):
    text = " ".join(f"plain{i}" for i in range(30))
    ids = [i for i in range(400)]
    rows = [(i, text + (" vile" if i % 2 else ""), i % 2) for i in ids]
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, t, y in rows]
    scores = []
    for some in (rows, flipped):
        df = shipped.createDataFrame(some, "doc_id long, text string, toxic int").coalesce(1)
        scores.append({r["doc_id"]: r["score"] for r in toxicity.toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()})
    assert scores[0] == pytest.approx(scores[1])
    assert scores[0][1] > 0.5 > scores[0][2]


def plain_model(rows):
    """Ratios and fit of (text, label) rows with dictionaries: every row a list of its n-grams' buckets."""
    sets = []
    for text, _ in rows:
        owner, bucket = toxicity.presence([toxicity.plain(text)])
        assert not owner.any()
        sets.append(set(bucket.tolist()))
    label = [y for _, y in rows]
    toxic, rest = sum(label), len(label) - sum(label)
    held = {}
    for s, y in zip(sets, label, strict=True):
        for b in s:
            held.setdefault(b, [0, 0])[y] += 1
    ratio = {b: np.log((n[1] + 1) / (toxic + 2)) - np.log((n[0] + 1) / (rest + 2)) for b, n in held.items()}
    ratio = {b: r for b, r in ratio.items() if sum(held[b]) >= toxicity.MIN_DOCS and abs(r) >= toxicity.MIN_RATIO}
    names = sorted(ratio)
    x = np.array([[ratio[b] if b in s else 0.0 for b in names] for s in sets])
    y, share = np.array(label), np.where(np.array(label) == 1, len(label) / (2 * toxic), len(label) / (2 * rest))
    scale = (x * x * share[:, None]).mean(0)
    w, bias, speed, last = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0
    for _ in range(400):
        error = (1 / (1 + np.exp(-(x @ w + bias))) - y) * share
        speed = 0.9 * speed - 0.05 * ((x * error[:, None]).mean(0) + toxicity.PENALTY * w / np.sqrt(len(y))) / (scale / 4 + 1e-3)
        last = 0.9 * last - 0.05 * error.mean() / 0.25
        w, bias = w + 0.2 * speed, bias + 0.2 * last
    return lambda text: 1 / (1 + np.exp(-(bias + sum(ratio[b] * v for b, v in zip(names, w, strict=True) if b in set(toxicity.presence([toxicity.plain(text)])[1].tolist())))))


def test_toxicity_scores_of_a_plain_model(shipped):
    rng = np.random.default_rng(2)
    vocabulary = ["calm", "kind", "table", "river", "stone", "vile", "nasty", "rotten"]
    rows = []
    for i in range(60):
        y = i % 2
        chance = np.array([1] * 5 + [4 if y else 0.3] * 3, float)
        rows.append((i, " ".join(rng.choice(vocabulary, 8, p=chance / chance.sum())), y))
    df = shipped.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df.drop("toxic"), df.select("doc_id", "toxic")).collect()}
    want = plain_model([(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5])
    assert got == pytest.approx({i: want(t) for i, t, _ in rows}, abs=1e-5)


def test_repeated_rows_and_ids_train_alike_in_any_partitioning(shipped):
    rows = [(i, f"plain words {i % 7} here" + (" vile thing" if i % 2 else ""), i % 2) for i in range(80)]
    rows += [(81, "one text vile", 1), (81, "another text", 1)]  # one id, two texts
    df = shipped.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionAll(shipped.createDataFrame([(4, 1), (4, 0)], "doc_id long, toxic int"))
    want = {}
    for max_rows in (3000, 20):
        for docs, parts in ((df, 1), (df.unionAll(df).unionAll(df.filter("doc_id = 3")), 7), (df, 5)):
            got = {(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs.drop("toxic").repartition(parts), labels.unionAll(labels), max_rows=max_rows).collect()}
            assert want.setdefault(max_rows, got) == got
    assert want[3000] != want[20]


def near(rows, threshold):
    """Links and components of (id, vector, label) rows by comparing all pairs."""
    good = [(i, np.array(v, float), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, u, a) in enumerate(good):
        for j, v, b in good[:x]:
            if a == b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}


@pytest.mark.parametrize("limits", [{}, {"block": 8, "reach": 1, "passes": 12}])
def test_embeddings(shipped, limits):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((3, 16))
    rows = []
    for i in range(150):
        v = centre[i % 3] + rng.standard_normal(16) * (0.04 if i % 2 else 2)
        rows.append((i * 2 + 1, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(9)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, rows[1][1], None), (2004, [float("nan")] * 16, 0), (2005, [float("inf")] + [1.0] * 15, 0), (2006, [None] + [1.0] * 15, 0), (2007, rows[1][1][:15], 1)]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df.unionAll(df.limit(3)), **limits).collect()}
    assert got == near(rows, 0.98)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_a_label_far_larger_than_a_window(shipped):
    rng = np.random.default_rng(11)
    n, dim, common = 700, 16, 3
    v = rng.standard_normal((n, dim))
    v[:, 0] += common * np.sqrt(dim)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    away = rng.standard_normal((n, dim))
    away -= (away * v).sum(1, keepdims=True) * v
    twin = 0.981 * v + np.sqrt(1 - 0.981**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    both = np.concatenate([v, twin])
    df = shipped.createDataFrame([(i, x, 1) for i, x in enumerate(both.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, block=16, reach=2).collect()}
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    assert got == dict(enumerate(((unit @ unit.T >= 0.98).sum(1) - 1).tolist()))


def test_pipeline(shipped):
    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = texts_of(docs), stage(shipped, docs, SF).cache()
        after = texts_of(docs)
        assert docs.columns == names and set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == {d for d, (_, c) in brute.jaccard_rows(before).items() if c == d}
        if name == "substring_dedup":
            want = brute.substring_rows(before, 13)
            assert {d: len(brute.WORD.findall(t or "")) for d, t in after.items()} == {d: w[0] - w[1] for d, w in want.items()}
        elif name != "near_duplicates":
            assert all(before[d] == t for d, t in after.items())
        sizes.append(len(after))
    assert sizes == sorted(sizes, reverse=True)
    assert corpus_pipeline.run(shipped, SF).select("doc_id").distinct().count() == sizes[-1]


def test_pipeline_edges(shipped, docs, empty):
    extra = docs.withColumns({c: F.lit("x") for c in ("row", "score", "kept", "counts", "votes", "posterior", "body")})
    for source in (extra, empty):
        rows = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(shipped, rows, SF)
            assert rows.columns == source.columns
        corpus_pipeline.STAGES[-1][1](shipped, rows, SF).count()
