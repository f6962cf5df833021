"""The fit reads its rows part by part: the same model, and little memory besides the buckets."""

import tracemalloc

import numpy as np

from feedlake.llm import toxicity


def rows(texts, per_text):
    rng = np.random.default_rng(2)
    label = (rng.random(texts) < 0.4).astype(np.int64)
    bucket = [np.unique(rng.integers(0, 1 << toxicity.BITS, per_text) // (1 + 3 * k)).astype(np.int32) for k in label]
    return bucket, label


def test_parts_give_the_model_of_all_rows():
    bucket, label = rows(60, 3000)
    bucket = [np.unique(b // 512) for b in bucket]
    sizes = np.array([len(b) for b in bucket])
    whole = toxicity.fit(np.repeat(np.arange(60), sizes), np.concatenate(bucket), label)
    parts = toxicity.fit_parts([(sizes[i : i + 7], np.concatenate(bucket[i : i + 7])) for i in range(0, 60, 7)], label)
    assert len(whole.bucket) and np.array_equal(whole.bucket, parts.bucket) and np.array_equal(whole.weight, parts.weight) and whole.intercept == parts.intercept


def test_memory_is_bounded_by_a_part(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 100)
    bucket, label = rows(1500, 4000)
    parts = [(np.array([len(b)]), b) for b in bucket]
    tracemalloc.start()
    toxicity.fit_parts(parts, label)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    fixed = 12 * 8 * (1 << toxicity.BITS)  # tables of all buckets
    assert peak < fixed + 2 * 4 * sum(map(len, bucket)), peak
