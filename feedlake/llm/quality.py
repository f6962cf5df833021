"""Quality by weak supervision.

Rules look at counts of a whole text and vote good, bad or abstain.  Expectation-maximisation
over the votes of the documents that pass the base rules estimates each rule's accuracy and the
share of good texts among these, and such a document is kept when its posterior probability of being good is at least one half, whatever
single rules say.

The votes of a document form one of at most ``3 ** len(RULES)`` patterns, so all of these enter
the estimate through a table of pattern counts of bounded size.

Texts without words (null, empty, white space) have zero counts.  With no documents the model
is the starting point.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column, gram_codes, mix, text_bytes, text_slices, words, worker_state

REPEAT_WORDS = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_odd_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = _LETTER[0xC0:] = True
_BLANK = bytes([0x20, *range(0x09, 0x0E)])

GOOD, ABSTAIN, BAD = 0, 1, 2
#: name: (numerator, denominator, bad from, good up to); a ratio that is neither abstains, as
#: do rules without a good end: the absence of one kind of junk says little about the others.
RULES = {
    "odd words": ("n_odd_words", "n_words", 0.35, 0.20),
    "repeated words": ("n_repeat_words", "n_words", 0.40, None),
    "symbols": ("n_symbols", "n_words", 0.25, None),
    "repeated lines": ("n_dup_lines", "n_lines", 0.50, None),
    "capitals": ("n_upper", "n_letters", 0.50, None),
    "exclamations": ("n_marks", "n_words", 0.40, None),
    "long words": ("word_chars", "n_words", 16.0, None),
}
#: Starting point and bounds of the estimate: a rule's accuracy, the share of good texts.
START_ACCURACY, START_SHARE = 0.9, 0.85
ACCURACY_BOUNDS, SHARE_BOUNDS = (0.55, 0.98), (0.5, 0.98)


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _line_counts(text: str) -> tuple[int, int]:
    """(lines with a word, such lines equal to an earlier one)."""
    seen, lines, again = set(), 0, 0
    for line in text.split("\n"):
        if line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
            lines += 1
            if line in seen:
                again += 1
            seen.add(line)
    return lines, again


def _repeated(code: np.ndarray, first: np.ndarray, span: int = REPEAT_WORDS) -> np.ndarray:
    """Mask of words inside a ``span``-word window that occurs twice or more in its text."""
    covered = np.zeros(len(code) + 1, np.int32)
    grams = gram_codes(code, span)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(owner[: len(grams)] == owner[span - 1 :][: len(grams)])
    key, of = mix(grams[inside]), owner[inside]
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    same = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + span, -1)
    return np.cumsum(covered[:-1]) > 0


def count_batch(texts: pa.Array) -> dict[str, np.ndarray]:
    flat, offsets = text_bytes(texts)
    w = words(flat, offsets)
    start = flat & 0xC0 != 0x80  # not a continuation byte: one code point
    ink = np.ones(len(flat), bool)
    ink[np.isin(flat, np.frombuffer(_BLANK, np.uint8))] = False
    n_words = np.diff(w.first)
    repeated = np.concatenate([[0], np.cumsum(_repeated(w.code, w.first))]) if len(w.code) else np.zeros(1, np.int64)
    other = np.concatenate([[0], np.cumsum(~_LETTER[flat] & start & ink, dtype=np.int64)])
    upper = np.concatenate([[0], np.cumsum(_UPPER[flat], dtype=np.int64)])
    odd = np.concatenate([[0], np.cumsum((other[w.end] - other[w.start] > 1) | (upper[w.end] - upper[w.start] > 1) | (w.end - w.start == other[w.end] - other[w.start]))])
    lines = np.array([_line_counts(t or "") for t in texts.to_pylist()], np.int64).reshape(-1, 2)
    return {
        "n_words": n_words,
        "word_chars": _per_text(start & ink, offsets),
        "n_symbols": _per_text(_SYMBOL[flat], offsets),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeated[w.first[1:]] - repeated[w.first[:-1]],
        "n_lines": lines[:, 0],
        "n_upper": _per_text(_UPPER[flat], offsets),
        "n_letters": _per_text(_LETTER[flat], offsets),
        "n_marks": _per_text(_MARK[flat], offsets),
        "n_odd_words": odd[w.first[1:]] - odd[w.first[:-1]],
    }


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in a struct ``row`` and the counts of its text in ``counts``."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("body"))
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality", dict)
        for batch in text_slices(batches, "body", limit=2 << 20):
            got = count_batch(column(batch, "body"))
            counts = pa.StructArray.from_arrays([pa.array(got[c].astype(np.int64)) for c in COUNTS], fields=list(kind))
            yield pa.RecordBatch.from_arrays([column(batch, "row"), counts], ["row", "counts"])

    counts = F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS))
    return packed.mapInArrow(run, packed.select("row").withColumn("counts", counts).schema)


def votes(counts: Column) -> Column:
    """One digit per rule, in the order of ``RULES``."""

    def vote(numerator: str, denominator: str, bad: float, good: float | None) -> Column:
        ratio = counts[numerator] / F.greatest(counts[denominator], F.lit(1))
        fine = F.lit(False) if good is None else ratio <= good
        return F.when(ratio >= bad, F.lit(str(BAD))).when(fine, F.lit(str(GOOD))).otherwise(F.lit(str(ABSTAIN)))

    return F.concat(*(vote(*rule) for rule in RULES.values()))


def base_failed(counts: Column, min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > repeat_percent * counts["n_words"])


def estimate(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Posterior probability of a good text for each vote pattern.

    The class of a text is hidden; a rule that does not abstain votes right with its accuracy,
    independently of the others.  Bounds keep a rule from becoming certain or worse than chance,
    so the classes cannot swap; ten pseudo-votes at the starting point steady small corpora.
    """
    names = sorted(patterns)
    if not names:
        return {}
    vote = np.array([[int(v) for v in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    accuracy, share = np.full(vote.shape[1], START_ACCURACY), START_SHARE
    for _ in range(rounds):
        good = _posterior(vote, accuracy, share)
        right = ((vote == GOOD) * (n * good)[:, None] + (vote == BAD) * (n * (1 - good))[:, None]).sum(0)
        cast = ((vote != ABSTAIN) * n[:, None]).sum(0)
        accuracy = np.clip((right + 10 * START_ACCURACY) / (cast + 10), *ACCURACY_BOUNDS)
        share = float(np.clip(((good * n).sum() + 10 * START_SHARE) / (n.sum() + 10), *SHARE_BOUNDS))
    return dict(zip(names, _posterior(vote, accuracy, share).tolist(), strict=True))


def _posterior(vote: np.ndarray, accuracy: np.ndarray, share: float) -> np.ndarray:
    weight = np.log(accuracy / (1 - accuracy))
    odds = np.log(share / (1 - share)) + ((vote == GOOD) * weight).sum(1) - ((vote == BAD) * weight).sum(1)
    return 1 / (1 + np.exp(-odds))


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``counts``, ``votes``, ``posterior``, ``base_failed``
    and ``kept``.  Documents that fail the base rules neither vote nor are kept."""
    judged = signals(docs, text_col).withColumn("votes", votes(F.col("counts"))).withColumn("base_failed", base_failed(F.col("counts")))
    tally = judged.filter(~F.col("base_failed")).groupBy("votes").count()
    posterior = estimate({r["votes"]: r["count"] for r in tally.collect()})  # at most 3 ** rules rows
    spark = docs.sparkSession
    model = spark.createDataFrame(list(posterior.items()), "votes string, posterior double")
    return judged.join(F.broadcast(model), "votes", "left").withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= 0.5))


def quality(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept)`` and the posterior of every document."""
    j = judge(docs.select("doc_id", "text"))
    return j.select("row.doc_id", *(f"counts.{c}" for c in COUNTS[:5]), "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all their columns."""
    return judge(docs).filter("kept").select("row.*")
