"""License scan: one Aho-Corasick pass finds notice phrases and identifier tags, and a
shunting-yard parser evaluates the licence expression after a tag.

A text is lower-cased (A-Z only) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A phrase is
found wherever its words stand one after the other, whatever stands between them, so
``CC-BY`` and ``cc by`` are the same phrase.  All phrases and tags are found in one pass over the
words of the text.

An expression holds licence identifiers, ``with``, ``and``, ``or`` (binding in this order, strongest
first) and parentheses, and ends with its line or where the grammar cannot go on.  Its value is
what binds the user: of ``or`` the side that restricts less (the left one if equal), of ``and``
both, and an exception after ``with`` eases its licence.  After the tag of a file header an unknown identifier
counts as ``other``; after a tag of running prose it ends the expression.

``score`` is how much the text restricts its use: the largest restriction of its notices and
expressions, 0 without any.

Null texts are empty: no words, no places, empty label lists, score 0.  Rows are judged one by one, so
repeated rows and ids are reported as often as they occur, a null id stays null, and columns
besides id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column, text_bytes, text_slices, worker_state, words

# Phrases that the base columns report, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notice phrases of this operator, with their labels.
NOTICES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "apache software license": "apache",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "no rights reserved": "cc0",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "the unlicense": "unlicense",
}

# Words before a licence expression, and whether an unknown identifier counts there.
TAGS = {
    "spdx license identifier": True,
    "license expression": True,
    "dual licensed under": False,
    "licensed under": False,
    "released under": False,
}

# How much a licence restricts the use of a text, by label; an identifier has the label that is
# its longest beginning, ending before a hyphen or at its end.
RESTRICTION = {
    "0bsd": 0.05,
    "agpl": 0.8,
    "apache": 0.15,
    "bsd": 0.1,
    "bsl": 0.1,
    "cc-by": 0.2,
    "cc-by-nc": 0.85,
    "cc-by-nc-nd": 0.95,
    "cc-by-nc-sa": 0.9,
    "cc-by-nd": 0.9,
    "cc-by-sa": 0.5,
    "cc0": 0.05,
    "epl": 0.4,
    "gpl": 0.7,
    "isc": 0.1,
    "lgpl": 0.5,
    "mit": 0.1,
    "mpl": 0.4,
    "other": 0.6,
    "public-domain": 0.05,
    "reserved": 1.0,
    "unlicense": 0.05,
    "zlib": 0.1,
}
EXCEPTION_EASE = 0.75

STRENGTH = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+-]*")
_SPACES = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _SPACES[_low : _high + 1] = np.arange(_low, _high + 1)
_SPACES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_NORMAL = _SPACES.tobytes()
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

PLACE = pa.struct([("phrase", pa.string()), ("word", pa.int64())])
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, places array<struct<phrase:string,word:long>>"
)


class Value(NamedTuple):
    """What an expression asks of a user."""

    restriction: float
    labels: frozenset


def identifier_label(name: str) -> str | None:
    """Label of a licence identifier (``gpl-3.0-only``: gpl); None if it is not known."""
    while name:
        if name in RESTRICTION:
            return name
        name = name.rpartition("-")[0]
    return None


def _apply(operator: str, left: Value, right: Value) -> Value:
    if operator == "with":
        return Value(left.restriction * EXCEPTION_EASE, left.labels)
    if operator == "and":
        return Value(max(left.restriction, right.restriction), left.labels | right.labels)
    return right if right.restriction < left.restriction else left


def evaluate(expression: bytes, strict: bool) -> Value | None:
    """Value of the longest expression at the start of a lower-case line, by Dijkstra's shunting
    yard: values wait on one stack, operators and open parentheses on another.  Operators without
    a right side are left out and open parentheses closed at the end; None without an operand.
    ``strict``: unknown identifiers count as ``other``."""
    values: list[Value] = []
    waiting: list[str] = []

    def reduce_to(strength: int) -> None:
        while waiting and waiting[-1] != "(" and STRENGTH[waiting[-1]] >= strength:
            right, operator = values.pop(), waiting.pop()
            values.append(_apply(operator, values.pop(), right))

    operand_next = True
    for token in _TOKEN.finditer(expression):
        word = token[0].decode().rstrip(".")
        if operand_next:
            if word == "(":
                waiting.append(word)
            elif word == "the" and not values and not waiting:
                continue
            elif waiting and waiting[-1] == "with":
                values.append(Value(0.0, frozenset()))  # the name of an exception
                operand_next = False
            else:
                label = None if word in STRENGTH or word == ")" else identifier_label(word)
                if label is None:
                    if not strict or word in STRENGTH or word == ")":
                        break
                    label = "other"
                values.append(Value(RESTRICTION[label], frozenset([label])))
                operand_next = False
        elif word == ")" and "(" in waiting:
            reduce_to(0)
            waiting.pop()
        elif word in STRENGTH:
            reduce_to(STRENGTH[word])
            waiting.append(word)
            operand_next = True
        else:
            break
    while waiting and operand_next:  # what still waits for a right side
        operand_next = waiting.pop() == "("
    while waiting:
        reduce_to(0)
        if waiting:
            waiting.pop()
    return values[0] if values else None


def automaton() -> ahocorasick.Automaton:
    """Finds every phrase and tag between the single spaces of a normalised text."""
    found = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, **TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


class Scan(NamedTuple):
    n_words: int
    places: list[tuple[str, int]]
    values: list[Value]


def scan(text: bytes, finder: ahocorasick.Automaton) -> Scan:
    """Words, places of phrases in text order, and values of expressions of one text."""
    parts = text.translate(_NORMAL).split()
    plain = (b" " + b" ".join(parts) + b" ").decode("latin-1")
    places, values, word, at = [], [], 0, 0
    ends = low = None
    hits = sorted((end - len(phrase) - 1, phrase) for end, phrase in finder.iter(plain))
    for begin, phrase in hits:
        word += plain.count(" ", at, begin)  # words are counted once, from hit to hit
        at = begin
        if phrase in NOTICES or phrase in BASE:
            places.append((phrase, word))
        if phrase in TAGS:
            if ends is None:
                flat = np.frombuffer(text.translate(_NORMAL), np.uint8)
                ends, low = words(flat, np.array([0, len(flat)])).end, text.translate(_LOWER)
            after = int(ends[word + phrase.count(" ")])
            line = low.find(b"\n", after)
            value = evaluate(low[after : line if line >= 0 else len(low)], TAGS[phrase])
            if value is not None:
                values.append(value)
    return Scan(len(parts), places, values)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its words, the places of base phrases (``n_base``, ``first_word``,
    ``last_word``, ``base_labels``), all ``labels``, the ``score``, and ``places`` of every phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = worker_state("licenses", automaton)
        for batch in text_slices(batches):
            flat, offsets = text_bytes(column(batch, "text"))
            data = flat.tobytes()
            rows = [summary(scan(data[a:b], finder)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(PLACE)]
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["doc_id", *(f.split()[0] for f in SCHEMA.split(", ")[1:])]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *arrays], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def summary(found: Scan) -> tuple:
    """The columns after ``doc_id``."""
    base = [(phrase, word) for phrase, word in found.places if phrase in BASE]
    base_labels = {BASE[phrase] for phrase, _ in base}
    labels = base_labels | {NOTICES[phrase] for phrase, _ in found.places if phrase in NOTICES}
    score = max([0.0, *(RESTRICTION[x] for x in labels), *(v.restriction for v in found.values)])
    labels = labels.union(*(v.labels for v in found.values))
    return (
        found.n_words,
        len(base),
        min((word for _, word in base), default=None),
        max((word for _, word in base), default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        score,
        [{"phrase": phrase, "word": word} for phrase, word in found.places],
    )
