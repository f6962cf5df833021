"""Normalisation, hashing, blank test and shortening on hand-written strings."""

import hashlib
import re

from feedlake.functions.text import content_hash, is_non_blank, normalize_text, shorten

# a plain-Python statement of the normalisation, used as the differential reference
def py_normalize(text):
    if not text:
        return ""
    t = text.lower()
    t = re.sub(r"\s+", " ", t).strip()
    t = re.sub(r"[^\w\s]", "", t)
    return re.sub(r"\s+", " ", t).strip()


def py_hash(text):
    return hashlib.sha256(py_normalize(text).encode("utf-8")).hexdigest()[:16]


EDGE = [
    "Slow!", "slow", " SLOW?? ", "!!!", "...", "",
    "שָׁלוֹם עוֹלָם", "नमस्ते दुनिया", "x² + y³ = z⁴", "ΟΔΟΣ ΣΟΦΟΣ", "İstanbul DİKKAT",
    "line\u0085next", "a\x1cb\x1dc", "emoji 😀 ok", "snake_case_word", "tab\tand\nnewline  spaces",
    "naïve café", "a.c", "Hello,   World!!", "  mixed nbsp  ", "ﬁ ligature", "½ half",
]


def test_normalize_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "id int, text string")
    got = {r.id: (r.n, r.h) for r in df.select("id", normalize_text("text").alias("n"), content_hash("text").alias("h")).collect()}
    for i, s in enumerate(EDGE):
        assert got[i] == (py_normalize(s), py_hash(s)), s


def test_case_and_punctuation_share_hash(spark):
    df = spark.createDataFrame([("Slow!",), ("slow",), (" SLOW?? ",), ("!!!",), ("...",), (None,)], "text string")
    hashes = [r.h for r in df.select(content_hash("text").alias("h")).collect()]
    assert len(set(hashes[:3])) == 1
    assert hashes[3] == hashes[4] == hashes[5] == py_hash("")


def test_blank_kinds(spark):
    rows = [(None,), ("",), ("   ",), ("\t",), (" ",), ("​",), ("x",)]
    df = spark.createDataFrame(rows, "text string")
    flags = [r.b for r in df.select(is_non_blank("text").alias("b")).collect()]
    # zero-width space is not whitespace for str.isspace(), so it is not blank
    assert flags == [False, False, False, False, False, True, True]


def test_shorten(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "text string")
    got = [r.s for r in df.select(shorten("text", 3).alias("s")).collect()]
    assert got == ["abc...", "abc", ""]
