"""Text column functions: normalisation, content hash, shortening, blank test.

All are built-in Spark expressions (JVM side, whole-stage codegen); no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as whitespace.  Python's str.isspace() also treats the four
# information separators U+001C..U+001F as space; Java's Unicode \s does not, so they are
# added to every class below.
_SPACE = r"\s\x1c-\x1f"
_SPACE_RUN = rf"(?U)[{_SPACE}]+"
# word characters as Python's Unicode \w sees them: letters, numbers, underscore
# (combining marks are NOT kept, unlike Java's Unicode \w)
_NOT_WORD_OR_SPACE = rf"(?U)[^\p{{L}}\p{{N}}_{_SPACE}]"
_ANY_NON_SPACE = rf"(?U)[^{_SPACE}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c, punctuation: bool = True, whitespace: bool = True) -> Column:
    """Lower-case, collapse whitespace, drop punctuation, collapse again; null -> ''."""
    out = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    # Collapsing whitespace before dropping punctuation and again after it gives the same
    # text as dropping punctuation first and collapsing once (punctuation removal never
    # touches whitespace), so one regex pass is saved.
    if punctuation:
        out = F.regexp_replace(out, _NOT_WORD_OR_SPACE, "")
    if whitespace or punctuation:
        out = F.trim(F.regexp_replace(out, _SPACE_RUN, " "))
    return out


def content_hash(c, normalized: bool = True) -> Column:
    """First 16 hex characters of SHA-256 of the (normalised) UTF-8 text."""
    base = normalize_text(c) if normalized else F.coalesce(_col(c).cast("string"), F.lit(""))
    # never null (the input is coalesced); saying so lets Catalyst drop the not-null filters
    # it would otherwise infer for joins on the hash - and push below a repartition
    return F.coalesce(F.substring(F.sha2(base, 256), 1, 16), F.lit(""))


def shorten(c, n: int) -> Column:
    """First ``n`` characters plus '...' when longer; null -> ''."""
    s = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def snippet(c, n: int = 500) -> Column:
    """First ``n`` characters, no ellipsis (metadata copy of a text)."""
    return F.substring(_col(c).cast("string"), 1, n)


def text_length(c) -> Column:
    """Length in Unicode code points (64-bit, like SQL ``length``)."""
    return F.char_length(_col(c).cast("string")).cast("long")


def is_non_blank(c) -> Column:
    """True when the text has a non-whitespace character; null and blank -> false."""
    return F.coalesce(_col(c).cast("string").rlike(_ANY_NON_SPACE), F.lit(False))


def tokens(c) -> Column:
    """Array of the space-separated words of the normalised text ('' -> empty array)."""
    norm = normalize_text(c)
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))
