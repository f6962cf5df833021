"""Category tagging: one 0/1 column per category plus a notes column, category counts and
the report form with a summary row."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions.numbers import pct
from feedlake.sources.roles import quoted

# The default category names and the report's column naming.
DEFAULT_CATEGORIES = ["Usability", "Performance", "Support", "Features", "Errors", "Documentation", "Accessibility"]
CATEGORY_PREFIX = "Category_"
NOTES_COLUMN = "Categorization_Notes"
SUMMARY_LABEL = "SUMMARY_TOTAL_COUNTS"


def category_column(name: str) -> str:
    return f"{CATEGORY_PREFIX}{name}"


def categorize(
    df: DataFrame,
    categories: list[str] | None = None,
    rules: dict[str, str] | None = None,
    assignments: DataFrame | None = None,
    text: str = "text",
    id_col: str = "row_id",
) -> DataFrame:
    """Add ``Category_<name>`` (int 0/1) for every category and an empty notes column.

    - ``rules``: category -> regular expression searched case-insensitively in the text;
    - ``assignments``: a table ``(row_id, category)`` from elsewhere (a labelling job), joined
      on the row id (aggregated per row first, so a row listed many times stays one row);
    - neither: all zeros, to be filled by a later step.
    A row may belong to several categories or to none."""
    cats = list(categories or DEFAULT_CATEGORIES)
    rules = rules or {}
    out = df
    if assignments is not None:
        flags = assignments.filter(F.col("category").isin(cats)).groupBy(F.col(id_col)).agg(
            *[F.max((F.col("category") == F.lit(c)).cast("int")).alias(f"__a_{i}") for i, c in enumerate(cats)]
        )
        out = out.join(flags, id_col, "left")
    cols = []
    for i, c in enumerate(cats):
        flag = F.lit(0)
        if c in rules:
            flag = F.coalesce(quoted(text).cast("string").rlike("(?iu)" + rules[c]).cast("int"), F.lit(0))
        if assignments is not None:
            flag = F.greatest(flag, F.coalesce(F.col(f"__a_{i}"), F.lit(0)))
        cols.append(flag.cast("int").alias(category_column(c)))
    keep = [quoted(c) for c in df.columns]
    return out.select(*keep, *cols, F.lit("").alias(NOTES_COLUMN))


def category_names(df: DataFrame) -> list[str]:
    return [c[len(CATEGORY_PREFIX):] for c in df.columns if c.startswith(CATEGORY_PREFIX)]


def category_counts(tagged: DataFrame) -> DataFrame:
    """(category, n, pct): rows tagged with each category and their % of all rows (one pass)."""
    cats = category_names(tagged)
    wide = tagged.agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(quoted(category_column(c))).cast("long").alias(f"n{i}") for i, c in enumerate(cats)])
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"n{i}").alias("n")) for i, c in enumerate(cats)])
    longf = wide.select("__rows", F.inline(each))
    return longf.select("category", "n", pct(F.col("n"), F.col("__rows")).alias("pct"))


def category_entries(tagged: DataFrame) -> DataFrame:
    """One row: rows, and rows with at least one category."""
    cats = [quoted(category_column(c)) for c in category_names(tagged)]
    any_cat = functools.reduce(lambda a, b: F.greatest(a, b), cats) if len(cats) > 1 else cats[0]
    return tagged.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(any_cat == 1).alias("n_entries"))


def with_summary_row(tagged: DataFrame) -> DataFrame:
    """All columns as strings plus one summary row: the label in the first column, the
    category sums in the category columns, '' elsewhere."""
    cats = set(category_column(c) for c in category_names(tagged))
    first = tagged.columns[0]
    body = tagged.select(*[quoted(c).cast("string").alias(c) for c in tagged.columns])
    sums = []
    for c in tagged.columns:
        if c in cats:
            sums.append(F.sum(quoted(c)).cast("long").cast("string").alias(c))
        elif c == first:
            sums.append(F.lit(SUMMARY_LABEL).alias(c))
        else:
            sums.append(F.lit("").alias(c))
    return body.unionByName(tagged.agg(*sums))
