"""Role, filter, projection and text-function queries over the ``feedback`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.text import content_hash, normalize_text, shorten, snippet, text_length
from feedlake.operators import filters as B
from feedlake.plans.catalog.views import FEEDBACK, NON_SPACE_SQL, hash_sql, norm_sql
from feedlake.plans.registry import register
from feedlake.sources.roles import canonical, project, resolve_roles
from feedlake.sources.tables import feedback, table


@register("resolve_roles_projection", f"select row_id, text, level, ts from {FEEDBACK} f", "A2 B8")
def resolve_roles_projection(spark, sf_dir):
    df = feedback(spark, sf_dir)
    return project(canonical(df, resolve_roles(df)), ["ROW_ID", "Text", "Level", "TS"])


@register("filter_level_eq", f"select * from {FEEDBACK} f where level = 3", "B1")
def filter_level_eq(spark, sf_dir):
    return B.by_level(feedback(spark, sf_dir), 3)


@register("filter_level_at_most", f"select * from {FEEDBACK} f where level <= 2", "B2")
def filter_level_at_most(spark, sf_dir):
    # at_most is given before at_least, so it wins (exclusive form)
    return B.level_bounds(feedback(spark, sf_dir), at_most=2, at_least=4)


@register("filter_level_at_least", f"select * from {FEEDBACK} f where level >= 4", "B2")
def filter_level_at_least(spark, sf_dir):
    return B.level_bounds(feedback(spark, sf_dir), at_least=4)


@register("filter_level_sample", f"select * from {FEEDBACK} f where level = 5 order by row_id limit 10", "B1 F4")
def filter_level_sample(spark, sf_dir):
    return B.first_rows(B.by_level(feedback(spark, sf_dir), 5), 10)


@register("filter_in_list", f"select * from {FEEDBACK} f where lang in ('fr', 'de')", "B4 B7")
def filter_in_list(spark, sf_dir):
    return B.match(feedback(spark, sf_dir), {"LANG": ["fr", "de"]})


@register("filter_regex", f"select * from {FEEDBACK} f where regexp_matches(text, 'th.n', 'i')", "B5")
def filter_regex(spark, sf_dir):
    return B.match(feedback(spark, sf_dir), {"Text": "th.n"})


@register(
    "filter_conjunction",
    f"select row_id, level, lang from {FEEDBACK} f "
    "where regexp_matches(cast(lang as varchar), 'EN', 'i') and level = 5 and source in ('src1', 'src2', 'src3', 'src14')",
    "B4 B5 B6 B7 B8",
)
def filter_conjunction(spark, sf_dir):
    df = B.match(feedback(spark, sf_dir), {"lang": "EN", "LEVEL": 5, "Source": ["src1", "src2", "src3", "src14"]})
    return project(df, ["row_id", "level", "lang"])


@register("non_blank_rows", f"select doc_id from documents where regexp_matches(text, {NON_SPACE_SQL})", "B12")
def non_blank_rows(spark, sf_dir):
    return B.non_blank(table(spark, sf_dir, "documents")).select("doc_id")


@register(
    "date_range_inclusive",
    f"select row_id, ts from {FEEDBACK} f where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-20'",
    "B9",
)
def date_range_inclusive(spark, sf_dir):
    return B.between_dates(feedback(spark, sf_dir), "2024-01-10", "2024-01-20").select("row_id", "ts")


@register(
    "date_range_whole_days",
    f"select row_id, ts from {FEEDBACK} f where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-21'",
    "B9",
)
def date_range_whole_days(spark, sf_dir):
    return B.between_dates(feedback(spark, sf_dir), "2024-01-10", "2024-01-20", end_of_day=True).select("row_id", "ts")


@register(
    "normalized_hash",
    f"select doc_id, length({norm_sql('text')}) as n_norm_chars, {hash_sql('text')} as text_hash from documents",
    "C1 C2",
)
def normalized_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text_length(normalize_text("text")).alias("n_norm_chars"), content_hash("text").alias("text_hash"))


@register(
    "shorten_text",
    f"""select row_id,
       case when length(coalesce(text, '')) > 300 then substr(text, 1, 300) || '...' else coalesce(text, '') end as short,
       substr(text, 1, 500) as snippet, length(text) as n_chars
from {FEEDBACK} f""",
    "C3 C4 C10",
)
def shorten_text(spark, sf_dir):
    f = feedback(spark, sf_dir)
    return f.select("row_id", shorten("text", 300).alias("short"), snippet("text", 500).alias("snippet"), text_length("text").alias("n_chars"))
