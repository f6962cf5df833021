"""The analysis functions as registered queries: one query per result table, each against the
oracle of the operator that the table comes from."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators.categories import SUMMARY_LABEL
from feedlake.plans import analysis as A
from feedlake.plans.catalog import categories as C
from feedlake.plans.catalog import filters as B  # noqa: F401  (oracles are looked up by name)
from feedlake.plans.catalog import history as H
from feedlake.plans.catalog import profile as E  # noqa: F401
from feedlake.plans.catalog import trends as T
from feedlake.plans.catalog import vectors as V
from feedlake.plans.catalog.views import FEEDBACK, NON_SPACE_SQL, RATED_ORDERS, VECTORS
from feedlake.plans.registry import _REGISTRY, register
from feedlake.session import scratch_path
from feedlake.sources.history import append_new_history, open_history
from feedlake.sources.tables import feedback, rated_orders, table, vectors

CRITERIA = {"lang": "EN", "LEVEL": 5, "Source": ["src1", "src2", "src3", "src14"]}
KEPT = ["row_id", "level", "lang"]


def _as(oracle: str, covers: str, name: str):
    return register(name, _REGISTRY[oracle].oracle, covers)


@_as("filter_level_eq", "2J by level", "analysis_by_level")
def by_level(spark, sf_dir):
    return A.feedback_by_level(feedback(spark, sf_dir), 3)["rows"]


@_as("filter_level_sample", "2J by level", "analysis_by_level_sample")
def by_level_sample(spark, sf_dir):
    return A.feedback_by_level(feedback(spark, sf_dir), 5, sample=10)["sample"]


def _statistics(table: str, oracle: str) -> None:
    @_as(oracle, "2J statistics", f"analysis_statistics_{table}")
    def q(spark, sf_dir):
        return A.statistics(feedback(spark, sf_dir))[table]


for _table, _oracle in (
    ("shape", "table_shape"),
    ("level_distribution", "level_distribution"),
    ("level_summary", "level_summary"),
    ("text_summary", "text_summary"),
    ("time_coverage", "time_coverage"),
    ("strings", "profile_strings"),
    ("top_values", "profile_top_values"),
):
    _statistics(_table, _oracle)


@_as("filter_conjunction", "2J filtered report", "analysis_filtered_report")
def filtered_report(spark, sf_dir):
    return A.filtered_report(feedback(spark, sf_dir), CRITERIA, KEPT)["rows"]


@_as("filter_conjunction", "2J filtered report A6", "analysis_filtered_report_file")
def filtered_report_file(spark, sf_dir):
    """The same rows, written as a CSV report and read back."""
    done = A.filtered_report(feedback(spark, sf_dir), CRITERIA, KEPT, folder=scratch_path(spark, "reports"))
    schema = "row_id long, level int, lang string"
    return spark.read.schema(schema).option("header", True).csv(done.files) if done.files else spark.createDataFrame([], schema)


def _category_report(spark, sf_dir, **options):
    return A.category_report(feedback(spark, sf_dir).select("row_id", "level", "text"), at_most=3, rules=C.RULES, **options)


@_as("category_counts", "2J category report", "analysis_category_counts")
def category_counts(spark, sf_dir):
    return _category_report(spark, sf_dir)["counts"]


@_as("category_entries", "2J category report", "analysis_category_entries")
def category_entries(spark, sf_dir):
    return _category_report(spark, sf_dir)["entries"]


@_as("category_report", "2J category report A7", "analysis_category_report_file")
def category_report_file(spark, sf_dir):
    """The report with its summary row, written as CSV and read back (empty cells are null there)."""
    done = _category_report(spark, sf_dir, folder=scratch_path(spark, "reports"))
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(done.files)
    # the report's label stands in its first column, here the text
    label = F.when(F.col("text") == SUMMARY_LABEL, F.col("text")).otherwise(F.col("row_id"))
    return rows.withColumn("row_id", label).drop("text").na.fill("")


@_as("theme_sample", "2J themes", "analysis_theme_sample")
def theme_sample(spark, sf_dir):
    return A.themes(feedback(spark, sf_dir), filter_by_level=True, at_most=2)["sample"]


def _trends(table: str, oracle: str) -> None:
    @_as(oracle, "2J trends", f"analysis_trends_{table}")
    def q(spark, sf_dir):
        return A.trends(rated_orders(spark, sf_dir), period="month", compare=True)[table]


for _table, _oracle in (("trend", "trend_month"), ("level_trend", "level_trend_long"), ("latest_change", "latest_change")):
    _trends(_table, _oracle)


@_as("compare_periods", "2J compare", "analysis_compare")
def compare_periods(spark, sf_dir):
    return A.compare(rated_orders(spark, sf_dir), *T.P1, *T.P2)["comparison"]


@_as("compare_level_share", "2J compare", "analysis_compare_level_share")
def compare_level_share(spark, sf_dir):
    return A.compare(rated_orders(spark, sf_dir), *T.P1, *T.P2)["level_share"].select("period", "level", "n", F.col("pct"))


# Vectors of rows with a text: what a search by reference row and clustered themes work on.
_TEXT_VECTORS = f"(select * from {VECTORS} where row_id in (select row_id from {FEEDBACK} f where regexp_matches(text, {NON_SPACE_SQL})))"


def _text_as(oracle: str, covers: str, name: str):
    return register(name, _REGISTRY[oracle].oracle.replace(VECTORS, _TEXT_VECTORS), covers)


@_text_as("knn_reference", "2J semantic search", "analysis_search_reference")
def search_reference(spark, sf_dir):
    """Rows like the reference row, found by its index among the rows with a text."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    corpus = vectors(spark, sf_dir).join(texts.filter("text is not null"), "row_id")
    found = A.semantic_search(corpus, reference_index=V.REF_INDEX, top_k=10, similarity_threshold=0.0)
    return found["hits"].select("query_id", "row_id", "level", F.round("similarity", 6).alias("similarity"), "rank")


def _clustered(spark, sf_dir):
    return A.themes(feedback(spark, sf_dir), use_clustering=True, eps=V.EPS, min_cluster_size=3, vectors=vectors(spark, sf_dir).select("row_id", "embedding"))


@_text_as("density_clusters", "2J themes with clusters", "analysis_themes_labels")
def themes_labels(spark, sf_dir):
    return _clustered(spark, sf_dir)["labels"]


@_text_as("cluster_summary", "2J themes with clusters", "analysis_themes_summary")
def themes_summary(spark, sf_dir):
    return _clustered(spark, sf_dir)["summary"]


@_text_as("cluster_sizes", "2J themes with clusters", "analysis_themes_sizes")
def themes_sizes(spark, sf_dir):
    return _clustered(spark, sf_dir)["sizes"]


RANGE = ("2024-01-10", "2024-01-20")
EARLIER, LATER = ("2024-01-05", "2024-01-14"), ("2024-01-12", "2024-01-25")


def _history_table(spark, sf_dir):
    """The feedback rows, loaded twice (the second load adds nothing) into a history table."""
    path = scratch_path(spark, "history")
    for stored_at in ("2024-02-01 00:00:00", "2024-02-02 00:00:00"):
        append_new_history(feedback(spark, sf_dir), path, stored_at)
    return open_history(spark, path)


def _history_sql(oracle: str, where: str = "true") -> str:
    return _REGISTRY[oracle].oracle.replace(RATED_ORDERS, f"(select * from ({H._FIRST_F}) h where {where})")


_IN_RANGE = f"ts >= timestamp '{RANGE[0]}' and ts <= timestamp '{RANGE[1]}'"


@register("history_trends_day", _history_sql("trend_day", _IN_RANGE), "2J trends over history")
def history_trends(spark, sf_dir):
    return A.trends_of_history(_history_table(spark, sf_dir), *RANGE, period="day")["trend"]


@register("history_level_trend", _history_sql("level_trend_long"), "2J trends over history")
def history_level_trend(spark, sf_dir):
    return A.trends_of_history(_history_table(spark, sf_dir), period="month")["level_trend"]


def _dates(sql: str) -> str:
    for old, new in zip((*T.P1, *T.P2), (*EARLIER, *LATER), strict=True):
        sql = sql.replace(old, new)
    return sql


@register("history_compare", _dates(_history_sql("compare_periods")), "2J compare over history")
def history_compare(spark, sf_dir):
    return A.compare_of_history(_history_table(spark, sf_dir), *EARLIER, *LATER)["comparison"]


@register("history_compare_level_share", _dates(_history_sql("compare_level_share")), "2J compare over history")
def history_compare_level_share(spark, sf_dir):
    found = A.compare_of_history(_history_table(spark, sf_dir), *EARLIER, *LATER)
    return found["level_share"].select("period", "level", "n", F.col("pct"))
