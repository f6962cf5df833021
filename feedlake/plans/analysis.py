"""The analysis questions answered as compositions of operators.

Each function takes DataFrames (the current table, the history table, a vector table) and
returns named DataFrames; nothing is narrated and nothing is collected here except where a
function must refuse (an empty period, too few rows), which costs one bounded check.
Level parameters: ``eq`` (exact level), ``at_most`` and ``at_least``; in the exclusive form
the first one given wins.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import shorten
from feedlake.functions.timeparts import parse_ts
from feedlake.operators import profile as P
from feedlake.operators import trends as T
from feedlake.operators.categories import categorize, category_counts, category_entries
from feedlake.operators.clusters import cluster_samples, cluster_sizes, cluster_summary, density_clusters
from feedlake.operators.encode import Encoder, encode
from feedlake.operators.filters import between_dates, first_rows, level_bounds, match, non_blank, two_clock_range
from feedlake.operators.search import reference_row, search
from feedlake.sources.history import read_history
from feedlake.sources.reports import ensure_csv_suffix, report_name, write_category_report, write_report
from feedlake.sources.roles import canonical, project, resolve_roles


@dataclass
class Result:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    files: list[str] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _canon(df: DataFrame) -> DataFrame:
    """``text, level, ts`` aliases first (absent roles stay absent), other columns after."""
    return canonical(df, resolve_roles(df))


def feedback_by_level(df: DataFrame, level: int, sample: int = 10) -> Result:
    c = _canon(df)
    if "level" not in c.columns:
        raise ValueError("no level column found")
    rows = c.filter(F.col("level") == F.lit(level))
    order = "row_id" if "row_id" in c.columns else "text"
    return Result({"rows": rows, "count": rows.agg(F.count(F.lit(1)).alias("n")), "sample": first_rows(rows, sample, order)})


def statistics(df: DataFrame, order: str = "row_id", approx: bool = False) -> Result:
    """Profile of the table; ``approx=True`` estimates distinct counts (HyperLogLog++) for
    very large tables."""
    c = _canon(df)
    roles = ["text", "level", "ts", order]
    out = {"shape": P.table_shape(df)}
    if "level" in c.columns:
        out["level_distribution"] = P.level_distribution(c)
        out["level_summary"] = P.level_summary(c)
    if "text" in c.columns:
        out["text_summary"] = P.text_summary(c)
    if "ts" in c.columns:
        out["time_coverage"] = P.time_coverage(c)
    out["numeric"] = P.profile_numeric(c, exclude=roles, approx=approx)
    if any(t == "string" for n, t in c.dtypes if n not in roles):
        out["strings"] = P.profile_strings(c, exclude=roles, approx=approx)
        out["top_values"] = P.profile_top_values(c, exclude=roles)
        if order in c.columns:
            out["samples"] = P.profile_samples(c, order, exclude=roles)
    return Result(out)


def filtered_report(df: DataFrame, criteria: dict, columns: list[str] | None = None, folder: str | None = None, output_name: str | None = None, today: _dt.date | None = None) -> Result:
    rows = project(match(df, criteria), columns)
    res = Result({"rows": rows})
    if folder:
        name = ensure_csv_suffix(output_name) if output_name else report_name(criteria, today)
        path = f"{folder.rstrip('/')}/{name}"
        if write_report(rows, path):
            res.files.append(path)
    return res


def semantic_search(
    corpus: DataFrame,
    query: str | None = None,
    reference_text: str | None = None,
    reference_index: int | None = None,
    top_k: int = 10,
    eq=None,
    at_most=None,
    at_least=None,
    filter_by_level: bool = False,
    similarity_threshold: float = 0.3,
    metric: str = "cosine",
    encoder: Encoder | None = None,
    post_filter: bool = False,
) -> Result:
    """Hits for a query text, a reference text or a reference row of ``corpus``
    (``row_id, text, level, embedding``).  The index wins over the reference text, which
    wins over the query.  A reference text is replaced by the stored text of its nearest
    row; a reference row is left out of its own hits."""
    spark = corpus.sparkSession
    bounds = dict(eq=eq, at_most=at_most, at_least=at_least) if filter_by_level else {}
    exclude_self, exclude_ids = False, None
    if reference_index is not None:
        ref = reference_row(corpus, reference_index)
        queries = ref.select(F.col("row_id").alias("query_id"), "embedding")
        # the reference row leaves its own hits: before ranking (k hits remain), or with
        # ``post_filter`` after it (k - 1 remain)
        if post_filter:
            exclude_ids = ref.select("row_id")
        else:
            exclude_self = True
    else:
        text = reference_text if reference_text is not None else query
        if text is None:
            raise ValueError("give a query, a reference text or a reference index")
        q = encode(spark.createDataFrame([(0, text)], "query_id long, text string"), "text", "embedding", encoder).select("query_id", "embedding")
        if reference_text is not None:
            nearest = search(q, corpus, k=1, threshold=None, metric=metric).select(F.col("row_id"))
            queries = corpus.join(nearest, "row_id", "left_semi").select(F.col("row_id").alias("query_id"), "embedding")
        else:
            queries = q
    hits = search(
        queries, corpus, k=top_k, threshold=similarity_threshold, metric=metric, post_filter=post_filter,
        exclude_ids=exclude_ids, exclude_self=exclude_self, **bounds,
    )
    # one query, so at most ``top_k`` hits: a proven bound, broadcast them to pick up texts
    # without shuffling the corpus
    shown = corpus.select("row_id", shorten("text", 300).alias("text")).join(F.broadcast(hits), "row_id")
    return Result({"hits": shown})


def themes(
    df: DataFrame,
    use_clustering: bool = False,
    eq=None,
    at_most=None,
    at_least=None,
    filter_by_level: bool = False,
    min_cluster_size: int = 3,
    eps: float = 0.4,
    vectors: DataFrame | None = None,
    encoder: Encoder | None = None,
) -> Result:
    """Clusters of the (optionally level-filtered) non-blank rows, or a review sample.
    ``vectors`` may supply ``(row_id, embedding)``; otherwise texts are encoded."""
    c = _canon(df)
    if filter_by_level and "level" in c.columns:
        c = level_bounds(c, eq, at_most, at_least)
    rows = non_blank(c)
    if not use_clustering:
        return Result({"count": rows.agg(F.count(F.lit(1)).alias("n")), "sample": first_rows(rows.select("row_id", "text", *(["level"] if "level" in c.columns else [])), 30)})
    n = rows.limit(min_cluster_size).count()
    if n < min_cluster_size:
        raise ValueError(f"clusters of {min_cluster_size} rows cannot form from {n}")
    vec = vectors.join(rows.select("row_id"), "row_id", "left_semi") if vectors is not None else encode(rows.select("row_id", "text"), "text", "embedding", encoder)
    labels = density_clusters(vec.select("row_id", "embedding"), eps=eps, min_size=min_cluster_size).checkpoint()
    shown = rows.select("row_id", shorten("text", 200).alias("text"), *(["level"] if "level" in c.columns else []))
    return Result({"labels": labels, "summary": cluster_summary(labels), "sizes": cluster_sizes(labels), "samples": cluster_samples(labels, shown)})


def category_report(
    df: DataFrame,
    eq=None,
    at_most=None,
    at_least=None,
    categories: list[str] | None = None,
    rules: dict[str, str] | None = None,
    assignments: DataFrame | None = None,
    folder: str | None = None,
    today: _dt.date | None = None,
) -> Result:
    c = _canon(df)
    if "text" not in c.columns:
        raise ValueError("no text column found")
    if "level" in c.columns:
        c = level_bounds(c, eq, at_most, at_least)
    tagged = categorize(non_blank(c), categories, rules, assignments)
    res = Result({"rows": tagged, "counts": category_counts(tagged), "entries": category_entries(tagged)})
    if folder:
        bounds = {"level": eq, "level to": at_most, "level from": at_least}
        given = next(({k: v} for k, v in bounds.items() if v is not None), {})
        path = f"{folder.rstrip('/')}/{report_name(given, today, kind='categories')}"
        if write_category_report(tagged, path):
            res.files.append(path)
    return res


def history_summary(hist: DataFrame, start: str | None = None, end: str | None = None, level: int | None = None, limit: int | None = None) -> Result:
    """Statistics of all matching rows; ``limit`` bounds only the ``shown`` ones."""
    rows = read_history(hist, start, end, level)
    return Result(
        {
            "rows": rows,
            "shown": rows.limit(limit) if limit else rows,
            "count": rows.agg(F.count(F.lit(1)).alias("n")),
            "level_distribution": P.level_distribution(rows),
            "level_summary": P.level_summary(rows),
            "time_coverage": P.time_coverage(rows),
            "samples": rows.limit(5),
        }
    )


def trends(df: DataFrame, start: str | None = None, end: str | None = None, period: str = "month", compare: bool = False) -> Result:
    c = _canon(df)
    if "ts" not in c.columns:
        raise ValueError("no timestamp/date column found")
    c = between_dates(c.withColumn("ts", parse_ts(F.col("ts"), dict(c.dtypes)["ts"])), start, end)
    level = "level" if "level" in c.columns else None
    tr = T.trend(c, period, level=level)
    out = {"trend": tr}
    if level:
        out["level_trend"] = T.level_trend_long(c, period)
        if compare:
            out["latest_change"] = T.latest_change(tr.select("period_start", "period", "n", "avg_level"))
    return Result(out)


def compare(df: DataFrame, p1_start: str, p1_end: str, p2_start: str, p2_end: str) -> Result:
    c = _canon(df)
    if "ts" not in c.columns:
        raise ValueError("no timestamp/date column found")
    c = c.withColumn("ts", parse_ts(F.col("ts"), dict(c.dtypes)["ts"]))
    level = "level" if "level" in c.columns else None
    p1, p2 = (p1_start, p1_end), (p2_start, p2_end)
    cmp = T.compare_periods(c, p1, p2, level=level)
    first = cmp.select("n_p1", "n_p2").first()
    if first.n_p1 == 0:
        raise ValueError(f"the first period, {p1_start} to {p1_end}, holds no rows")
    if first.n_p2 == 0:
        raise ValueError(f"the second period, {p2_start} to {p2_end}, holds no rows")
    order = "row_id" if "row_id" in c.columns else "ts"
    out = {"comparison": cmp, "samples_p1": T.period_samples(c, *p1, order=order), "samples_p2": T.period_samples(c, *p2, order=order)}
    if level:
        out["level_share"] = T.compare_level_share(c, p1, p2)
    return Result(out)


def _stored(hist: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The history rows that a date range may need, as records; no sort and no hidden limit."""
    return two_clock_range(hist, start, end, "ts", "stored_at").select("text", "level", "ts")


def trends_of_history(hist: DataFrame, start: str | None = None, end: str | None = None, period: str = "month", compare: bool = False) -> Result:
    """``trends`` over the long-term table instead of the current one."""
    return trends(_stored(hist, start, end), start, end, period, compare)


def compare_of_history(hist: DataFrame, p1_start: str, p1_end: str, p2_start: str, p2_end: str) -> Result:
    """``compare`` over the long-term table; only rows between the first and the last date are read."""
    dates = (p1_start, p1_end, p2_start, p2_end)
    return compare(_stored(hist, min(dates), max(dates)), *dates)
