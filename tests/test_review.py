"""Inputs that the fixture tables do not hold: accents, mixed criteria, time layouts, quotes,
null and equal vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedlake.functions.timeparts import parse_ts
from feedlake.operators import profile as P
from feedlake.operators.blocks import knn
from feedlake.operators.categories import categorize, category_counts
from feedlake.operators.filters import fresh, match, two_clock_range
from feedlake.operators.trends import level_trend_pivot
from feedlake.plans.analysis import compare, history_summary
from feedlake.sources.history import history_rows
from feedlake.sources.roles import find_column, resolve_roles


def test_patterns_fold_case_beyond_ascii(spark):
    df = spark.createDataFrame([("Été",), ("hiver",)], "text string")
    assert [r[0] for r in match(df, {"text": "été"}).collect()] == ["Été"]
    assert category_counts(categorize(df.withColumn("row_id", F.lit(1)), categories=["Summer"], rules={"Summer": "été"})).first()["n"] == 1


def test_criteria_of_another_kind_match_nothing(spark):
    df = spark.createDataFrame([("en", 3, dt.date(2024, 1, 2))], "lang string, level int, day date")
    assert match(df, {"lang": 5}).count() == 0
    assert match(df, {"lang": ["en", 5]}).count() == 1
    assert match(df, {"level": ["x"]}).count() == 0
    assert match(df, {"level": [3, "x"]}).count() == 1
    assert match(df, {"level": None}).count() == 0
    assert match(df, {"day": dt.date(2024, 1, 2)}).count() == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-15T10:00:00Z", dt.datetime(2024, 1, 15, 10)),
        ("2024-01-15 10:00:00.123", dt.datetime(2024, 1, 15, 10, 0, 0, 123000)),
        ("2024-01-15T10:00:00+02:00", dt.datetime(2024, 1, 15, 8)),
        ("2024-1-5", dt.datetime(2024, 1, 5)),
        ("1/5/2024", dt.datetime(2024, 1, 5)),
        ("01/05/2024 7:30", dt.datetime(2024, 1, 5, 7, 30)),
        ("2024/01/05 07:30:01", dt.datetime(2024, 1, 5, 7, 30, 1)),
        ("10:00:00", None),
        ("soon", None),
        ("", None),
    ],
)
def test_time_layouts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_ts(F.col("t"), "string").alias("ts")).first()["ts"] == want


def test_compare_reads_text_times(spark):
    rows = [(1, "2024-01-02", 3, "a"), (2, "bad", 1, "b"), (3, "2024-02-03T00:00:00Z", 5, "c")]
    df = spark.createDataFrame(rows, "row_id long, date string, level int, text string")
    row = compare(df, "2024-01-01", "2024-01-31", "2024-02-01", "2024-02-28")["comparison"].first()
    assert (row["n_p1"], row["n_p2"]) == (1, 1)
    with pytest.raises(ValueError, match="first period"):
        compare(df, "2020-01-01", "2020-01-31", "2024-02-01", "2024-02-28")


def test_names_with_quotes(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "row_id long, `customer's score` double, `it's` string")
    assert P.profile_numeric(df, exclude=["row_id"]).first()["column_name"] == "customer's score"
    assert P.profile_numeric(df, exclude=["row_id"], approx=True).first()["n_distinct"] == 1
    assert P.profile_strings(df, exclude=["row_id"]).first()["column_name"] == "it's"
    tagged = categorize(spark.createDataFrame([(1, "slow")], "row_id long, text string"), categories=["Won't load"], rules={"Won't load": "slow"})
    assert category_counts(tagged).first()["category"] == "Won't load"


def test_knn_skips_null_vectors_and_breaks_ties_by_id(spark):
    corpus = spark.createDataFrame([(i, None if i == 4 else [0.1 * (i % 2), 0.7, 0.3]) for i in range(40)], "row_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [0.1, 0.7, 0.3]), (1, None)], "query_id long, embedding array<double>")
    for limit in (4096, 0):
        hits = knn(queries, corpus.repartition(7), k=5, max_broadcast_queries=limit, rows_per_block=8).orderBy("rank").collect()
        assert [(h["query_id"], h["row_id"]) for h in hits] == [(0, i) for i in (1, 3, 5, 7, 9)]


def test_pivot_counts_add_up(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), v) for v in (1, 2, 2, 5, None)], "ts timestamp_ntz, level int")
    row = level_trend_pivot(df, [1, 2]).first()
    assert (row["level_1"], row["level_2"], row["other_levels"]) == (1, 2, 1)


def test_fresh_keeps_the_future_unless_asked(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 9, 10, 12)], "ts timestamp_ntz")
    assert fresh(df, "ts", "2024-01-10 00:00:00").count() == 3
    assert fresh(df, "ts", "2024-01-10 00:00:00", drop_future=True).count() == 2


def test_history_summary_counts_all_rows(spark):
    df = spark.range(1200).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(2).alias("level"))
    found = history_summary(history_rows(df, "2024-01-05 00:00:00"), "2024-01-01", "2024-01-31", limit=10)
    assert found["count"].first()["n"] == 1200 and found["shown"].count() == 10


def test_two_clock_range_is_pushed_down(spark, tmp_path):
    df = spark.createDataFrame([(None, dt.datetime(2024, 1, 5)), (dt.datetime(2024, 3, 1), dt.datetime(2024, 1, 5))], "ts timestamp_ntz, stored_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "h"))
    out = two_clock_range(spark.read.parquet(str(tmp_path / "h")), "2024-01-01", "2024-01-31")
    assert out.count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def test_roles_prefer_exact_names(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-01", "x")], "Text string, LEVEL int, Created string, time string")
    roles = resolve_roles(df)
    assert (roles.text, roles.level, roles.timestamp) == ("Text", "LEVEL", "time")
    with pytest.raises(ValueError, match="no column 'nope'"):
        find_column(df, "nope")


def test_copied_queries_get_their_first_copy(spark):
    from feedlake.operators.blocks import best_earlier_match

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    got = {r["query_id"]: (r["match_id"], round(r["similarity"], 3)) for r in best_earlier_match(df, 0.5).collect()}
    assert got == {2: (1, 1.0), 3: (1, 0.994), 7: (3, 1.0)}
