"""Trend and comparison edge cases."""

import datetime as dt

import pytest

from feedlake.operators import trends as T
from feedlake.operators.profile import level_distribution


def frame(spark, rows, with_level=True):
    if with_level:
        return spark.createDataFrame(rows, "row_id long, level int, ts timestamp_ntz")
    return spark.createDataFrame([(r[0], r[2]) for r in rows], "row_id long, ts timestamp_ntz")


def test_gap_between_observed_periods(spark):
    rows = [(1, 2, dt.datetime(2024, 1, 5)), (2, 4, dt.datetime(2024, 4, 2))]
    tr = T.trend(frame(spark, rows), "month").select("period_start", "period", "n", "avg_level")
    last = T.latest_change(tr).collect()
    assert len(last) == 1 and last[0].previous_period == "2024-01" and last[0].period == "2024-04"
    assert last[0].direction == "Improvement"


def test_one_period_gives_nothing(spark):
    rows = [(1, 2, dt.datetime(2024, 1, 5)), (2, 4, dt.datetime(2024, 1, 9))]
    tr = T.trend(frame(spark, rows), "month").select("period_start", "period", "n", "avg_level")
    assert T.latest_change(tr).count() == 0


def test_week_label_and_unknown_unit(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 3, 12))]
    wk = T.trend(frame(spark, rows), "week").first()
    assert wk.period == "2024-01-01/2024-01-07"
    assert T.trend(frame(spark, rows), "fortnight").first().period == "2024-01"
    assert T.trend(frame(spark, rows), "quarter").first().period == "2024Q1"


def test_null_level_and_no_level(spark):
    rows = [(1, None, dt.datetime(2024, 1, 5)), (2, 3, dt.datetime(2024, 1, 6)), (3, None, None)]
    tr = T.trend(frame(spark, rows), "month").first()
    assert tr.n == 2 and tr.avg_level == 3.0
    no_level = T.trend(frame(spark, rows, with_level=False), "month", level=None).first()
    assert no_level.n == 2 and "avg_level" not in no_level.asDict()
    assert [tuple(r) for r in level_distribution(frame(spark, rows)).collect()] == [(3, 1)]


def test_overlapping_and_empty_periods(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 5)), (2, 5, dt.datetime(2024, 1, 20)), (3, None, dt.datetime(2024, 1, 25))]
    df = frame(spark, rows)
    c = T.compare_periods(df, ("2024-01-01", "2024-01-21"), ("2024-01-15", "2024-01-31")).first()
    assert (c.n_p1, c.n_p2) == (2, 2)
    assert c.avg_level_p1 == 3.0 and c.avg_level_p2 == 5.0 and c.direction == "Improvement"
    share = {(r.period, r.level): r.pct for r in T.compare_level_share(df, ("2024-01-01", "2024-01-21"), ("2024-01-15", "2024-01-31")).collect()}
    # the null level counts in period 2's total
    assert share[("p2", 5)] == pytest.approx(50.0)
    empty = T.compare_periods(df, ("2023-01-01", "2023-01-31"), ("2024-01-01", "2024-01-31")).first()
    assert empty.n_p1 == 0 and empty.volume_change_pct == 0.0


def test_profile_without_string_or_numeric_columns(spark):
    from feedlake.operators import profile as P

    nums = spark.createDataFrame([(1, 2.0), (2, None)], "row_id long, x double")
    assert P.profile_strings(nums, exclude=["row_id"]).count() == 0
    assert P.profile_top_values(nums, exclude=["row_id"]).count() == 0
    assert P.profile_samples(nums, "row_id", exclude=["row_id"]).count() == 0
    got = P.profile_numeric(nums, exclude=["row_id"]).first()
    assert (got.n_non_null, got.pct_non_null, got.n_distinct) == (1, 50.0, 1)
    approx = P.profile_numeric(nums, exclude=["row_id"], approx=True).first()
    assert approx.n_distinct == 1
    strs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "row_id long, s string")
    assert P.profile_numeric(strs, exclude=["row_id"]).count() == 0
    exact = P.profile_strings(strs, exclude=["row_id"]).first()
    est = P.profile_strings(strs, exclude=["row_id"], approx=True).first()
    assert (exact.n_non_null, exact.n_distinct) == (3, 2) and (est.n_non_null, est.n_distinct) == (3, 2)
