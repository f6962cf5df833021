"""Filter semantics: precedence, regex vs literal, nulls, unknown columns, date ends."""

import datetime as dt

import pytest

from feedlake.operators.filters import between_dates, level_bounds, match, two_clock_range
from feedlake.sources.roles import TIMESTAMP_NAMES, project, resolve_roles


@pytest.fixture()
def rows(spark):
    data = [
        (1, "abc", 1, dt.datetime(2024, 1, 31, 0, 0)),
        (2, "a.c", 2, dt.datetime(2024, 1, 31, 10, 0)),
        (3, None, 3, None),
        (4, "AXC", None, dt.datetime(2024, 2, 1, 0, 0)),
    ]
    return spark.createDataFrame(data, "row_id long, text string, level int, ts timestamp_ntz")


def ids(df):
    return sorted(r.row_id for r in df.select("row_id").collect())


def test_level_precedence(rows):
    assert ids(level_bounds(rows, eq=3, at_most=1)) == [3]
    assert ids(level_bounds(rows, at_most=1, at_least=3)) == [1]
    assert ids(level_bounds(rows, at_least=2, at_most=2, conjunctive=True)) == [2]
    assert ids(level_bounds(rows, at_least=2, conjunctive=True, keep_missing=True)) == [2, 3, 4]


def test_regex_and_literal(rows):
    assert ids(match(rows, {"TEXT": "a.c"})) == [1, 2, 4]
    assert ids(match(rows, {"text": "a.c"}, literal=True)) == [2]
    # null cells never match a pattern
    assert 3 not in ids(match(rows, {"text": "a"}))


def test_list_and_scalar(rows):
    assert ids(match(rows, {"level": [1, 3]})) == [1, 3]
    assert ids(match(rows, {"Level": 2, "text": "a"})) == [2]


def test_unknown_column(rows):
    with pytest.raises(ValueError, match="nope"):
        match(rows, {"nope": 1})
    with pytest.raises(ValueError, match="nope"):
        project(rows, ["row_id", "nope"])


def test_project_order_case(rows):
    assert project(rows, ["LEVEL", "Row_Id"]).columns == ["level", "row_id"]


def test_end_date_is_midnight(rows):
    assert ids(between_dates(rows, None, "2024-01-31")) == [1]
    assert ids(between_dates(rows, None, "2024-01-31", end_of_day=True)) == [1, 2]
    assert ids(between_dates(rows, "2024-01-31 05:00:00", None)) == [2, 4]


def test_two_clock_null_event_time(spark):
    data = [(1, None, dt.datetime(2024, 3, 1)), (2, dt.datetime(2024, 1, 5), dt.datetime(2024, 3, 1))]
    df = spark.createDataFrame(data, "row_id long, ts timestamp_ntz, stored_at timestamp_ntz")
    # default: the stored time stands in for a null event time only
    assert ids(two_clock_range(df, "2024-02-01", "2024-03-31")) == [1]
    # exact: either clock may satisfy each end
    assert ids(two_clock_range(df, "2024-02-01", "2024-03-31", exact=True)) == [1, 2]


def test_roles(spark):
    df = spark.createDataFrame([], "ID long, Text string, LEVEL int, Created_At string, date string")
    r = resolve_roles(df)
    assert (r.text, r.level, r.timestamp) == ("Text", "LEVEL", "date")
    assert TIMESTAMP_NAMES[0] == "timestamp"
