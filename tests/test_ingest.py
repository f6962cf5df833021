"""CSV source, history / embedding appends, replay and stream ingest."""

import os
import tempfile

from pyspark.sql import functions as F

from feedlake.operators.categories import categorize, category_entries, with_summary_row
from feedlake.session import scratch_path
from feedlake.sources.csv import read_feedback_csv
from feedlake.sources.embeddings import append_new_embeddings
from feedlake.sources.history import HISTORY_SCHEMA, append_new_history, read_history
from feedlake.streaming.ingest import ingest_stream

CSV1 = 'Level,Text,Timestamp,Ref\n5,"quick reply, thanks",2024-02-01,NA\n3,"export takes\na while",2024-02-02,n/a\n3,"Quick reply thanks!",bad,None\n'
CSV2 = 'Level,Text,Timestamp,Ref\n1,"slow",2024-03-01 10:00:00,7\n1,"export takes a while",2024-03-02,nan\n2,"slow!!",2024-03-03,\n'


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_nulls_types_and_newlines(spark):
    d = tempfile.mkdtemp(prefix="feedlake-test-")
    write(d, "a.csv", CSV1)
    df = read_feedback_csv(spark, d)
    rows = df.orderBy("row_id").collect()
    assert [r.Ref for r in rows] == [None, None, None]
    assert dict(df.dtypes)["Level"] == "bigint"
    assert rows[1].Text == "export takes\na while"


def test_history_replay_and_two_files(spark):
    d = tempfile.mkdtemp(prefix="feedlake-test-")
    write(d + "/one", "a.csv", CSV1)
    write(d + "/two", "b.csv", CSV2)
    hist = scratch_path(spark, "t-history")
    one = read_feedback_csv(spark, d + "/one")
    two = read_feedback_csv(spark, d + "/two")
    append_new_history(one, hist, "2024-04-01 00:00:00")
    append_new_history(one, hist, "2024-04-02 00:00:00")  # replay adds nothing
    after_one = spark.read.schema(HISTORY_SCHEMA).parquet(hist).count()
    assert after_one == 2  # "quick reply, thanks" twice up to case/punctuation
    append_new_history(two, hist, "2024-04-03 00:00:00")
    h = spark.read.schema(HISTORY_SCHEMA).parquet(hist)
    assert h.count() == 3  # only "slow" is new; "slow!!" and the export text repeat
    newest = read_history(h, limit=1).first()
    assert newest.stored_at.day == 3
    bad = h.filter(F.col("text").startswith("quick")).first()
    assert bad.level == 5


def test_embeddings_append_once(spark):
    d = tempfile.mkdtemp(prefix="feedlake-test-")
    write(d, "a.csv", CSV1)
    df = read_feedback_csv(spark, d)
    path = scratch_path(spark, "t-emb")
    append_new_embeddings(df, path)
    t = append_new_embeddings(df, path)
    assert t.count() == 2
    assert len(t.first().embedding) == 64


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="feedlake-test-")
    write(d + "/in", "a.csv", CSV1)
    write(d + "/in", "b.csv", CSV2)
    schema = "Level string, Text string, Timestamp string, Ref string"
    from pyspark.sql.types import _parse_datatype_string

    hist = scratch_path(spark, "t-stream-hist")
    q = ingest_stream(spark, d + "/in", _parse_datatype_string(schema), hist, scratch_path(spark, "t-ckpt"), stored_at="2024-04-01 00:00:00", max_files_per_trigger=1)
    q.awaitTermination()
    assert spark.read.schema(HISTORY_SCHEMA).parquet(hist).count() == 3


def test_category_entries_and_summary(spark):
    df = spark.createDataFrame([(1, "slow and broken"), (2, "fine")], "row_id long, text string")
    tagged = categorize(df, rules={"Performance": "slow", "Errors": "broken"})
    e = category_entries(tagged).first()
    assert (e.n_rows, e.n_entries) == (2, 1)
    rep = with_summary_row(tagged).collect()
    assert rep[-1].row_id == "SUMMARY_TOTAL_COUNTS" and rep[-1].Category_Performance == "1" and rep[-1].text == ""


def test_history_skips_blank_texts(spark):
    df = spark.createDataFrame([(1, "ok", 3), (2, "   ", 4), (3, None, 5), (4, " ", 1)], "row_id long, text string, level int")
    hist = scratch_path(spark, "t-blank")
    append_new_history(df, hist, "2024-04-01 00:00:00")
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(hist).collect()
    assert [r.text for r in rows] == ["ok"]


def test_ragged_json_rows(spark):
    from feedlake.functions.jsonrow import json_to_columns

    df = spark.createDataFrame([(1, '{"a": "1"}'), (2, '{"b": "x", "a": "2"}'), (3, "not json"), (4, "[1, 2]")], "id long, j string")
    got = sorted((r.id, r.a, r.b) for r in json_to_columns(df, "j").collect())
    assert got == [(1, "1", None), (2, "2", "x")]


def test_ragged_csv_union(spark):
    from feedlake.sources.csv import read_feedback_csvs

    d = tempfile.mkdtemp(prefix="feedlake-test-")
    write(d + "/a", "a.csv", "Level,Text\n5,good\n")
    write(d + "/b", "b.csv", "Text,Source,Level\nslow,app,x\n")
    df = read_feedback_csvs(spark, [d + "/a", d + "/b"])
    rows = sorted((r.Text, r.Level, r.Source) for r in df.collect())
    assert rows == [("good", "5", None), ("slow", "x", "app")]


def test_history_json_expanded_and_empty_report(spark):
    from feedlake.sources.reports import ensure_csv_suffix, report_name, write_report

    d = tempfile.mkdtemp(prefix="feedlake-test-")
    write(d, "a.csv", CSV1)
    hist = scratch_path(spark, "t-json")
    append_new_history(read_feedback_csv(spark, d), hist, "2024-04-01 00:00:00")
    h = spark.read.schema(HISTORY_SCHEMA).parquet(hist)
    wide = read_history(h, limit=None, expand_json=True)
    assert {"level", "text", "Timestamp", "stored_at"} <= set(wide.columns)
    assert len({c.lower() for c in wide.columns}) == len(wide.columns)  # typed columns hold level and text
    assert "Ref" not in wide.columns  # only null values: left out of the JSON, so no key
    assert sorted(r.level for r in wide.select("level", "text").collect()) == [3, 5]
    # a report with no rows writes nothing
    out = scratch_path(spark, "t-empty")
    assert write_report(h.filter("level = 99"), out) is False
    assert not os.path.exists(out)
    import datetime as dt

    day = dt.date(2024, 5, 1)
    assert report_name({"Level": [5, 4], "a b": "Été!"}, day) == "rows.20240501.a-b=été.level=4+5.csv"
    assert report_name({}, day, kind="categories") == "categories.20240501.csv"
    assert ensure_csv_suffix("x") == "x.csv"


def test_report_keeps_padding_and_skips_empty_categories(spark):
    from feedlake.operators.categories import categorize
    from feedlake.sources.reports import write_category_report, write_report

    out = scratch_path(spark, "t-pad")
    assert write_report(spark.createDataFrame([("  pad  ", 1)], "text string, level int"), out)
    assert spark.read.option("header", True).csv(out).first()["text"] == "  pad  "
    tagged = categorize(spark.createDataFrame([(1, "slow")], "row_id long, text string"), categories=["Won't load"], rules={"Won't load": "slow"})
    none = scratch_path(spark, "t-none")
    assert write_category_report(tagged.limit(0), none) is False and not os.path.exists(none)
    assert write_category_report(tagged, none) is True


def test_append_counts_only_its_own_rows(spark):
    path = scratch_path(spark, "t-count")
    make = lambda texts: spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "row_id long, text string, level int")
    loads = [["a"], ["a", "b"], ["a", "b"]]
    assert [append_new_history(make(x), path, "2024-04-01 00:00:00") for x in loads] == [1, 1, 0]


def test_csv_stream_cleans_like_the_batch_load(spark):
    from feedlake.streaming.ingest import ingest_stream

    d = tempfile.mkdtemp(prefix="feedlake-test-")
    write(d, "a.csv", "Level,Text\n3,fine\n4,NA\n5,  null\n")
    hist = scratch_path(spark, "t-stream")
    q = ingest_stream(spark, d, "Level string, Text string", hist, scratch_path(spark, "t-ck"), stored_at="2024-04-01 00:00:00")
    assert q.awaitTermination(120)
    streamed = {r["text"] for r in spark.read.schema(HISTORY_SCHEMA).parquet(hist).collect()}
    batch = scratch_path(spark, "t-batch")
    append_new_history(read_feedback_csv(spark, d), batch, "2024-04-01 00:00:00")
    assert streamed == {r["text"] for r in spark.read.schema(HISTORY_SCHEMA).parquet(batch).collect()}
    assert "NA" not in streamed
