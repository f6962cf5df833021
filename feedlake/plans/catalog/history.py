"""Dedupe, anti-join and history-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions.jsonrow import json_to_columns
from feedlake.operators.dedupe import first_per_key, new_rows, with_hash
from feedlake.plans.analysis import history_summary
from feedlake.plans.catalog.views import FEEDBACK, NON_SPACE_SQL, hash_sql
from feedlake.plans.registry import register
from feedlake.sources.history import history_rows, read_history
from feedlake.sources.tables import feedback, table

STORED_AT = "2024-02-01 00:00:00"


@register(
    "first_per_hash",
    f"""select doc_id, text_hash from (
  select doc_id, {hash_sql('text')} as text_hash,
         row_number() over (partition by {hash_sql('text')} order by doc_id) as rn
  from documents) t where rn = 1""",
    "G3 C2",
)
def first_per_hash(spark, sf_dir):
    d = with_hash(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return first_per_key(d.select("doc_id", "text_hash"), "text_hash", "doc_id")


@register(
    "new_rows_anti",
    f"""with h as (select doc_id, {hash_sql('text')} as text_hash from documents),
stored as (select text_hash from h where doc_id in (select doc_id from labels))
select doc_id, text_hash from h where not exists (select 1 from stored s where s.text_hash = h.text_hash)""",
    "D1",
)
def new_rows_anti(spark, sf_dir):
    h = with_hash(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text_hash")
    # the stored side filters the same hashed rows (a semi join on the small id column), so
    # no text moves through a shuffle
    stored = h.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return new_rows(h, stored, "text_hash")


_FIRST_F = f"""select text_hash, level, ts from (
  select {hash_sql('text')} as text_hash, level, ts,
         row_number() over (partition by {hash_sql('text')} order by row_id) as rn
  from {FEEDBACK} f where regexp_matches(text, {NON_SPACE_SQL})) t where rn = 1"""


@register("history_rows", _FIRST_F, "A4 G3 C11")
def history_rows_q(spark, sf_dir):
    return history_rows(feedback(spark, sf_dir), STORED_AT).select("text_hash", "level", "ts")


@register(
    "history_read",
    f"""select text_hash, level, ts, timestamp '{STORED_AT}' as stored_at from ({_FIRST_F}) h
where coalesce(ts, timestamp '{STORED_AT}') >= timestamp '2024-01-10'
  and coalesce(ts, timestamp '{STORED_AT}') <= timestamp '2024-01-20'
order by stored_at desc, text_hash""",
    "A5 B10 F1",
)
def history_read(spark, sf_dir):
    hist = history_rows(feedback(spark, sf_dir), STORED_AT)
    return read_history(hist, "2024-01-10", "2024-01-20").select("text_hash", "level", "ts", "stored_at")


@register(
    "history_read_exact",
    f"""select text_hash, level, ts, timestamp '{STORED_AT}' as stored_at from ({_FIRST_F}) h
where (cast(ts as varchar) >= '2024-01-10' or '{STORED_AT}' >= '2024-01-10')
  and (cast(ts as varchar) <= '2024-01-20' or '{STORED_AT}' <= '2024-01-20')
  and level = 2
order by stored_at desc, text_hash""",
    "A5 B10 F1",
)
def history_read_exact(spark, sf_dir):
    hist = history_rows(feedback(spark, sf_dir), STORED_AT)
    out = read_history(hist, "2024-01-10", "2024-01-20", level=2, exact=True)
    return out.select("text_hash", "level", "ts", "stored_at")


@register(
    "history_json_fields",
    "select event_id, json_extract_string(props, '$.k') as k from events where json_type(props) = 'OBJECT'",
    "C9 G2",
)
def history_json_fields(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    return json_to_columns(ev, "props")


@register("history_json_roundtrip", None, "C8")
def history_json_roundtrip(spark, sf_dir):
    """Rows-only: JSON of each first-per-hash feedback row."""
    return history_rows(feedback(spark, sf_dir), STORED_AT).select("text_hash", "row_json").filter(F.col("row_json").isNotNull())


@register(
    "history_summary",
    f"""
with r as (select text_hash, level, ts, timestamp '{STORED_AT}' as stored_at from ({_FIRST_F}) h
           where coalesce(ts, timestamp '{STORED_AT}') >= timestamp '2024-01-01'
             and coalesce(ts, timestamp '{STORED_AT}') <= timestamp '2024-01-31')
select count(*) as n_rows, avg(cast(level as double)) as avg_level, min(level) as min_level,
       max(level) as max_level, min(ts) as first_ts, max(ts) as last_ts from r
""",
    "E15 A5 E2 E4",
)
def history_summary_q(spark, sf_dir):
    found = history_summary(history_rows(feedback(spark, sf_dir), STORED_AT), "2024-01-01", "2024-01-31", limit=20)
    return found["rows"].agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("level").cast("double")).alias("avg_level"),
        F.min("level").alias("min_level"),
        F.max("level").alias("max_level"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@register(
    "history_newest",
    f"""select text_hash, level, ts from ({_FIRST_F}) h where level = 3 order by text_hash limit 25""",
    "A5 F1",
)
def history_newest(spark, sf_dir):
    """The limit as a feature: the newest rows of a level (ties by hash)."""
    return read_history(history_rows(feedback(spark, sf_dir), STORED_AT), level=3, limit=25).select("text_hash", "level", "ts")


@register(
    "history_json_values",
    f"""select text_hash, cast(row_id as varchar) as row_id_text, lang, source from (
  select {hash_sql('text')} as text_hash, row_id, lang, source,
         row_number() over (partition by {hash_sql('text')} order by row_id) as rn
  from {FEEDBACK} f where regexp_matches(text, {NON_SPACE_SQL})) t where rn = 1""",
    "C8 C9 A5",
)
def history_json_values(spark, sf_dir):
    """The record written as JSON and read back, keys of typed columns left to those."""
    rows = feedback(spark, sf_dir).withColumn("row_id_text", F.col("row_id").cast("string"))
    wide = read_history(history_rows(rows, STORED_AT), expand_json=True)
    return wide.select("text_hash", "row_id_text", "lang", "source")
