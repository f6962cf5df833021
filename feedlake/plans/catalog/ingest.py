"""Ingest, retention, CSV and report queries.  The ingest queries write into fresh folders
under the shared checkpoint folder and return what was written (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators.filters import fresh, keep_newest
from feedlake.plans.catalog.views import FEEDBACK, NON_SPACE_SQL, hash_sql
from feedlake.plans.registry import register
from feedlake.session import scratch_path, written_once
from feedlake.sources.csv import read_feedback_csv
from feedlake.sources.csv_split import read_split_csv
from feedlake.sources.embeddings import append_new_embeddings
from feedlake.sources.history import HISTORY_SCHEMA, append_new_history, open_history, read_newest
from feedlake.sources.reports import write_report
from feedlake.sources.sketches import append_new_sketched
from feedlake.sources.tables import feedback, table
from feedlake.streaming.first_seen import KEPT, first_seen_stream
from feedlake.streaming.ingest import ingest_stream

NOW = "2024-01-30 12:00:00"


@register(
    "fresh_rows",
    "select event_id, ts from events where ts >= timestamp '2024-01-24 12:00:00'",
    "B13",
)
def fresh_rows(spark, sf_dir):
    """Rows newer than the given time are fresh too."""
    return fresh(table(spark, sf_dir, "events"), "ts", "2024-01-25 12:00:00", hours=24).select("event_id", "ts")


@register(
    "fresh_rows_until_now",
    "select event_id, ts from events where ts >= timestamp '2024-01-29 12:00:00' and ts <= timestamp '2024-01-30 12:00:00'",
    "B13",
)
def fresh_rows_until_now(spark, sf_dir):
    return fresh(table(spark, sf_dir, "events"), "ts", NOW, hours=24, drop_future=True).select("event_id", "ts")


@register("keep_newest", "select event_id, ts from events order by ts desc nulls last, event_id limit 100", "F6 F1")
def keep_newest_q(spark, sf_dir):
    return keep_newest(table(spark, sf_dir, "events").select("event_id", "ts"), 100, "ts", "event_id")


def _first_nonblank_sql(cols: str) -> str:
    return f"""select {cols} from (
  select {hash_sql('text')} as text_hash, text, level, ts,
         row_number() over (partition by {hash_sql('text')} order by row_id) as rn
  from {FEEDBACK} f where regexp_matches(text, {NON_SPACE_SQL})) t where rn = 1"""


@register("append_embeddings", _first_nonblank_sql("text_hash, substr(text, 1, 500) as snippet, level, ts"), "A3 D2 H1 C4")
def append_embeddings(spark, sf_dir):
    """Encode the feedback texts into a fresh embedding table, then load again: the second
    load must append nothing, so the table holds one row per distinct non-blank hash
    (the vectors themselves are checked by the tests)."""
    path = scratch_path(spark, "embeddings")
    f = feedback(spark, sf_dir)
    append_new_embeddings(f, path)
    return append_new_embeddings(f, path).select("text_hash", "snippet", "level", "ts")


@register(
    "history_ingest_twice",
    _first_nonblank_sql("text_hash, level, ts, timestamp '2024-02-01 00:00:00' as stored_at"),
    "A4 A8 D1 G3",
)
def history_ingest_twice(spark, sf_dir):
    """Two loads of the same rows: the second appends nothing, so every row keeps the first
    load's stored time."""
    path = scratch_path(spark, "history")
    f = feedback(spark, sf_dir)
    append_new_history(f, path, "2024-02-01 00:00:00")
    append_new_history(f, path, "2024-02-02 00:00:00")
    return spark.read.schema(HISTORY_SCHEMA).parquet(path).select("text_hash", "level", "ts", "stored_at")


_MONTHLY = f"""(select text_hash, level, ts,
  case turn when 0 then timestamp '2024-02-01 00:00:00' when 1 then timestamp '2024-03-01 00:00:00' else timestamp '2024-04-01 00:00:00' end as stored_at
from (select *, row_number() over (partition by text_hash order by turn, row_id) as rn
      from (select {hash_sql('text')} as text_hash, level, ts, row_id, case when lang = 'en' then 0 when lang = 'de' then 1 else 2 end as turn
            from {FEEDBACK} f where regexp_matches(text, {NON_SPACE_SQL})) h) t where rn = 1)"""


def _monthly_loads(spark, sf_dir) -> str:
    """English rows are loaded in February, German ones in March, all rows in April and again in
    May; every load asks the sketches of the months before.  Returns the table's path."""
    path, sketches = scratch_path(spark, "monthly-history"), scratch_path(spark, "monthly-sketches")
    f = written_once(feedback(spark, sf_dir), "feedback", "zstd")  # one join for the four loads
    loads = [(f.filter("lang = 'en'"), "2024-02-01"), (f.filter("lang = 'de'"), "2024-03-01"), (f, "2024-04-01"), (f, "2024-05-01")]
    for rows, day in loads:
        append_new_sketched(rows, path, sketches, f"{day} 00:00:00", stored=True)
    return path


@register("history_sketched_ingest", f"select text_hash, level, ts, stored_at from {_MONTHLY} m", "D1 A8 A4")
def history_sketched_ingest(spark, sf_dir):
    """Loads over several months; only months whose sketch may hold a hash are read."""
    return open_history(spark, _monthly_loads(spark, sf_dir)).select("text_hash", "level", "ts", "stored_at")


@register(
    "history_newest_months",
    f"select text_hash, level, ts, stored_at from {_MONTHLY} m where level = 3 order by stored_at desc, text_hash limit 40",
    "A5 F1 A8",
)
def history_newest_months(spark, sf_dir):
    """The newest rows of a level, months read newest first until there are enough."""
    return read_newest(open_history(spark, _monthly_loads(spark, sf_dir)), 40, level=3).select("text_hash", "level", "ts", "stored_at")


@register(
    "stream_ingest",
    f"""select text_hash, cast(null as integer) as level, cast(null as timestamp) as ts,
       timestamp '2024-02-01 00:00:00' as stored_at
from (select {hash_sql('text')} as text_hash,
             row_number() over (partition by {hash_sql('text')} order by doc_id) as rn
      from documents where regexp_matches(text, {NON_SPACE_SQL})) t where rn = 1""",
    "I1 A3 A4",
)
def stream_ingest(spark, sf_dir):
    """Documents arrive as a file stream; history and vectors are appended per micro-batch."""
    docs = table(spark, sf_dir, "documents")
    hist, emb, ckpt = scratch_path(spark, "stream-history"), scratch_path(spark, "stream-emb"), scratch_path(spark, "stream-ckpt")
    q = ingest_stream(
        spark,
        f"{sf_dir.rstrip('/')}/documents*.parquet",
        docs.schema,
        hist,
        ckpt,
        embeddings_path=emb,
        fmt="parquet",
        stored_at="2024-02-01 00:00:00",
        order="doc_id",
    )
    q.awaitTermination()
    return spark.read.schema(HISTORY_SCHEMA).parquet(hist).select("text_hash", "level", "ts", "stored_at")


@register(
    "stream_first_seen",
    f"""select text_hash, text, doc_id as place
from (select {hash_sql('text')} as text_hash, text, doc_id,
             row_number() over (partition by {hash_sql('text')} order by doc_id) as rn
      from documents where regexp_matches(text, {NON_SPACE_SQL})) t where rn = 1""",
    "I1 (state instead of a stored table)",
)
def stream_first_seen(spark, sf_dir):
    """Documents arrive as a file stream; the stream's state knows the hashes seen so far."""
    docs = table(spark, sf_dir, "documents")
    out, ckpt = scratch_path(spark, "first-seen"), scratch_path(spark, "first-seen-ckpt")
    first_seen_stream(spark, f"{sf_dir.rstrip('/')}/documents*.parquet", docs.schema, out, ckpt, fmt="parquet", order="doc_id").awaitTermination()
    return spark.read.schema(KEPT).parquet(out).select("text_hash", "text", "place")


@register("csv_roundtrip", None, "A1 A6")
def csv_roundtrip(spark, sf_dir):
    """Feedback rows written as a CSV report and read back through the CSV source."""
    path = scratch_path(spark, "report")
    f = feedback(spark, sf_dir).select("row_id", "text", "level", "ts", "lang")
    write_report(f, path)
    return read_feedback_csv(spark, path)


@register(
    "csv_split_roundtrip",
    """select doc_id, text, n_chars from documents where text is not null and trim(text) <> ''""",
    "A1",
)
def csv_split_roundtrip(spark, sf_dir):
    """Documents written as CSV, line breaks inside cells, and read back in splits."""
    path = scratch_path(spark, "split-csv")
    docs = table(spark, sf_dir, "documents").filter("text is not null and trim(text) <> ''").select("doc_id", "text", "n_chars")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_split_csv(spark, path, docs.schema).select("doc_id", "text", "n_chars")


@register(
    "attach_embeddings",
    f"select row_id, {hash_sql('text')} as text_hash, true as has_embedding from {FEEDBACK} f where regexp_matches(text, {NON_SPACE_SQL})",
    "D2 H1",
)
def attach_embeddings_q(spark, sf_dir):
    """Every non-blank feedback row with its vector, reusing stored vectors by hash: the
    table is first filled from the labelled documents, then the rest are encoded once."""
    from feedlake.sources.embeddings import attach_embeddings

    path = scratch_path(spark, "attach")
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    append_new_embeddings(labelled.select(F.col("doc_id").alias("row_id"), "text"), path)
    out = attach_embeddings(feedback(spark, sf_dir), path)
    return out.select("row_id", "text_hash", F.col("embedding").isNotNull().alias("has_embedding"))
