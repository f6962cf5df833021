"""Long-term history table: append-only Parquet, one row per normalised text hash.

Layout: ``text_hash string, text string, level int, ts timestamp_ntz, stored_at timestamp_ntz,
row_json string`` partitioned by ``stored_month`` (yyyy-MM of ``stored_at``).  The typed hot
columns answer level / time questions without parsing JSON; ``row_json`` keeps every other
input column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.jsonrow import json_schema_of, json_to_columns, row_to_json
from feedlake.functions.numbers import lenient_int
from feedlake.functions.timeparts import parse_ts
from feedlake.operators.dedupe import first_per_key, new_rows, with_hash
from feedlake.operators.filters import non_blank, two_clock_range
from feedlake.session import written_once
from feedlake.sources.roles import Roles, quoted, resolve_roles

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("text_hash", T.StringType(), False),
        T.StructField("text", T.StringType(), True),
        T.StructField("level", T.IntegerType(), True),
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("stored_at", T.TimestampNTZType(), False),
        T.StructField("row_json", T.StringType(), True),
        T.StructField("stored_month", T.StringType(), False),
    ]
)

MOST_MONTHS = 12_000  # names of months that the driver reads at most


def history_rows(df: DataFrame, stored_at: str, existing: DataFrame | None = None, order: str = "row_id") -> DataFrame:
    """Rows to append: non-blank texts, first row per text hash (in ``order``), minus hashes
    already in ``existing``; projected to the history layout."""
    roles = resolve_roles(df)
    roles.require("text")
    base = with_hash(non_blank(df, roles.text), roles.text)
    first = first_per_key(base, "text_hash", order)
    if existing is not None:
        first = new_rows(first, existing, "text_hash", probe=True)
    return history_layout(first, df, roles, stored_at, order)


def history_layout(first: DataFrame, df: DataFrame, roles: Roles, stored_at: str, order: str) -> DataFrame:
    """Rows of ``df`` with their ``text_hash`` as rows of the history table."""
    src_cols = [c for c in df.columns if c != order]
    level = lenient_int(quoted(roles.level)) if roles.level else F.lit(None).cast("int")
    if roles.timestamp:
        ts = parse_ts(quoted(roles.timestamp), df.schema[roles.timestamp].dataType.simpleString())
    else:
        ts = F.lit(None).cast("timestamp_ntz")
    stored = F.lit(stored_at).cast("timestamp_ntz")
    return first.select(
        "text_hash",
        quoted(roles.text).cast("string").alias("text"),
        level.alias("level"),
        ts.alias("ts"),
        stored.alias("stored_at"),
        row_to_json(first, src_cols).alias("row_json"),
        F.date_format(stored, "yyyy-MM").alias("stored_month"),
    )


def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HISTORY_SCHEMA)


def open_history(spark: SparkSession, path: str) -> DataFrame:
    """The history table at ``path`` (empty when it does not exist yet)."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).parquet(path)
    except Exception as e:  # missing folder: nothing stored yet
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return empty_history(spark)
        raise


def append_new_history(df: DataFrame, path: str, stored_at: str, order: str = "row_id") -> int:
    """Append the rows whose hash is new; returns how many were appended.

    The new rows are written once; re-running with the same input appends nothing because
    the anti join sees the hashes written by the first run."""
    spark = df.sparkSession
    existing = open_history(spark, path)
    rows = history_rows(df, stored_at, None, order)
    if not existing.isEmpty():  # the probe and the anti join both use the rows
        rows = new_rows(written_once(rows, "first-rows"), existing, "text_hash", probe=True)
    written = Observation()
    rows.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("stored_month").parquet(path)
    return written.get["n"]


def _wanted(hist: DataFrame, start: str | None, end: str | None, level: int | None, exact: bool) -> DataFrame:
    out = two_clock_range(hist, start, end, "ts", "stored_at", exact)
    return out if level is None else out.filter(F.col("level") == F.lit(level))


def months_for(wanted: DataFrame, months: list[str], limit: int) -> str | None:
    """The oldest of ``months`` (newest first) needed for ``limit`` rows of ``wanted``; None if
    there are fewer rows.  Months are counted in steps that double (1, 2, 4, ...), and a count
    ends at the rows still missing, so that few months are read twice."""
    at, step, missing = 0, 1, limit
    while at < len(months):
        some = months[at : at + step]
        missing -= wanted.filter(F.col("stored_month").between(some[-1], some[0])).limit(missing).count()
        if missing <= 0:
            return some[-1]
        at, step = at + step, step * 2
    return None


def read_newest(
    hist: DataFrame,
    limit: int,
    start: str | None = None,
    end: str | None = None,
    level: int | None = None,
    exact: bool = False,
) -> DataFrame:
    """``read_history`` with a limit, descending through the months of a stored table: a row of a newer
    month comes before every row of an older one, so months behind the limit are not read
    (a partition filter).  The rows are those of ``read_history``."""
    wanted = _wanted(hist, start, end, level, exact)
    names = hist.select("stored_month").distinct().orderBy(F.desc("stored_month")).limit(MOST_MONTHS).collect()
    oldest = months_for(wanted, [r.stored_month for r in names], limit)
    if oldest is not None:
        wanted = wanted.filter(F.col("stored_month") >= oldest)
    return wanted.orderBy(F.col("stored_at").desc(), F.col("text_hash")).limit(limit)


def read_history(
    hist: DataFrame,
    start: str | None = None,
    end: str | None = None,
    level: int | None = None,
    limit: int | None = None,
    exact: bool = False,
    expand_json: bool = False,
) -> DataFrame:
    """History rows in a date range (two clocks, see ``two_clock_range``), optional level
    equality, newest first (ties by hash), all of them unless a ``limit`` is given.

    ``expand_json`` spreads the JSON record over columns; keys that a typed column already
    holds are left to that column."""
    out = _wanted(hist, start, end, level, exact).orderBy(F.col("stored_at").desc(), F.col("text_hash"))
    if limit:
        out = out.limit(limit)
    if expand_json:
        typed = {c.lower() for c in out.columns} - {"row_json"}
        keys = json_schema_of(out, "row_json")
        out = json_to_columns(out, "row_json", T.StructType([f for f in keys.fields if f.name.lower() not in typed]))
    return out
