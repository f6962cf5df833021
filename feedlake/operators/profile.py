"""Table profile: level distribution and summary, text and time coverage, per-column stats.

Per-column distinct counts and top values use one unpivot to ``(column, value)`` followed by a
single ``groupBy(column, value)`` (partial aggregation before the shuffle), instead of one
``countDistinct`` per column (which would expand every row once per column).  Per-column
top-n uses ``row_number() <= n``, which Spark plans with a partial ``WindowGroupLimit``
before the exchange, so a column with billions of distinct values never lands in one task
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.functions.numbers import pct
from feedlake.functions.text import text_length
from feedlake.functions.timeparts import parse_ts
from feedlake.sources.roles import quoted, resolve_roles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def level_distribution(df: DataFrame, level: str = "level") -> DataFrame:
    """(level, n) per non-null level, sorted by level (one row per level, so the sort is tiny)."""
    return df.filter(F.col(level).isNotNull()).groupBy(F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy("level")


def level_summary(df: DataFrame, level: str = "level") -> DataFrame:
    lv = F.col(level)
    return df.agg(F.avg(lv.cast("double")).alias("avg_level"), F.min(lv).alias("min_level"), F.max(lv).alias("max_level"))


def text_summary(df: DataFrame, text: str = "text") -> DataFrame:
    """Non-null texts (blank ones count) and mean length in characters over non-null texts."""
    return df.agg(
        F.count(F.col(text)).alias("n_text"),
        F.avg(text_length(F.col(text)).cast("double")).alias("avg_length"),
    )


def time_coverage(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Earliest and latest parsable time, how many rows have one and their % of all rows."""
    t = parse_ts(F.col(ts), df.schema[ts].dataType.simpleString())
    return df.select(t.alias("t")).agg(
        F.min("t").alias("first_ts"),
        F.max("t").alias("last_ts"),
        F.count("t").alias("n_valid"),
        pct(F.count("t"), F.count(F.lit(1))).alias("pct_valid"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns, column names."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("columns")
    )


def _other_columns(df: DataFrame, exclude: list[str] | None):
    if exclude is None:
        r = resolve_roles(df)
        exclude = [c for c in (r.text, r.level, r.timestamp) if c]
    return [f for f in df.schema.fields if f.name not in exclude]


def profile_numeric(df: DataFrame, exclude: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, dtype, n_non_null, pct_non_null, min, max, mean, n_distinct) for every numeric
    (and boolean) column other than the role columns.

    ``approx=True`` estimates the distinct counts with HyperLogLog++ inside the same single
    aggregate pass (no shuffle of values) - the choice for very large tables."""
    fields = [f for f in _other_columns(df, exclude) if isinstance(f.dataType, NUMERIC)]
    schema = "column_name string, dtype string, n_non_null long, pct_non_null double, min double, max double, mean double, n_distinct long"
    if not fields:
        return df.sparkSession.createDataFrame([], schema)
    # one aggregate pass for count / min / max / mean of every column
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = quoted(f.name).cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.avg(c).alias(f"av{i}")]
        if approx:
            aggs.append(F.approx_count_distinct(c).alias(f"nd{i}"))
    wide = df.agg(*aggs)
    if approx:
        stats = _stacked(wide, fields, {"n_non_null": "n", "min": "lo", "max": "hi", "mean": "av", "n_distinct": "nd"})
        return stats.select(
            "column_name", "dtype", "n_non_null", pct(F.col("n_non_null"), F.col("__rows")).alias("pct_non_null"),
            "min", "max", "mean", F.col("n_distinct").cast("long").alias("n_distinct"),
        )
    stats = _stacked(wide, fields, {"n_non_null": "n", "min": "lo", "max": "hi", "mean": "av"})
    # distinct counts: unpivot once, group by (column, value) once
    longv = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(f.name).alias("column_name"), quoted(f.name).cast("double").alias("value")) for f in fields])
        ).alias("kv")
    ).select("kv.column_name", "kv.value")
    distinct = (
        longv.filter(F.col("value").isNotNull())
        .distinct()
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )
    out = stats.join(distinct, "column_name", "left").select(
        "column_name",
        "dtype",
        "n_non_null",
        pct(F.col("n_non_null"), F.col("__rows")).alias("pct_non_null"),
        "min",
        "max",
        "mean",
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
    )
    return out


def _stacked(wide: DataFrame, fields: list, values: dict[str, str]) -> DataFrame:
    """One row per field from a one-row aggregate: ``column_name``, ``dtype`` and the columns
    ``<prefix><i>`` under the names of ``values``.  Names are literals, so any will do."""
    rows = [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), *[F.col(f"{p}{i}").alias(out) for out, p in values.items()])
        for i, f in enumerate(fields)
    ]
    return wide.select("__rows", F.inline(F.array(*rows)))


def _string_value_counts(df: DataFrame, exclude: list[str] | None, order: str | None):
    fields = [f for f in _other_columns(df, exclude) if isinstance(f.dataType, T.StringType)]
    if not fields:
        return None, fields
    rid = F.col(order) if order else F.monotonically_increasing_id()
    longv = df.select(
        rid.alias("__rid"),
        F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), quoted(f.name).alias("value")) for f in fields])).alias("kv"),
    ).select("__rid", "kv.column_name", "kv.value")
    counts = (
        longv.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__rid").alias("first_row"))
    )
    return counts, fields


def profile_strings(df: DataFrame, exclude: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, dtype, n_non_null, pct_non_null, n_distinct) for every string column other
    than the role columns.  ``approx=True`` estimates the distinct counts with
    HyperLogLog++ in the same single aggregate pass (no shuffle of values)."""
    fields = [f for f in _other_columns(df, exclude) if isinstance(f.dataType, T.StringType)]
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, dtype string, n_non_null long, pct_non_null double, n_distinct long")
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        aggs += [F.count(quoted(f.name)).alias(f"n{i}")]
        if approx:
            aggs.append(F.approx_count_distinct(quoted(f.name)).alias(f"nd{i}"))
    wide = df.agg(*aggs)
    if approx:
        stats = _stacked(wide, fields, {"n_non_null": "n", "n_distinct": "nd"})
        return stats.select(
            "column_name", "dtype", "n_non_null",
            pct(F.col("n_non_null"), F.col("__rows")).alias("pct_non_null"), F.col("n_distinct").cast("long").alias("n_distinct"),
        )
    stats = _stacked(wide, fields, {"n_non_null": "n"})
    counts, _ = _string_value_counts(df, exclude, None)
    distinct = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return stats.join(distinct, "column_name", "left").select(
        "column_name",
        "dtype",
        "n_non_null",
        pct(F.col("n_non_null"), F.col("__rows")).alias("pct_non_null"),
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
    )


def profile_top_values(df: DataFrame, exclude: list[str] | None = None, max_distinct: int = 20, top: int = 10) -> DataFrame:
    """For string columns with at most ``max_distinct`` distinct values: the ``top`` most
    frequent values (ties by value) with count and % of all rows."""
    counts, _ = _string_value_counts(df, exclude, None)
    if counts is None:
        return df.sparkSession.createDataFrame([], "column_name string, rank long, value string, n long, pct double")
    total = df.agg(F.count(F.lit(1)).alias("__rows"))
    nd = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct")).filter(F.col("n_distinct") <= max_distinct)
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value"))
    ranked = counts.join(nd, "column_name", "left_semi").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
    # the table's row count enters as a scalar subquery (one aggregate, no join)
    return ranked.select("column_name", "rank", "value", "n", pct(F.col("n"), total.scalar()).alias("pct"))


def profile_samples(df: DataFrame, order: str, exclude: list[str] | None = None, max_distinct: int = 20, n: int = 5) -> DataFrame:
    """For string columns with more than ``max_distinct`` distinct values: the first ``n``
    distinct non-null values in table order."""
    counts, _ = _string_value_counts(df, exclude, order)
    if counts is None:
        return df.sparkSession.createDataFrame([], "column_name string, rank long, value string")
    nd = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct")).filter(F.col("n_distinct") > max_distinct)
    w = Window.partitionBy("column_name").orderBy(F.col("first_row"))
    return (
        counts.join(nd, "column_name", "left_semi")
        .withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("rank") <= n)
        .select("column_name", "rank", "value")
    )
