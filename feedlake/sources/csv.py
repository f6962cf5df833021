"""Feedback CSV source: header, quoted multi-line text, null tokens, type inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.sources.roles import quoted

# Cell texts read as missing (the common CSV null spellings).
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def null_tokens(df: DataFrame) -> DataFrame:
    """Text cells that spell a missing value become null; other types pass."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[(F.when(quoted(c).isin(NULL_TOKENS), F.lit(None)).otherwise(quoted(c)) if c in text else quoted(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns whose non-null values all parse as long / double / boolean.

    One aggregate pass counts, per column, the values that fail each parse."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        v = quoted(c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.isNotNull() & v.try_cast("long").isNull()).alias(f"l{i}"),
            F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(f"d{i}"),
            F.count_if(v.isNotNull() & ~F.lower(v).isin("true", "false")).alias(f"b{i}"),
        ]
    stats = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        if stats[f"n{i}"] == 0:
            out.append(quoted(c))
        elif stats[f"l{i}"] == 0:
            out.append(quoted(c).try_cast("long").alias(c))
        elif stats[f"d{i}"] == 0:
            out.append(quoted(c).try_cast("double").alias(c))
        elif stats[f"b{i}"] == 0:
            out.append((F.lower(quoted(c)) == "true").alias(c))
        else:
            out.append(quoted(c))
    keep = [quoted(f.name) for f in df.schema.fields if f.name not in cols]
    return df.select(*keep, *out).select(*[quoted(c) for c in df.columns])


def read_feedback_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    encoding: str = "UTF-8",
    row_id: str | None = "row_id",
    multi_line: bool = True,
) -> DataFrame:
    """Read header CSV file(s) with quoted, possibly multi-line text.

    A multi-line file cannot be split, so each file is one task; ``multi_line=False`` lets Spark
    split files whose cells hold no line breaks.

    Null spellings in ``NULL_TOKENS`` become null before types are inferred (one pass) unless
    a schema is given.  ``row_id`` (if not None and absent) numbers rows in file order
    within each file; give an explicit id column when rows of several files must be ordered."""
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
    )
    if schema is not None:
        df = null_tokens(reader.schema(schema).csv(path))
        typed = df.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in (schema if isinstance(schema, T.StructType) else df.schema).fields])
    else:
        typed = infer_types(null_tokens(reader.csv(path)))
    if row_id and row_id not in typed.columns:
        typed = typed.withColumn(row_id, F.monotonically_increasing_id())
    return typed


def read_feedback_csvs(spark: SparkSession, paths: list[str], encoding: str = "UTF-8", row_id: str | None = "row_id") -> DataFrame:
    """Several CSV files whose columns differ: each is read with its own header and the
    results are stacked by column name, missing columns null-filled (a ragged union).
    Column types are inferred per file; a column typed differently across files is kept
    as text."""
    from functools import reduce

    parts = [read_feedback_csv(spark, p, encoding=encoding, row_id=None) for p in paths]
    kinds: dict[str, set] = {}
    for df in parts:
        for name, dtype in df.dtypes:
            kinds.setdefault(name, set()).add(dtype)
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    parts = [df.select(*[(quoted(c).cast("string") if c in mixed else quoted(c)).alias(c) for c in df.columns]) for df in parts]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if row_id and row_id not in out.columns:
        out = out.withColumn(row_id, F.monotonically_increasing_id())
    return out
