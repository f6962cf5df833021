"""Row <-> JSON text, for the history table's free-form record column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.sources.roles import quoted


def row_to_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON object of the row's non-null values, every value as a string
    (timestamps in ISO form).  Null fields are left out."""
    cols = columns or df.columns
    fields = []
    for name in cols:
        dtype = df.schema[name].dataType
        c = quoted(name)
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            v = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        else:
            v = c.cast("string")
        fields.append(v.alias(name))
    return F.to_json(F.struct(*fields))


def json_schema_of(df: DataFrame, column: str, max_keys: int = 10_000) -> T.StructType:
    """Union of keys over all JSON objects of ``column``, each typed as string.

    Runs one distributed job (explode keys, distinct); at most ``max_keys`` key names come
    back to the driver - more raises, since a schema with that many columns is not a table
    layout (pass an explicit schema instead)."""
    keys = (
        df.select(F.explode(F.json_object_keys(F.col(column))).alias("k"))
        .distinct()
        .orderBy("k")
        .limit(max_keys + 1)
    )
    names = [r.k for r in keys.toLocalIterator()]
    if len(names) > max_keys:
        raise ValueError(f"more than {max_keys} distinct JSON keys in {column}; pass a schema")
    return T.StructType([T.StructField(k, T.StringType(), True) for k in names])


def json_to_columns(df: DataFrame, column: str, schema: T.StructType | None = None, drop_bad: bool = True) -> DataFrame:
    """Spread the keys of a JSON-object column into columns (missing keys -> null).

    Rows whose text is not a JSON object are dropped when ``drop_bad``."""
    schema = schema or json_schema_of(df, column)
    parsed = df.withColumn("__obj", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))
    if drop_bad:
        parsed = parsed.filter(F.json_object_keys(F.col(column)).isNotNull())
    return parsed.select(*[quoted(c) for c in df.columns if c != column], *[F.col("__obj").getField(f.name).alias(f.name) for f in schema.fields])
