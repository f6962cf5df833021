"""Membership sketches of the history table, one set per stored month.

A sketch says of a text hash "surely not in this month" or "perhaps".  It is a Bloom filter cut
into blocks: a hash chooses one of ``buckets`` blocks of 32,768 bits and sets ``BITS`` bits in it.
Blocks are rows ``(stored_month, bucket, bits)`` of a Parquet table beside the history, built
with Spark's bitmap aggregates.  Every load appends its own blocks; blocks of one month and bucket
are merged with ``or`` when they are read, and ``compact_sketches`` writes them merged.

An ingest asks the sketches first.  Hashes that no month may hold are new without any look at
the stored table; for the others only the months that may hold them are read (a partition
filter), and an exact anti join decides.  So a sketch changes what is read, never the result.

A load writes its blocks before its rows: a job lost in between leaves bits too many, never too
few.  Months without any block (written before there were sketches) are always read;
``append_sketches(open_history(...), path)`` adds theirs.  A month to which rows were appended
without their sketches must be added the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedlake.operators.dedupe import new_rows, with_hash
from feedlake.operators.filters import non_blank
from feedlake.session import scratch_path, written_once
from feedlake.sources.history import MOST_MONTHS, history_layout, open_history
from feedlake.sources.roles import quoted, resolve_roles

SKETCH_SCHEMA = "stored_month string, bucket int, bits binary"
BUCKETS = 1024  # blocks of 4 KiB a month; about 8 bits a hash at 4 million hashes
BITS = 4
MOST_BITMAPS = 8192  # of 4 KiB, in a broadcast: places in up to 268 million rows


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _places(key: Column) -> list[Column]:
    """The bits of a key in its block: 15-bit parts of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(32767)) for i in range(BITS)]


def month_sketches(rows: DataFrame, buckets: int = BUCKETS, key: str = "text_hash") -> DataFrame:
    """Blocks of the rows' hashes by ``stored_month``.  Bits are set inside the tasks; a block
    crosses the shuffle once per task that has one of its hashes."""
    bits = rows.select("stored_month", _bucket(quoted(key), buckets).alias("bucket"), F.explode(F.array(*_places(quoted(key)))).alias("place"))
    return bits.groupBy("stored_month", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by).agg(F.bitmap_or_agg("bits").alias("bits"))


def append_sketches(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    month_sketches(rows, buckets).write.mode("append").parquet(f"{path.rstrip('/')}/buckets={buckets}")


def open_sketches(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The blocks stored with that number of buckets (none when there is no table yet)."""
    try:
        return spark.read.schema(SKETCH_SCHEMA).parquet(f"{path.rstrip('/')}/buckets={buckets}")
    except Exception as e:  # missing folder: nothing stored yet
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], SKETCH_SCHEMA)
        raise


def compact_sketches(spark: SparkSession, path: str, target: str, buckets: int = BUCKETS) -> None:
    """Blocks of all loads merged, written as a new table."""
    merged(open_sketches(spark, path, buckets), "stored_month", "bucket").write.parquet(f"{target.rstrip('/')}/buckets={buckets}")


def _is_set(place: Column, bits: str = "bits") -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1


def _may_hold(key: Column) -> Column:
    """All bits of ``key`` are set in the column ``bits``."""
    found = F.lit(True)
    for place in _places(key):
        found = found & _is_set(place)
    return found


def possible_hits(keys: DataFrame, sketches: DataFrame, buckets: int = BUCKETS, key: str = "text_hash") -> DataFrame:
    """``(key, stored_month)`` where that month may hold the key.  The months' blocks are
    merged for a first test, so that keys no month holds meet one block, not one per month."""
    asked = keys.select(quoted(key)).distinct().withColumn("bucket", _bucket(quoted(key), buckets))
    some = asked.join(merged(sketches, "bucket"), "bucket").filter(_may_hold(quoted(key))).drop("bits")
    return some.join(merged(sketches, "stored_month", "bucket"), "bucket").filter(_may_hold(quoted(key))).select(key, "stored_month")


def months_to_read(hits: DataFrame, history: DataFrame, sketches: DataFrame) -> list[str] | None:
    """Months with possible hits or without any block; None if they are more than ``MOST_MONTHS``."""
    bare = history.select("stored_month").distinct().join(sketches.select("stored_month").distinct(), "stored_month", "left_anti")
    names = hits.select("stored_month").unionAll(bare).distinct().limit(MOST_MONTHS + 1).collect()
    return sorted(r.stored_month for r in names) if len(names) <= MOST_MONTHS else None


def new_rows_by_sketch(df: DataFrame, history: DataFrame, sketches: DataFrame, buckets: int = BUCKETS, key: str = "text_hash") -> DataFrame:
    """Rows of ``df`` whose key the history does not hold: what ``new_rows`` returns, with only
    the months read that may hold one of the keys.  Null keys are never held."""
    hits = possible_hits(df, sketches, buckets, key)
    path = scratch_path(df.sparkSession, "possible-hits")
    hits.write.parquet(path)
    hits = df.sparkSession.read.schema(hits.schema).parquet(path)
    months = months_to_read(hits, history, sketches)
    if months is None:
        return new_rows(df, history, key, probe=True)
    if not months:
        return df
    return new_rows(df, history.filter(F.col("stored_month").isin(months)), key, probe=True)


def _located(df: DataFrame, stored: bool) -> DataFrame:
    """``df`` with the place of every row, ``(__file, __row)``; rows that are not stored are written first."""
    if stored:
        return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return written_once(df.select("*", F.lit("").alias("__file"), F.monotonically_increasing_id().alias("__row")), "load", "zstd")


def _rows_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows that stand at ``places``.  These are sent as bitmaps of 32,768 rows each, so that no row is shuffled."""
    bits = places.groupBy("__file", F.shiftright("__row", 15).alias("__part")).agg(F.bitmap_construct_agg(F.col("__row").bitwiseAND(F.lit(32767))).alias("__bits"))
    bits = written_once(bits, "places")
    if bits.count() <= MOST_BITMAPS:
        bits = F.broadcast(bits)
    found = rows.withColumn("__part", F.shiftright("__row", 15)).join(bits, ["__file", "__part"])
    return found.filter(_is_set(F.col("__row").bitwiseAND(F.lit(32767)), "__bits")).drop("__file", "__row", "__part", "__bits")


def append_new_sketched(df: DataFrame, history_path: str, sketch_path: str, stored_at: str, order: str = "row_id", buckets: int = BUCKETS, stored: bool = False) -> int:
    """``append_new_history`` through the sketches; returns how many rows were appended.

    Only hashes are shuffled and compared; the rows are read where they stand, once more, if their hash is new.  ``stored``
    says that ``df`` selects rows and columns of a Parquet table that stays as it is; any other is written as it comes."""
    spark = df.sparkSession
    roles = resolve_roles(df)
    roles.require("text")
    rows = _located(non_blank(df, roles.text), stored)
    first = with_hash(rows, roles.text).groupBy("text_hash").agg(F.min_by(F.struct("__file", "__row"), quoted(order)).alias("__at"))
    first = written_once(first, "first-keys", "zstd")  # several jobs ask for them
    fresh = new_rows_by_sketch(first, open_history(spark, history_path), open_sketches(spark, sketch_path, buckets), buckets)
    fresh = written_once(fresh, "fresh-keys", "zstd")
    found = with_hash(_rows_at(rows, fresh.filter("__at is not null").select("__at.*")), roles.text)
    bare = fresh.filter("__at is null").select("text_hash", *(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != "text_hash"))
    new = history_layout(found.unionByName(bare), df, roles, stored_at, order)  # a hash of rows without order has no row
    append_sketches(fresh.withColumn("stored_month", F.date_format(F.lit(stored_at).cast("timestamp_ntz"), "yyyy-MM")), sketch_path, buckets)
    written = Observation()
    new.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("stored_month").parquet(history_path, compression="zstd")
    return written.get["n"]
