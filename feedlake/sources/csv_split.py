"""Quoted CSV files read in many tasks, although cells may hold line breaks.

A line break ends a record only where the quotes before it are even in number.  Spark's text
source splits files at line breaks, so each split can count its quotes and, for either parity
at its begin, the records that end in it.  A prefix sum over these counts (one row per split)
gives every split its parity and the number of its first record.  A second pass then puts
records together inside the splits.  Only records that a split or batch end cuts leave their
task; they are joined by record number.  ``row_id`` counts records over all files in path
order, without gaps.

Cells that hold quotes must be quoted, inner quotes doubled, files be UTF-8 with one header each.
A file with an odd number of quotes raises.  Empty lines outside quotes are skipped.  In a file
whose first line ends in CRLF, that is the line break everywhere and a cell's is read as LF.  The text is
scanned three times; the splits must stay the same meanwhile, otherwise the read raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.session import scratch_path, ship_package
from feedlake.sources.csv import infer_types, null_tokens

MOST_SPLITS = 1_000_000  # rows of the split table that are broadcast at most


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of rows that agree in all columns."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    cut = [0, *np.flatnonzero(change).tolist(), len(change)]
    return ((a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a)


def _marks(value: pa.Array, parity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line the parity of quotes before and after it, and whether it is empty."""
    quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    after = (parity + np.cumsum(quotes)) & 1
    before = np.concatenate([[parity], after[:-1]])
    empty = pc.is_in(value, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
    return before, after, empty


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, start, quotes, ends0, ends1, crlf)`` of each split: parity of its quotes, records that
    end in it if it begins outside or inside quotes, whether its first line ends in CRLF."""
    held: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        name = batch.column(1).dictionary_encode()
        code, start = name.indices.to_numpy(), batch.column(2).to_numpy()
        for a, b in _runs(code, start):
            crlf = batch.column(0)[a].as_py().endswith("\r")
            state = held.setdefault((name.dictionary[code[a]].as_py(), int(start[a])), [0, 0, 0, crlf])
            _, after, empty = _marks(batch.column(0).slice(a, b - a), state[0])
            state[0] = int(after[-1])
            state[1] += int(((after == 0) & ~empty).sum())
            state[2] += int(((after == 1) & ~empty).sum())
    rows = [(f, s, *v) for (f, s), v in held.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "start", "quotes", "ends0", "ends1", "crlf"])


def split_table(lines: DataFrame) -> DataFrame:
    """``(file, start, open, first, header, headers, odd, crlf)``: parity at a split's begin, numbers of
    its first record and of its file's header, files with records up to this one, parity of its
    file's quotes, whether its file's first line ends in CRLF."""
    tally = lines.mapInArrow(_tally, "file string, start long, quotes long, ends0 long, ends1 long, crlf boolean")
    own = Window.partitionBy("file").orderBy("start")
    every = Window.orderBy("file", "start")  # one row per split
    prior, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(Window.partitionBy("file"))
    marked = tally.withColumn("open", F.coalesce(F.sum("quotes").over(own.rowsBetween(*prior)), F.lit(0)) % 2)
    marked = marked.withColumn("odd", total("quotes") % 2).withColumn("ends", F.when(F.col("open") == 0, F.col("ends0")).otherwise(F.col("ends1")))
    marked = marked.withColumn("begins", ((F.row_number().over(own) == 1) & (total("ends") > 0)).cast("long"))
    marked = marked.withColumn("first", F.coalesce(F.sum("ends").over(every.rowsBetween(*prior)), F.lit(0))).withColumn("headers", F.sum("begins").over(every.rowsBetween(*upto)))
    return marked.select("file", "start", "open", "first", F.min("first").over(Window.partitionBy("file")).alias("header"), "headers", "odd", F.first("crlf").over(own).alias("crlf"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records, without the headers, as ``(record, row_id, place, line, whole, text)``."""
    now, parity, ended, line = None, 0, 0, 0
    for batch in batches:
        value, place, opens, first, header, headers, crlf = batch.columns
        place = place.to_numpy()
        for a, b in _runs(place):
            if now != place[a]:
                now, parity, ended, line = place[a], opens[a].as_py(), first[a].as_py(), 0
            before, after, empty = _marks(value.slice(a, b - a), parity)
            empty &= (before == 0) & (after == 0)
            end = (after == 0) & ~empty
            number = ended + np.cumsum(end) - end
            kept = np.flatnonzero(~empty)
            texts = value.slice(a, b - a).take(pa.array(kept))
            texts = (pc.replace_substring_regex(texts, r"\r\z", "") if crlf[a].as_py() else texts).to_pylist()
            cuts = list(_runs(number[kept])) if len(kept) else []
            record = np.array([number[kept[x]] for x, _ in cuts], np.int64)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(record),
                    pa.array(record - headers[a].as_py()),
                    pa.array(np.full(len(cuts), now, np.int64)),
                    pa.array([line + int(kept[x]) for x, _ in cuts], pa.int64()),
                    pa.array([bool(before[kept[x]] == 0 and end[kept[y - 1]]) for x, y in cuts], pa.bool_()),
                    pa.array(["\n".join(texts[x:y]) for x, y in cuts], pa.string()),
                ],
                ["record", "row_id", "place", "line", "whole", "text"],
            )
            yield out.filter(pc.not_equal(out.column(0), header[a]))
            parity, ended, line = int(after[-1]), ended + int(end.sum()), line + b - a


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, row_id: str = "row_id") -> DataFrame:
    """Header CSV file(s) with quoted, possibly multi-line text: the cells of ``read_feedback_csv``,
    read in as many tasks as the files have splits, with an exact ``row_id``.  All files have the
    columns of the first; types are inferred unless a schema is given."""
    ship_package(spark)
    columns = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    lines = _lines(spark, path)
    at = scratch_path(spark, "splits")
    split_table(lines).write.parquet(at)
    splits = spark.read.parquet(at)
    if not splits.filter("odd = 1").isEmpty():
        raise ValueError(f"a file of {path} has an odd number of quotes")
    if splits.limit(MOST_SPLITS + 1).count() > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits in {path}; raise spark.sql.files.maxPartitionBytes")
    placed = lines.join(F.broadcast(splits), ["file", "start"], "left")  # keeps the lines' order
    known = F.when(F.col("open").isNull(), F.raise_error(F.lit("the files' splits changed between two passes"))).otherwise(F.col("open")).cast("long")
    rows = placed.select("value", F.xxhash64("file", "start").alias("place"), known.alias("open"), "first", "header", "headers", "crlf")
    numbered = rows.mapInArrow(_records, "record long, row_id long, place long, line long, whole boolean, text string")
    starts = splits.select(F.xxhash64("file", "start").alias("place"), "start")
    parts = numbered.filter("not whole").join(F.broadcast(starts), "place")
    joined = parts.groupBy("record", "row_id").agg(F.array_sort(F.collect_list(F.struct("start", "line", "text"))).alias("parts"))
    joined = joined.select("row_id", F.array_join(F.col("parts.text"), "\n").alias("text"))  # one group is one record
    found = numbered.filter("whole").select("row_id", "text").unionAll(joined)
    parsed = F.from_csv("text", _ddl(columns), {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    wide = found.select(F.col("row_id").alias("__row"), parsed.alias("c")).select("__row", "c.*")
    clean = null_tokens(wide)
    typed = infer_types(clean) if schema is None else clean.select("__row", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    return typed.drop("__row") if row_id in columns else typed.select(*[F.col(f"`{c}`") for c in typed.columns if c != "__row"], F.col("__row").alias(row_id))


def _ddl(columns: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
