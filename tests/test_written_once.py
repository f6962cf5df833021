"""A load makes its rows once, however many jobs ask for them."""

import pytest
from pyspark.sql import functions as F

from feedlake.session import scratch_path
from feedlake.sources.embeddings import append_new_embeddings
from feedlake.sources.history import append_new_history
from feedlake.sources.sketches import append_new_sketched

TEXTS = [(i, f"text number {i % 30}", i % 5) for i in range(40)]


def counted(spark, seen):
    @F.udf("string")
    def mark(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame(TEXTS, "row_id long, text string, level int")
    return rows.withColumn("text", mark.asNondeterministic()("text"))


@pytest.mark.parametrize("load", ["history", "sketched", "embeddings"])
def test_a_later_load_reads_its_rows_once(spark, load):
    path, sketches = scratch_path(spark, "once"), scratch_path(spark, "once-sketches")
    plain = spark.createDataFrame(TEXTS[:10], "row_id long, text string, level int")
    append = {
        "history": lambda df, day: append_new_history(df, path, f"2024-02-{day} 00:00:00"),
        "sketched": lambda df, day: append_new_sketched(df, path, sketches, f"2024-0{day[1]}-01 00:00:00"),
        "embeddings": lambda df, day: append_new_embeddings(df, path),
    }[load]
    append(plain, "01")
    assert spark.read.parquet(path).count() == 10
    for day in ("02", "03"):
        seen = spark.sparkContext.accumulator(0)
        append(counted(spark, seen), day)
        assert seen.value == len(TEXTS)
    got = spark.read.parquet(path)
    assert got.count() == got.select("text_hash").distinct().count() == 30
