"""Month sketches of the history and the descent through its months."""

import os
import random

import pytest
from pyspark.sql import functions as F

from feedlake.operators.dedupe import new_rows
from feedlake.session import scratch_path
from feedlake.sources.history import append_new_history, months_for, open_history, read_history, read_newest
from feedlake.sources.sketches import append_new_sketched, append_sketches, compact_sketches, merged, month_sketches, new_rows_by_sketch, open_sketches, possible_hits


def rows(spark, numbers):
    return spark.createDataFrame([(i, f"text number {i}", i % 5) for i in numbers], "row_id long, Text string, Level long")


def months_of(df):
    """The months that the plan's scan may read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {m for m in ("2024-01", "2024-02", "2024-03", "2024-04") if m in "".join(line for line in plan.splitlines() if "PartitionFilters" in line)}


@pytest.fixture(scope="module")
def stored(spark):
    path, sketches = scratch_path(spark, "t-sketched"), scratch_path(spark, "t-sketches")
    for month, numbers in enumerate((range(60), range(50, 120), range(120, 150)), 1):
        append_new_sketched(rows(spark, numbers), path, sketches, f"2024-0{month}-05 00:00:00")
    return path, sketches


def test_appends_equal_the_plain_ingest(spark, stored):
    path = scratch_path(spark, "t-plain")
    counts = [append_new_history(rows(spark, n), path, f"2024-0{m}-05 00:00:00") for m, n in enumerate((range(60), range(50, 120), range(120, 150)), 1)]
    assert counts == [60, 60, 30]
    plain, sketched = ({(r.text_hash, r.stored_month) for r in open_history(spark, p).collect()} for p in (path, stored[0]))
    assert plain == sketched
    assert append_new_sketched(rows(spark, range(150)), *stored, "2024-04-05 00:00:00") == 0


def test_no_stored_hash_is_missed_and_few_others_hit(spark, stored):
    history, sketches = open_history(spark, stored[0]), open_sketches(spark, stored[1])
    hits = possible_hits(history, sketches)
    own = history.select("text_hash", "stored_month")
    assert own.join(hits, ["text_hash", "stored_month"], "left_anti").count() == 0
    absent = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("text_hash"))
    assert possible_hits(absent, sketches).count() < 20


def test_only_months_with_hits_are_read(spark, stored):
    history, sketches = open_history(spark, stored[0]), open_sketches(spark, stored[1])
    some = history.filter("stored_month = '2024-02'").limit(3).select("text_hash")
    batch = some.unionAll(spark.createDataFrame([("new",), (None,)], "text_hash string"))
    fresh = new_rows_by_sketch(batch, history, sketches)
    assert sorted(r.text_hash or "" for r in fresh.collect()) == ["", "new"]
    assert months_of(fresh) == {"2024-02"}
    none = new_rows_by_sketch(spark.createDataFrame([("new",)], "text_hash string"), history, sketches)
    assert none.count() == 1 and months_of(none) == set()


def test_full_sketches_and_months_without_sketch_keep_the_result(spark, stored):
    history = open_history(spark, stored[0])
    batch = history.select("text_hash").unionAll(spark.createDataFrame([("new",)], "text_hash string"))
    want = {r.text_hash for r in new_rows(batch, history, "text_hash").collect()}
    full = month_sketches(history, 1).withColumn("bits", F.unhex(F.repeat(F.lit("FF"), 4096)))
    assert {r.text_hash for r in new_rows_by_sketch(batch, history, full, 1).collect()} == want == {"new"}
    part = open_sketches(spark, stored[1]).filter("stored_month <> '2024-03'")
    assert {r.text_hash for r in new_rows_by_sketch(batch, history, part).collect()} == want


def test_compacted_blocks_are_the_union_of_the_loads(spark, stored):
    path, target = scratch_path(spark, "t-loads"), scratch_path(spark, "t-compact")
    history = open_history(spark, stored[0])
    for k in (0, 1):
        append_sketches(history.filter(F.crc32("text_hash") % 2 == k), path, 8)
    compact_sketches(spark, path, target, 8)
    by = ["stored_month", "bucket"]
    assert {tuple(r) for r in open_sketches(spark, target, 8).collect()} == {tuple(r) for r in merged(month_sketches(history, 8), *by).collect()}
    assert open_sketches(spark, target, 16).count() == 0


def test_newest_rows_without_old_months(spark, stored):
    history = open_history(spark, stored[0])
    for limit, oldest in ((5, {"2024-03"}), (30, {"2024-03"}), (31, {"2024-01"}), (500, set())):
        got = read_newest(history, limit)
        assert got.collect() == read_history(history, limit=limit).collect()
        assert months_of(got) == oldest
    assert read_newest(history, 4, level=2, end="2024-02-10").collect() == read_history(history, None, "2024-02-10", 2, 4).collect()
    assert read_newest(history.limit(0), 3).count() == 0
    assert months_for(history, ["2024-03", "2024-02", "2024-01"], 31) == "2024-01"


ODD = [
    (1, "Same text", 4, "a"), (1, "Same text", 4, "a"), (0, "same  text!", 3, "b"), (None, "no place", 1, "c"), (None, "no place", 2, "d"),
    (None, "one place", 1, "e"), (7, "one place", 5, "f"), (8, " ", 1, "g"), (9, None, 1, "h"), (10, "!!", None, None), (11, "É é", 2, None),
]


@pytest.mark.parametrize("kept", [True, False])
def test_odd_rows_are_loaded_as_by_the_plain_ingest(spark, kept):
    """Repeated rows, places and hashes, rows without a place, names that a load uses itself."""
    df = spark.createDataFrame(ODD, "row_id long, text string, level int, bits string").withColumn("text_hash", F.lit("x")).repartition(3)
    path = scratch_path(spark, "odd")
    df.write.parquet(path)
    df = spark.read.parquet(path).filter("row_id is null or row_id < 11")
    plain, sketched, sketches = (scratch_path(spark, f"odd-{k}") for k in ("plain", "sketched", "sketches"))
    for rows, day in ((df.filter("level < 4"), "2024-02-01"), (df, "2024-03-01"), (df, "2024-04-01")):
        n = append_new_history(rows, plain, f"{day} 00:00:00")
        assert append_new_sketched(rows, sketched, sketches, f"{day} 00:00:00", stored=kept) == n
    got, want = (sorted(map(str, open_history(spark, p).collect())) for p in (sketched, plain))
    assert got == want and len(got) == 4


@pytest.mark.parametrize(("kept", "most"), [(True, 0.2), (False, 1.2)])
def test_a_load_writes_no_text_twice(spark, kept, most):
    """Besides the history, a load of texts that are held already keeps hashes only, and the rows once if they are not stored."""
    rng = random.Random(4)
    rows = [(i, f"{rng.getrandbits(8000):x}", 1) for i in range(300)]
    path = scratch_path(spark, "long")
    spark.createDataFrame(rows, "row_id long, text string, level int").repartition(2).write.parquet(path)
    df = spark.read.parquet(path)
    history, sketches = scratch_path(spark, "long-history"), scratch_path(spark, "long-sketches")
    folder = os.path.dirname(path).removeprefix("file:")

    def size():
        return sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names)

    assert append_new_sketched(df, history, sketches, "2024-02-01 00:00:00", buckets=4, stored=kept) == 300
    before = size()
    assert append_new_sketched(df, history, sketches, "2024-03-01 00:00:00", buckets=4, stored=kept) == 0
    assert size() - before < most * sum(len(t) for _, t, _ in rows)


def test_rows_are_not_shuffled(spark):
    """A load finds its rows by bitmaps: above the scan that reads them is no exchange."""
    from feedlake.sources.sketches import _located, _rows_at

    path = scratch_path(spark, "places")
    spark.range(0, 100_000, 1, 3).selectExpr("id as row_id", "cast(id as string) as text").write.parquet(path)
    rows = _located(spark.read.parquet(path).filter("row_id % 3 > 0"), True)
    found = _rows_at(rows, rows.filter("row_id % 1000 = 1").select("__file", "__row"))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.row_id for r in found.collect()) == [i for i in range(1, 100_000, 1000) if i % 3]
