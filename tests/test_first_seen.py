"""The stateful ingest stream: batch equality, replay, late rows, expiry."""

import time

import pytest

from feedlake.operators.dedupe import first_per_key, with_hash
from feedlake.session import scratch_path
from feedlake.streaming.first_seen import KEPT, first_seen_stream

SCHEMA = "row_id long, text string, level int"
ONE = [(5, "Hello, world", 1), (3, "hello WORLD", 2), (7, "  ", 3), (8, None, 4), (9, "other", 5)] + [(100 + i, "!!!", i) for i in range(50)]
TWO = [(1, "Hello world!", 9), (2, "new text", 8), (4, "new  text", 7)]


@pytest.fixture()
def run(spark):
    source, out, ckpt = (scratch_path(spark, f"t-{n}") for n in ("source", "out", "ckpt"))

    def go(rows=None, **options):
        if rows is not None:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = first_seen_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, out, ckpt, fmt="parquet", **options)
        assert query.awaitTermination(60)
        return sorted((r.place, r.text, r.level) for r in spark.read.schema(KEPT).parquet(out).collect())

    return go


def test_stream_equals_batch_and_resumes(spark, run):
    first = run(ONE)
    batch = first_per_key(with_hash(spark.createDataFrame(ONE, SCHEMA).filter("trim(text) <> ''")), "text_hash", "row_id")
    assert first == sorted((r.row_id, r.text, r.level) for r in batch.collect())
    assert run() == first  # nothing new arrived: a restart from the checkpoint stores nothing
    both = run(TWO)
    # the late row 1 repeats a stored text; of the new text the smaller place is first
    assert both == sorted([*first, (2, "new text", 8)])
    assert run(ONE) == both  # the same rows in a new file


def test_expired_hashes_are_stored_again(run):
    assert len(run(TWO, expire_after=0.001)) == 2
    time.sleep(0.5)
    run([(50, 'third', 1)], expire_after=0.001)  # a micro-batch in which the old keys time out
    again = run(TWO, expire_after=0.001)
    assert len(again) == 5 and len(set(again)) == 3
