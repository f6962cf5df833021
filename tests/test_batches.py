"""Rows reach Python workers in batches of bounded size."""

import pyarrow as pa
import pytest

import corpus_pipeline
from feedlake.llm.queries import table
from feedlake.session import BATCH_BYTES
from tests.conftest import SF_SMALL

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})


@pytest.mark.parametrize("ready", [corpus_pipeline._ready, lambda spark: table(spark, SF_SMALL, "documents")])
@pytest.mark.parametrize(("before", "most"), [(None, BATCH_BYTES), ("1g", BATCH_BYTES), ("1m", 1 << 20), ("100000", 100_000)])
def test_no_batch_is_large(spark, ready, before, most):
    own = spark.newSession()
    if before:
        own.conf.set(KEY, before)
    ready(own)
    texts = own.range(0, 1500, 1, 1).selectExpr("repeat('x', 10000) text")
    found = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 1500
    assert max(r["size"] for r in found) < most + 20_000
