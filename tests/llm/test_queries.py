import pathlib
import re

import duckdb
import pytest

import __spark_entry__
import feedlake.llm
from feedlake.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF


def plain(rows):
    return sorted(tuple(sorted((k, v) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(shipped, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert plain(r.asDict() for r in QUERIES[name](shipped, SF).collect()) == plain(want)


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(QUERIES) <= set(found)
    assert "pipeline" in found and set(ORACLES) <= set(__spark_entry__.oracle_sql())


# What the driver reads, all bounded: counts by length or by task (packing, token files,
# embeddings), the most common shingles (a top-k), vote patterns, the toxicity model, the terms of
# one tile of items (ranked search), frequent codes behind a count (phrases).
DRIVER_READS = {"packing.py", "token_files.py", "embedding_dedup.py", "jaccard_join.py", "quality.py", "toxicity.py", "ranked_search.py", "phrases.py"}


def test_driver_reads_are_bounded_ones():
    for p in pathlib.Path(feedlake.llm.__file__).parent.glob("*.py"):
        if re.search(r"\.(collect|toPandas|toArrow|toLocalIterator)\(\)", p.read_text()):
            assert p.name in DRIVER_READS, p.name
        assert "localCheckpoint" not in p.read_text()
