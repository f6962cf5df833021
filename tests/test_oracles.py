"""Every registered query against its DuckDB oracle (sf0.001; the driver checks sf0.01)."""

import duckdb
import pytest

from feedlake.plans.registry import all_queries
from feedlake.sources.tables import TABLES
from scripts.oracle_check import compare

from .conftest import SF_SMALL

QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.oracle))
def test_matches_oracle(spark, duck, name):
    q = QUERIES[name]
    sdf = q.fn(spark, SF_SMALL)
    res = duck.execute(q.oracle)
    ok, msg = compare(sdf.columns, [tuple(r) for r in sdf.collect()], [d[0] for d in res.description], res.fetchall())
    assert ok, msg


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.oracle))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name].fn(spark, SF_SMALL)
    assert df.count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
