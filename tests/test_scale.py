"""Plan-shape checks: no driver collection in operators, pushdown, anti join, kNN without
a corpus shuffle on the broadcast path."""

import pathlib
import re

from feedlake.operators.blocks import knn
from feedlake.operators.dedupe import new_rows, with_hash
from feedlake.sources.tables import rated_orders, table, vectors

from .conftest import SF_SMALL

ROOT = pathlib.Path(__file__).resolve().parents[1] / "feedlake"
# bounded driver reads, each with a size check: kNN query matrix (checked count),
# pivots and their cells (at most MOST_PIVOTS rows), JSON key discovery (distinct keys), CSV type
# inference (one aggregate row)
# and names of stored months (at most MOST_MONTHS)
ALLOWED = {("sources/history.py", "collect"), ("sources/sketches.py", "collect"), ("operators/blocks.py", "toPandas"), ("operators/pivots.py", "toPandas"), ("operators/pivots.py", "collect"), ("functions/jsonrow.py", "toLocalIterator"), ("sources/csv.py", "first")}


def test_no_unbounded_driver_collection():
    for p in ROOT.rglob("*.py"):
        rel = str(p.relative_to(ROOT))
        if rel.startswith("llm/"):  # has its own list, in tests/llm
            continue
        for m in re.finditer(r"\.(collect|toPandas|toLocalIterator)\(\)", p.read_text()):
            assert (rel, m.group(1)) in ALLOWED, f"{rel}: {m.group(0)}"
        assert "localCheckpoint" not in p.read_text(), rel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushdown_and_pruning(spark):
    from feedlake.operators import trends as T

    df = T.compare_periods(rated_orders(spark, SF_SMALL), ("1996-01-01", "1996-12-31"), ("1997-01-01", "1997-12-31"))
    p = plan(df)
    assert "PushedFilters: [Or(" in p or "PushedFilters: [IsNotNull(o_orderdate), Or(" in p
    assert "o_custkey" not in p.split("ReadSchema")[1]


def test_anti_join_plan(spark):
    h = with_hash(table(spark, SF_SMALL, "documents").select("doc_id", "text"))
    p = plan(new_rows(h, h.limit(5), "text_hash"))
    assert "LeftAnti" in p


def test_knn_broadcast_path_has_no_corpus_exchange(spark):
    v = vectors(spark, SF_SMALL)
    q = v.limit(3).selectExpr("row_id as query_id", "embedding")
    df = knn(q, v, k=3)
    p = plan(df)
    # the only exchange is the small per-query ranking after the local top-k
    assert "MapInPandas" in p and p.count("Exchange") == 1


def test_first_per_hash_combines_before_exchange(spark):
    from pyspark.sql import functions as F

    from feedlake.operators.dedupe import first_per_key

    # a third of the rows share one key
    df = spark.range(300).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    out = first_per_key(df, "k", "row_id")
    p = out._jdf.queryExecution().executedPlan().toString()
    head, _, tail = p.partition("Exchange")
    assert "Aggregate" in head and "Aggregate" in tail  # final above, partial below the exchange
    assert out.filter("k = 'hot'").first().row_id == 0


def test_per_group_top_n_is_limited_before_exchange(spark):
    from feedlake.operators.profile import profile_top_values

    df = profile_top_values(table(spark, SF_SMALL, "documents"))
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert p.count("WindowGroupLimit") >= 2
