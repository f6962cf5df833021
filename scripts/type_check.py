"""Compare the column types of every Spark query with its DuckDB oracle (sf0.001)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from feedlake.plans.registry import all_queries  # noqa: E402
from feedlake.session import local_session  # noqa: E402
from feedlake.sources.tables import TABLES  # noqa: E402

SPARK_TO_DUCK = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT",
}

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
spark = local_session()
con = duckdb.connect()
for t in TABLES:
    con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
bad = 0
for name, q in sorted(all_queries().items()):
    if not q.oracle:
        continue
    st = dict(q.fn(spark, sf).dtypes)
    dt = {r[0]: r[1] for r in con.execute(f"describe {q.oracle}").fetchall()}
    diffs = [(c, st.get(c), dt.get(c)) for c in sorted(set(st) | set(dt)) if SPARK_TO_DUCK.get(st.get(c), st.get(c)) != dt.get(c)]
    if diffs:
        bad += 1
        print(name, diffs)
print("queries with type differences:", bad)
