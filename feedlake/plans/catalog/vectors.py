"""Vector queries over the ``vectors`` view: kNN, filtered and reference search,
near-duplicate pairs, past-query matching and density clusters.  Similarities are rounded
to 6 places in the reported columns on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators.blocks import best_earlier_match, near_duplicate_vectors, vector_copies
from feedlake.operators.clusters import cluster_samples, cluster_sizes, cluster_summary, density_clusters
from feedlake.operators.search import reference_row, search
from feedlake.plans.catalog.views import VECTORS
from feedlake.plans.registry import register
from feedlake.sources.tables import vectors

K = 5


def _as_queries(v):
    return v.select(F.col("row_id").alias("query_id"), "embedding")


def _rounded(hits):
    return hits.withColumn("similarity", F.round("similarity", 6))


def _knn_sql(sim: str, threshold: float, pre: str = "", post: str = "", k: int = K) -> str:
    return f"""
with v as {VECTORS},
s as (select q.row_id as query_id, c.row_id, c.level, {sim} as similarity
      from v q join v c on q.row_id <> c.row_id {pre}),
r as (select *, row_number() over (partition by query_id order by similarity desc, row_id) as rank
      from s where similarity >= {threshold})
select query_id, row_id, level, round(similarity, 6) as similarity, rank from r where rank <= {k} {post}
"""


COS = "list_cosine_similarity(q.embedding, c.embedding)"
L2 = "1 - list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@register("knn_cosine", _knn_sql(COS, 0.2), "H3 F2 B11 C12")
def knn_cosine(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(search(_as_queries(v), v, k=K, threshold=0.2, exclude_self=True))


@register("knn_cosine_blocked", _knn_sql(COS, 0.2), "H3 F2 (many-query path)")
def knn_cosine_blocked(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(search(_as_queries(v), v, k=K, threshold=0.2, exclude_self=True, max_broadcast_queries=0, rows_per_block=128))


@register("knn_l2", _knn_sql(L2, -0.3), "H3 C12")
def knn_l2(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(search(_as_queries(v), v, k=K, threshold=-0.3, metric="l2", exclude_self=True))


@register("knn_level_pre", _knn_sql(COS, 0.2, pre="and c.level >= 3 and c.level <= 6"), "B3 H3")
def knn_level_pre(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(search(_as_queries(v), v, k=K, threshold=0.2, at_least=3, at_most=6, exclude_self=True))


@register("knn_level_post", _knn_sql(COS, 0.2, post="and (level is null or (level >= 3 and level <= 6))"), "B3 H3")
def knn_level_post(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return _rounded(search(_as_queries(v), v, k=K, threshold=0.2, at_least=3, at_most=6, post_filter=True, exclude_self=True))


REF_INDEX = 7


@register(
    "knn_reference",
    f"""
with v as {VECTORS},
ref as (select * from v order by row_id limit 1 offset {REF_INDEX}),
s as (select q.row_id as query_id, c.row_id, c.level, {COS} as similarity
      from ref q join v c on q.row_id <> c.row_id),
r as (select *, row_number() over (partition by query_id order by similarity desc, row_id) as rank
      from s where similarity >= 0.0)
select query_id, row_id, level, round(similarity, 6) as similarity, rank from r where rank <= 10
""",
    "D5 D6 H3",
)
def knn_reference(spark, sf_dir):
    v = vectors(spark, sf_dir)
    ref = reference_row(v, REF_INDEX, text=None)
    return _rounded(search(_as_queries(ref), v, k=10, threshold=0.0, exclude_self=True))


def _pairs_sql(threshold: float) -> str:
    return f"""
with v as {VECTORS}
select a.row_id as a, b.row_id as b, round(list_cosine_similarity(a.embedding, b.embedding), 6) as similarity
from v a join v b on a.row_id < b.row_id
where list_cosine_similarity(a.embedding, b.embedding) >= {threshold}
"""


@register("near_duplicates", _pairs_sql(0.40), "D3 pair stage")
def near_duplicates(spark, sf_dir):
    return _rounded(near_duplicate_vectors(vectors(spark, sf_dir), 0.40, rows_per_block=256))


@register("near_duplicates_strict", _pairs_sql(0.95), "D3 at the default 0.95")
def near_duplicates_strict(spark, sf_dir):
    return _rounded(near_duplicate_vectors(vectors(spark, sf_dir), 0.95))


@register(
    "vector_copies",
    f"with v as {VECTORS} select row_id, min(row_id) over (partition by embedding) as rep from v",
    "D3 (exact copies)",
)
def vector_copies_q(spark, sf_dir):
    return vector_copies(vectors(spark, sf_dir))


@register(
    "match_past_queries",
    f"""
with p as ({_pairs_sql(0.40)}),
r as (select b as query_id, a as match_id, similarity,
             row_number() over (partition by b order by similarity desc, a) as rn from p)
select query_id, match_id, similarity from r where rn = 1
""",
    "D4",
)
def match_past_queries(spark, sf_dir):
    """Best earlier match per query; copies of a query are answered by its first copy."""
    return best_earlier_match(vectors(spark, sf_dir), 0.40, rows_per_block=256)


EPS = 0.65

_CLUSTER_SQL = f"""
with recursive v as {VECTORS},
nb as materialized (select a.row_id a, b.row_id b from v a join v b
                    on a.row_id = b.row_id or 1 - list_cosine_similarity(a.embedding, b.embedding) <= {EPS}),
core as materialized (select a id from nb group by a having count(*) >= 3),
ed as materialized (select a, b from nb where a in (select id from core) and b in (select id from core)),
reach(s, n) as (select id, id from core union select r.s, ed.b from reach r join ed on ed.a = r.n),
comp as materialized (select s id, min(n) root from reach group by s),
num as materialized (select id, dense_rank() over (order by root) - 1 cluster from comp),
lab as materialized (
  select v.row_id, cast(coalesce((select cluster from num where num.id = v.row_id),
                          (select min(cluster) from nb join num on nb.b = num.id where nb.a = v.row_id), -1) as int) as cluster,
         v.row_id in (select id from core) as is_core
  from v)
"""


def _labels(spark, sf_dir):
    return density_clusters(vectors(spark, sf_dir), eps=EPS, min_size=3, rows_per_block=256)


@register("density_clusters", _CLUSTER_SQL + "select row_id, cluster, is_core from lab", "H4")
def density_clusters_q(spark, sf_dir):
    return _labels(spark, sf_dir)


@register(
    "cluster_summary",
    _CLUSTER_SQL
    + """select count(*) as n_rows, count(distinct case when cluster <> -1 then cluster end) as n_clusters,
       count(*) filter (where cluster = -1) as n_noise, count(*) filter (where is_core) as n_core from lab""",
    "E14 G4",
)
def cluster_summary_q(spark, sf_dir):
    return cluster_summary(_labels(spark, sf_dir))


@register("cluster_sizes", _CLUSTER_SQL + "select cluster, count(*) as n from lab group by 1", "E14")
def cluster_sizes_q(spark, sf_dir):
    return cluster_sizes(_labels(spark, sf_dir))


@register(
    "cluster_samples",
    _CLUSTER_SQL
    + """, r as (select row_id, cluster, row_number() over (partition by cluster order by row_id) as rank from lab)
select r.row_id, r.cluster, r.rank, v.level from r join v on v.row_id = r.row_id
where r.rank <= case when r.cluster = -1 then 3 else 5 end""",
    "F5",
)
def cluster_samples_q(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("row_id", "level")
    return cluster_samples(_labels(spark, sf_dir), rows).select("row_id", "cluster", "rank", "level")


@register(
    "similarity_to_first",
    f"""
with v as {VECTORS}, f as (select embedding as e0 from v order by row_id limit 1)
select row_id, round(list_cosine_similarity(embedding, e0), 6) as cosine,
       round(1 - list_sum(list_transform(list_zip(embedding, e0), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) as l2_similarity
from v, f
""",
    "C12",
)
def similarity_to_first(spark, sf_dir):
    """Row-level similarity columns (JVM higher-order functions) of every vector to the first."""
    from feedlake.functions.vectors import cosine, l2_similarity

    v = vectors(spark, sf_dir)
    # the first vector enters as a scalar subquery (one value, no join)
    e0 = v.orderBy("row_id").limit(1).select("embedding").scalar()
    with_first = v.withColumn("e0", e0)
    return with_first.select(
        "row_id",
        F.round(cosine("embedding", "e0"), 6).alias("cosine"),
        F.round(l2_similarity("embedding", "e0"), 6).alias("l2_similarity"),
    )
