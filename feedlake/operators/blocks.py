"""Blocked similarity work on vector columns: all qualifying pairs of one table, and
per-query top-k against a corpus.

Exact all-pairs similarity is quadratic.  We bound the memory of every task instead of the
work: rows are hashed into blocks; one task handles one pair of
blocks (two blocks of vectors and one tile of similarities at a time) and emits only the pairs that
pass the threshold, never all pairs.  Every unordered block pair is formed exactly once,
so no pair is produced twice.

Shuffle volume of the pair stage is ``rows x blocks`` (each row joins every block pair it
belongs to); the number of blocks is bounded until blocks fill a task (``pivots.block_count``), so it
grows with the rows.  The comparisons are quadratic, the price of exactness; an approximate caller can pass its own
candidate pairs instead (see ``clusters.density_clusters(candidates=...)``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each side whose similarities a task holds at a time.
HELD_ROWS = 1024
PAIR_SCHEMA = "a long, b long, similarity double"


def n_blocks_for(df: DataFrame, rows_per_block: int) -> int:
    """Number of blocks so that a block holds about ``rows_per_block`` rows (one count job)."""
    return max(1, math.ceil(df.count() / rows_per_block))


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def similarity_matrix(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Similarities of every left row to every right row, in float64.

    cosine: dot of unit vectors (a zero vector has similarity 0 to everything);
    l2: ``1 - squared Euclidean distance``."""
    if metric == "cosine":
        ln = np.linalg.norm(left, axis=1)
        rn = np.linalg.norm(right, axis=1)
        lu = np.divide(left, ln[:, None], out=np.zeros_like(left), where=ln[:, None] > 0)
        ru = np.divide(right, rn[:, None], out=np.zeros_like(right), where=rn[:, None] > 0)
        return lu @ ru.T
    if metric == "l2":
        sq = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2.0 * (left @ right.T)
        return 1.0 - np.maximum(sq, 0.0)
    raise ValueError(f"unknown metric {metric!r}")


def _pair_task(threshold: float, metric: str, by_distance: bool):
    def run(key, pdf):
        bi, bj = int(key[0]), int(key[1])
        left = pdf[pdf["__blk"] == bi]
        right = left if bi == bj else pdf[pdf["__blk"] == bj]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        lm, rm = _matrix(left["__vec"]), _matrix(right["__vec"])
        lids, rids, found = left["__id"].to_numpy(), right["__id"].to_numpy(), []
        for x in range(0, len(lm), HELD_ROWS):
            for y in range(0, len(rm), HELD_ROWS):
                sims = similarity_matrix(lm[x : x + HELD_ROWS], rm[y : y + HELD_ROWS], metric)
                ok = (1.0 - sims <= threshold) if by_distance else (sims >= threshold)
                li, rj = np.nonzero(ok)
                lid, rid = lids[x + li], rids[y + rj]
                keep = lid < rid if bi == bj else lid != rid
                lid, rid, s = lid[keep], rid[keep], sims[li, rj][keep]
                found.append(pd.DataFrame({"a": np.minimum(lid, rid), "b": np.maximum(lid, rid), "similarity": s}))
        return pd.concat(found)

    return run


def similar_pairs(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    threshold: float,
    metric: str = "cosine",
    rows_per_block: int = 2048,
    n_blocks: int | None = None,
    by_distance: bool = False,
) -> DataFrame:
    """All unordered pairs ``(a < b, similarity)`` with similarity >= ``threshold``
    (or, with ``by_distance``, cosine distance ``1 - similarity <= threshold``)."""
    if not n_blocks:
        from feedlake.operators.pivots import block_count

        size = df.agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("dim")).first()
        n_blocks = block_count(size["n"], size["dim"] or 1, rows_per_block)
    nb = n_blocks
    blk = df.select(F.col(id_col).cast("long").alias("__id"), F.col(vec_col).alias("__vec"))
    exploded = explode_block_pairs(blk, "__id", nb)
    return exploded.groupBy("__bi", "__bj").applyInPandas(_pair_task(threshold, metric, by_distance), PAIR_SCHEMA)


def explode_block_pairs(df: DataFrame, id_col: str, nb: int) -> DataFrame:
    """Add ``__blk`` (hash block of the row) and one row per unordered block pair
    ``(__bi <= __bj)`` the row belongs to: ``nb`` copies of every row."""
    blk = df.withColumn("__blk", F.pmod(F.xxhash64(F.col(id_col)), F.lit(nb)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
    return blk.withColumn("__other", other).withColumn("__bi", F.least("__blk", "__other")).withColumn(
        "__bj", F.greatest("__blk", "__other")
    ).drop("__other")


#: Similarities are rounded before ranking: the last bits of a dot product depend on where a
#: vector stands in its matrix, and equal vectors must tie so that ``row_id`` decides.
SIMILARITY_DIGITS = 12
HIT_SCHEMA = "query_id long, row_id long, level int, similarity double"


def _local_topk(q_ids: np.ndarray, c_ids: np.ndarray, sims: np.ndarray, k: int, threshold: float | None, exclude_self: bool, levels=None):
    """Per query row of ``sims``: the best k corpus columns by (similarity desc, row_id asc)."""
    out_q, out_c, out_s, out_l = [], [], [], []
    sims = np.round(sims, SIMILARITY_DIGITS)
    for i in range(sims.shape[0]):
        s = sims[i]
        mask = np.ones(len(c_ids), dtype=bool)
        if threshold is not None:
            mask &= s >= threshold
        if exclude_self:
            mask &= c_ids != q_ids[i]
        idx = np.nonzero(mask)[0]
        if len(idx) == 0:
            continue
        if len(idx) > k:
            # k-th best similarity; keep everything at least that good, then order exactly
            kth = np.partition(-s[idx], k - 1)[k - 1]
            idx = idx[-s[idx] <= kth]
        order = np.lexsort((c_ids[idx], -s[idx]))[:k]
        sel = idx[order]
        out_q.append(np.full(len(sel), q_ids[i]))
        out_c.append(c_ids[sel])
        out_s.append(s[sel])
        out_l.append(levels[sel] if levels is not None else np.full(len(sel), None, dtype=object))
    if not out_q:
        return pd.DataFrame(
            {
                "query_id": pd.Series([], dtype="int64"),
                "row_id": pd.Series([], dtype="int64"),
                "level": pd.Series([], dtype="Int32"),
                "similarity": pd.Series([], dtype="float64"),
            }
        )
    return pd.DataFrame(
        {
            "query_id": np.concatenate(out_q),
            "row_id": np.concatenate(out_c),
            "level": pd.array(np.concatenate(out_l), dtype="Int32"),
            "similarity": np.concatenate(out_s),
        }
    )


def _levels(pdf: pd.DataFrame):
    return pdf["level"].to_numpy(dtype=object) if "level" in pdf.columns else None


def knn_broadcast(queries: DataFrame, corpus: DataFrame, k: int, metric: str, threshold: float | None, exclude_self: bool, max_queries: int) -> DataFrame | None:
    """Few queries: ship the (size-checked) query matrix to every task as a broadcast
    variable and score each corpus partition locally - the corpus is never shuffled.
    Returns None when there are more than ``max_queries`` queries."""
    n = queries.limit(max_queries + 1).count()
    if n > max_queries:
        return None
    spark = corpus.sparkSession
    local = queries.select("query_id", "embedding").toPandas()
    q_ids = local["query_id"].to_numpy(dtype=np.int64)
    q_mat = _matrix(local["embedding"]) if len(local) else np.zeros((0, 0))
    bc = spark.sparkContext.broadcast((q_ids, q_mat))

    def score(batches):
        ids, mat = bc.value
        best = None
        for pdf in batches:
            if len(pdf) == 0 or len(ids) == 0:
                continue
            sims = similarity_matrix(mat, _matrix(pdf["embedding"]), metric)
            part = _local_topk(ids, pdf["row_id"].to_numpy(dtype=np.int64), sims, k, threshold, exclude_self, _levels(pdf))
            best = part if best is None else _merge_topk(pd.concat([best, part]), k)
        if best is not None and len(best):
            yield best

    return _with_level(corpus).mapInPandas(score, HIT_SCHEMA)


def _with_level(corpus: DataFrame) -> DataFrame:
    level = F.col("level").cast("int") if "level" in corpus.columns else F.lit(None).cast("int")
    return corpus.filter(F.col("embedding").isNotNull()).select(F.col("row_id").cast("long").alias("row_id"), "embedding", level.alias("level"))


def _merge_topk(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["query_id", "similarity", "row_id"], ascending=[True, False, True])
    return pdf.groupby("query_id", sort=False).head(k)


def knn_blocked(queries: DataFrame, corpus: DataFrame, k: int, metric: str, threshold: float | None, exclude_self: bool, rows_per_block: int) -> DataFrame:
    """Many queries: block both sides and group every (query block, corpus block) pair; each
    task compares ``rows_per_block`` queries with a bounded number of rows at a time and emits at most k hits per
    query.  Blocks grow with the tables (see ``pivots.block_count``), so that the copies of a row stay few."""
    from feedlake.operators.pivots import Side, block_count, hits_frame, top_hits

    dim = corpus.select(F.max(F.size("embedding"))).first()[0] or 1
    qb, cb = (block_count(rows.count(), dim, rows_per_block) for rows in (queries, corpus))
    q = queries.select(
        F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("j"),
        F.lit(True).alias("own"),
        F.col("query_id").cast("long").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.lit(None).cast("int").alias("weight"),
    )
    c = _with_level(corpus).select(
        F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("i"),
        F.pmod(F.xxhash64("row_id"), F.lit(cb)).cast("int").alias("j"),
        F.lit(False).alias("own"),
        F.col("row_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("level").alias("weight"),
    )

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        q, c = Side(rows[rows["own"]]), Side(rows[~rows["own"]])
        return hits_frame(q, c, top_hits(q, c, k, threshold, exclude_self, lambda x, y: similarity_matrix(x, y, metric), rows_per_block))

    return q.unionAll(c).groupBy("i", "j").applyInPandas(top, HIT_SCHEMA)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    threshold: float | None = None,
    exclude_self: bool = False,
    max_broadcast_queries: int = 4096,
    rows_per_block: int = 4096,
) -> DataFrame:
    """Top-k corpus rows per query: ``(query_id, row_id, level, similarity, rank)``.

    ``queries`` has ``query_id, embedding``; ``corpus`` has ``row_id, embedding`` and
    optionally ``level`` (carried along, so no join back to the corpus is needed).  More queries than
    ``max_broadcast_queries`` are joined through pivots where the threshold is a positive cosine, and
    block by block otherwise.  Hits below
    ``threshold`` are dropped before ranking; ``exclude_self`` drops ``row_id == query_id``.
    Rows without an embedding neither ask nor answer.  Ties are broken by ``row_id``.  Local candidates (at most k per query per task) are
    ranked globally with ``row_number``, which Spark limits per partition before the
    exchange (``WindowGroupLimit``)."""
    queries = queries.filter(F.col("embedding").isNotNull())
    cand = None
    if max_broadcast_queries:
        cand = knn_broadcast(queries, corpus, k, metric, threshold, exclude_self, max_broadcast_queries)
    if cand is None and metric == "cosine" and threshold is not None and threshold > 0:
        from feedlake.operators.pivots import knn_pivots

        cand = knn_pivots(queries, _with_level(corpus), k, threshold, exclude_self, rows_per_block)
    if cand is None:
        cand = knn_blocked(queries, corpus, k, metric, threshold, exclude_self, rows_per_block)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("row_id"))
    return cand.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def vector_copies(df: DataFrame, id_col: str = "row_id", vec_col: str = "embedding") -> DataFrame:
    """``(row_id, rep)``: every row with the smallest id among rows holding an identical vector
    (an aggregate over the vector value, combined map-side, joined back; AQE splits a hot
    vector's rows in the join)."""
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(vec_col).alias("__vec"))
    reps = rows.filter(F.col("__vec").isNotNull()).groupBy("__vec").agg(F.min("row_id").alias("rep"))
    return rows.join(reps, "__vec", "left").select("row_id", F.coalesce("rep", "row_id").alias("rep"))


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(__vec, vid)``: every vector once, with the smallest id among its copies."""
    return df.filter(F.col(vec_col).isNotNull()).groupBy(F.col(vec_col).alias("__vec")).agg(F.min(F.col(id_col).cast("long")).alias("vid"))


def near_duplicate_vectors(
    df: DataFrame, threshold: float = 0.95, id_col: str = "row_id", vec_col: str = "embedding", metric: str = "cosine", rows_per_block: int = 2048
) -> DataFrame:
    """Pairs ``(a < b, similarity)`` of distinct vectors with similarity >= ``threshold``.

    Identical vectors are collapsed first to their smallest id (see ``vector_copies``), so a
    large group of copies yields no pairs among itself.  Positive cosine thresholds join through
    pivots (``pivots.similar_points``), which leave out tiles that cannot hold a pair."""
    points = distinct_vectors(df, id_col, vec_col)
    if metric == "cosine" and threshold > 0:
        from feedlake.operators.pivots import similar_points

        return similar_points(points, "vid", "__vec", threshold, rows_per_block)
    return similar_pairs(points, "vid", "__vec", threshold, metric, rows_per_block)


def best_earlier_match(df: DataFrame, threshold: float, id_col: str = "row_id", vec_col: str = "embedding", rows_per_block: int = 2048, digits: int = 6) -> DataFrame:
    """``(query_id, match_id, similarity)``: for every row the most similar row with a smaller id
    (ties by id, similarities rounded to ``digits`` first), if it reaches ``threshold``.

    Pairs are formed over distinct vectors; a later copy of a vector is answered by its first
    copy, a perfect match.  Zero vectors match nothing."""
    if threshold > 0:
        from feedlake.operators.pivots import best_earlier

        pairs = best_earlier(distinct_vectors(df, id_col, vec_col).select(F.col("vid").alias("id"), F.col("__vec").alias("embedding")), threshold, rows_per_block, digits)
    else:
        pairs = near_duplicate_vectors(df, threshold, id_col, vec_col, rows_per_block=rows_per_block)
    best = pairs.groupBy(F.col("b").alias("query_id")).agg(F.max(F.struct(F.round("similarity", digits).alias("s"), (-F.col("a")).alias("m"))).alias("x"))
    first = best.select("query_id", (-F.col("x.m")).alias("match_id"), F.col("x.s").alias("similarity"))
    some = df.filter(F.exists(F.col(vec_col), lambda x: x != 0))
    again = vector_copies(some, id_col, vec_col).filter("row_id != rep")
    return first.unionByName(again.select(F.col("row_id").alias("query_id"), F.col("rep").alias("match_id"), F.lit(1.0).alias("similarity")))
