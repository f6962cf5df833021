"""Exact vector joins that skip what the triangle inequality rules out.

A unit vector's cosine to another one is a distance in disguise: ``|u - v|**2 = 2 - 2 cos``.  A bounded
table of pivots is drawn from the data and every vector belongs to the cell of its nearest pivot (a
Voronoi partition).  For a cell we keep its radius, the largest distance of a member to its pivot.  Two
vectors of cells ``i`` and ``j`` are at least ``|p_i - p_j| - r_i - r_j`` apart, so cell pairs beyond the wanted distance are never
formed; and a member of ``i`` meets cell ``j`` only if its own distance to ``p_j`` is at most ``r_j`` plus the wanted distance.

Cells of more than ``rows_per_block`` members are dealt to parts by a hash.  Parts that follow each other make up a
block; a task holds a pair of blocks and compares strips of at most ``rows_per_block`` rows with a bounded number of
others at a time.  Blocks grow with the table up to ``BLOCK_BYTES`` of vectors and only then become more than
``BLOCKS``, so a vector is sent at most ``BLOCKS`` times and what is shuffled grows with the table, not with its
square, until a table has ``BLOCKS * BLOCK_BYTES`` of vectors.  The comparisons that are saved depend on the data: clustered vectors leave
most out, and vectors without structure leave none out, where the work is that of all pairs.

Zero vectors have similarity 0 to everything and belong to no cell; callers with a threshold of 0
or less must handle them (``similar_points`` does).  Vectors with a component that is null or not finite are similar to
nothing and are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Room for rounding in bounds: a dot product of unit vectors is off by some 1e-16, and the square root
#: makes 1e-8 of that near distance 0.
SLACK = 1e-7
MOST_PIVOTS = 1024
PLACED = "id long, embedding array<double>, weight long, cell int, part int, distance double"
SPREAD = "i int, j int, own boolean, id long, weight long, cell int, distance double, embedding binary"
#: Blocks of a table of vectors, while none is larger than ``BLOCK_BYTES``; similarities held at a time.
BLOCKS = 16
BLOCK_BYTES = 32 << 20
HELD = 1 << 20


def block_count(n: int, dim: int, rows_per_block: int) -> int:
    """Blocks of ``n`` vectors: as many as bound a task's memory, and some for parallel work."""
    return max(1, min(BLOCKS, -(-n // rows_per_block)), -(-n * dim * 8 // BLOCK_BYTES))


def usable(vector: str) -> Column:
    """True for vectors that may be similar to another: not zero, and all components finite."""
    return F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1)
    return np.divide(matrix, norm[:, None], out=np.zeros_like(matrix), where=norm[:, None] > 0)


def matrix_of(vectors: pd.Series) -> np.ndarray:
    """Rows of vectors, which are lists or the bytes of doubles."""
    if len(vectors) and isinstance(vectors.iloc[0], bytes):
        return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def chord(similarity: float) -> float:
    """Distance of unit vectors with this cosine."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * min(1.0, similarity)))


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of unit rows."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (left @ right.T)))


def choose_pivots(points: DataFrame, n_points: int, rows_per_block: int, most: int = MOST_PIVOTS) -> np.ndarray:
    """Unit pivots: the vectors with the smallest hashes of their ids, about one for every
    ``rows_per_block`` points, at least 8 and at most ``most`` (the bound of what the driver reads and sends to the tasks)."""
    wanted = min(most, n_points, max(8, 2 * -(-n_points // rows_per_block)))
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("embedding").toPandas()
    return unit_rows(matrix_of(drawn["embedding"]))


def place(points: DataFrame, pivots: np.ndarray, n_points: int, rows_per_block: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(points with unit ``embedding``, ``cell``, ``part`` and ``distance`` to the cell's pivot; radius of
    every cell; parts of every cell)."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            unit = unit_rows(matrix_of(rows["embedding"]))
            away = distances(unit, shared.value)
            cell = away.argmin(1)
            yield pd.DataFrame({"id": rows["id"], "embedding": list(unit), "weight": rows["weight"], "cell": cell.astype(np.int32), "part": 0, "distance": away[np.arange(len(cell)), cell]})

    placed = points.select("id", "embedding", "weight").mapInPandas(nearest, PLACED).checkpoint()
    radius, parts = np.full(len(pivots), -1.0), np.ones(len(pivots), np.int64)
    for row in placed.groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n")).collect():  # a row per pivot
        radius[row["cell"]], parts[row["cell"]] = row["r"], -(-row["n"] // rows_per_block)
    by_cell = F.array(*(F.lit(int(p)) for p in parts))
    return placed.withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(by_cell, F.col("cell") + 1)).cast("int")), radius, parts


def near_cells(pivots: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """True for pairs of cells that may hold vectors within ``reach`` of each other."""
    apart = distances(pivots, pivots) - radius[:, None] - radius[None, :]
    return (apart <= reach + SLACK) & (radius >= 0)[:, None] & (radius >= 0)[None, :]


def blocks_of(parts: np.ndarray, radius: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each cell's first part in the row of all parts, number of parts, whether a cell (row) has a part in a block (column))."""
    live = np.where(radius >= 0, parts, 0)
    first, total = np.cumsum(live) - live, max(1, int(live.sum()))
    low, high = first * blocks // total, (first + live - 1) * blocks // total
    at = np.arange(blocks)
    return first, np.array(total), (at >= low[:, None]) & (at <= high[:, None]) & (live > 0)[:, None]


def spread(placed: DataFrame, pivots: np.ndarray, mine: tuple, others: tuple, reach: float, own: bool | None = None) -> DataFrame:
    """One row per vector and pair of blocks ``(i, j)`` it takes part in.  ``mine`` and ``others`` are ``(radius, parts, blocks)`` of the
    vectors and of those they are compared with.  ``own`` tells on which side the vectors are: ``i`` if true and ``j`` if
    false; without it a table meets itself, ``i <= j``, and ``own`` is true for the vectors of block ``i``.

    A vector goes to every block that holds a cell that it may have a neighbour in."""
    radius, parts, blocks = others
    _, _, holds = blocks_of(parts, radius, blocks)
    first, total, _ = blocks_of(mine[1], mine[0], mine[2])
    shared = placed.sparkSession.sparkContext.broadcast((pivots, radius, holds, first, int(total)))
    my_blocks = mine[2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, radius, holds, first, total = shared.value
        for batch in batches:
            for start in range(0, len(batch), 1024):
                rows = batch.iloc[start : start + 1024]
                unit, cell = matrix_of(rows["embedding"]), rows["cell"].to_numpy()
                block = (first[cell] + rows["part"].to_numpy()) * my_blocks // total
                near = (distances(unit, pivots) <= radius[None, :] + reach + SLACK) & (radius >= 0)[None, :]
                meets = near.astype(np.float32) @ holds.astype(np.float32) > 0
                if own is None:
                    meets[np.arange(len(rows)), block] = True
                row, other = np.nonzero(meets)
                block = block[row]
                left = block <= other if own is None else np.full(len(row), own)
                data = np.array([v.tobytes() for v in unit] + [None], object)[:-1]
                yield pd.DataFrame({
                    "i": np.where(left, block, other), "j": np.where(left, other, block), "own": left, "id": rows["id"].array[row],
                    "weight": rows["weight"].array[row], "cell": cell[row], "distance": rows["distance"].to_numpy()[row], "embedding": data[row],
                })

    return placed.mapInPandas(run, SPREAD)


class Side:
    """Rows of one block in the order of their cells."""

    def __init__(self, rows: pd.DataFrame):
        if "cell" not in rows.columns:
            rows = rows.assign(cell=0, distance=2.0)
        rows = rows.sort_values("cell", kind="stable")
        self.id, self.weight = rows["id"].to_numpy(), rows["weight"]
        self.cell, self.distance = rows["cell"].to_numpy(), rows["distance"].to_numpy()
        self.matrix = matrix_of(rows["embedding"])

    def __len__(self) -> int:
        return len(self.id)

    def strips(self, height: int) -> Iterator[tuple[int, int]]:
        """Runs of at most ``height`` rows of one cell."""
        cuts = np.flatnonzero(np.diff(self.cell)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self)], strict=True):
            for at in range(start, end, height):
                yield at, min(end, at + height)


def sides(key: tuple, rows: pd.DataFrame) -> tuple[Side, Side, bool]:
    """(first block, second block, whether they are the same)."""
    half = len(key) // 2
    one = tuple(key[:half]) == tuple(key[half:])
    left = Side(rows if one else rows[rows["own"]])
    return left, left if one else Side(rows[~rows["own"]]), one


def tiles(left: Side, right: Side, one: bool, reach: float, pivots: np.ndarray | None, height: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``left`` and ``right`` that hold all neighbours within ``reach``.  A block compared with itself gives
    every two strips once, and each strip with itself."""
    if not len(left) or not len(right):
        return
    for start, end in left.strips(height):
        y = np.arange(start if one else 0, len(right))
        if pivots is not None:
            away = distances(right.matrix[y], pivots[left.cell[start]][None, :])[:, 0]
            y = y[away <= left.distance[start:end].max() + reach + SLACK]
        width = max(1, HELD // (end - start))
        for at in range(0, len(y), width):
            yield np.arange(start, end), y[at : at + width]


class PointGrid:
    """Vectors placed in cells for joins at one similarity."""

    def __init__(self, points: DataFrame, similarity: float, rows_per_block: int = 2048):
        """``points``: ``(id, embedding, weight)``; only usable vectors take part."""
        self.reach = chord(similarity)
        known = points.filter(usable("embedding")).select("id", "embedding", "weight")
        self.n, self.rows_per_block = known.count(), rows_per_block
        self.pivots = choose_pivots(known, self.n, rows_per_block)
        self.blocks = block_count(self.n, self.pivots.shape[-1], rows_per_block)
        self.placed, self.radius, self.parts = place(known, self.pivots, self.n, rows_per_block) if self.n else (known, np.zeros(0), np.zeros(0, np.int64))

    def side(self) -> tuple[np.ndarray, np.ndarray, int]:
        return self.radius, self.parts, self.blocks

    def tiles(self, weights: DataFrame | None = None) -> DataFrame:
        """Pairs of blocks, grouped by ``(i, j)``; ``weights`` ``(id, weight)`` takes the place of the points' own."""
        placed = self.placed if weights is None else self.placed.drop("weight").join(weights, "id").select(self.placed.columns)
        return spread(placed, self.pivots, self.side(), self.side(), self.reach).groupBy("i", "j")

    def skipped(self) -> float:
        """Share of the pairs of parts that are not formed."""
        near = near_cells(self.pivots, self.radius, self.reach)
        live = self.parts * (self.radius >= 0)
        every = live.sum() * (live.sum() + 1) / 2
        formed = (np.triu(near, 1) * np.outer(live, live)).sum() + (live * (live + 1) / 2).sum()
        return float(1 - formed / every) if every else 0.0


def similar_points(df: DataFrame, id_col: str, vec_col: str, threshold: float, rows_per_block: int = 2048) -> DataFrame:
    """All unordered pairs ``(a < b, similarity)`` of rows with cosine >= ``threshold``, which must be above 0: a
    zero vector is similar to nothing, and rows without a vector take no part."""
    if threshold <= 0:
        raise ValueError("pivots bound positive similarities only")
    points = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.lit(1).cast("long").alias("weight"))
    grid = PointGrid(points.filter("id is not null"), threshold, rows_per_block)
    if not grid.n:
        return df.sparkSession.createDataFrame([], "a long, b long, similarity double")
    reach, shared = grid.reach, df.sparkSession.sparkContext.broadcast(grid.pivots)

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, x, y, sims in compared(tuple(k.as_py() for k in key), pa.Table.from_batches(batches).to_pandas(), reach, shared.value, rows_per_block):
            at, to = np.divmod(np.flatnonzero(sims >= threshold), len(y))
            a, b = left.id[x[at]], right.id[y[to]]
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(sims[at, to][keep])], ["a", "b", "similarity"])

    return grid.tiles().applyInArrow(pairs, "a long, b long, similarity double")


def compared(key: tuple, rows: pd.DataFrame, reach: float, pivots: np.ndarray | None, height: int) -> Iterator[tuple[Side, Side, np.ndarray, np.ndarray, np.ndarray]]:
    """(first block, second block, rows of the first, rows of the second, their cosines): every two rows of the pair of blocks that may be
    within ``reach`` once; -2 stands at a row and itself or an earlier one."""
    left, right, one = sides(key, rows)
    for x, y in tiles(left, right, one, reach, pivots, height):
        sims = left.matrix[x] @ right.matrix[y].T
        if one and y[0] <= x[-1]:
            sims[y[None, :] <= x[:, None]] = -2.0
        yield left, right, x, y, sims


def best_earlier(points: DataFrame, threshold: float, rows_per_block: int, digits: int) -> DataFrame:
    """``(b, a, similarity)`` of points ``(id, embedding)``: for each point the best one of a smaller id in every pair of blocks, if it
    reaches ``threshold`` (above 0), by similarity rounded to ``digits``, then by id.  One row per point and pair of blocks at most."""
    named = points.filter("id is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(1).cast("long").alias("weight"))
    grid = PointGrid(named, threshold, rows_per_block)
    schema = "b long, a long, similarity double"
    if not grid.n:
        return points.sparkSession.createDataFrame([], schema)
    reach, shared, scale = grid.reach, points.sparkSession.sparkContext.broadcast(grid.pivots), 10.0**digits

    def best(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        found, waiting, held = (none, none, np.zeros(0)), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            b, a, s = (np.concatenate(c) for c in zip(found, *waiting, strict=True))
            order = np.lexsort((a, -s, b))
            order = order[np.r_[True, b[order][1:] != b[order][:-1]]] if len(order) else order
            return b[order], a[order], s[order]

        for left, right, x, y, sims in compared(key, rows, reach, shared.value, rows_per_block):
            at, to = np.divmod(np.flatnonzero(sims >= threshold), len(y))
            p, q = left.id[x[at]], right.id[y[to]]
            keep = p != q
            waiting.append((np.maximum(p, q)[keep], np.minimum(p, q)[keep], np.floor(sims[at, to][keep] * scale + 0.5) / scale))
            held += int(keep.sum())
            if held > HELD:
                found, waiting, held = merged(), [], 0
        b, a, s = merged()
        return pd.DataFrame({"b": b, "a": a, "similarity": s})

    return grid.tiles().applyInPandas(best, schema)


def top_hits(q: Side, c: Side, k: int, threshold: float | None, exclude_self: bool, similarity, height: int, pivots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``c``, similarity): the ``k`` best rows of ``c`` for every row of ``q``, ties by id.

    With ``pivots`` similarities are cosines; rows are then visited in the order of their distance to the pivot of the strip, and left
    out from where no row can be as near as the least of the strip's bounds asks for."""
    from feedlake.operators.blocks import SIMILARITY_DIGITS

    least = -np.inf if threshold is None else threshold
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for start, end in q.strips(height) if len(q) and len(c) else ():
        order, away = np.arange(len(c)), None
        if pivots is not None:
            away = distances(c.matrix, pivots[q.cell[start]][None, :])[:, 0]
            order = np.argsort(away, kind="stable")
            away = away[order]
        bound = np.full(end - start, least)
        best, width = out[0], max(1, HELD // (end - start))
        for at in range(0, len(order), width):
            if away is not None and away[at] > q.distance[start:end].max() + chord(bound.min()) + SLACK:
                break
            y = order[at : at + width]
            sims = similarity(q.matrix[start:end], c.matrix[y])
            row, to = np.divmod(np.flatnonzero(sims >= (bound - 2 * 10.0**-SIMILARITY_DIGITS)[:, None]), len(y))
            s, to = np.round(sims[row, to], SIMILARITY_DIGITS), y[to]
            keep = s >= least
            if exclude_self:
                keep &= c.id[to] != q.id[start + row]
            if not keep.any():
                continue
            row, to, s = (np.concatenate([old, new[keep]]) for old, new in zip(best, (row, to, s), strict=True))
            rank = np.lexsort((c.id[to], -s, row))
            first = np.r_[0, np.flatnonzero(np.diff(row[rank])) + 1]
            place = np.arange(len(rank)) - np.repeat(first, np.diff(np.r_[first, len(rank)]))
            last = rank[place == k - 1]
            bound[row[last]] = s[last]
            best = tuple(v[rank[place < k]] for v in (row, to, s))
        out.append((best[0] + start, best[1], best[2]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def hits_frame(q: Side, c: Side, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
    row, to, s = found
    return pd.DataFrame({"query_id": q.id[row], "row_id": c.id[to], "level": pd.array(c.weight.array[to], dtype="Int32"), "similarity": s})


def knn_pivots(queries: DataFrame, corpus: DataFrame, k: int, threshold: float, exclude_self: bool, rows_per_block: int) -> DataFrame:
    """Candidates ``(query_id, row_id, level, similarity)`` that hold the ``k`` nearest corpus rows of every
    query by cosine, of similarity ``threshold`` (above 0) or more.

    Queries and corpus are placed by the same pivots.  A task holds a block of queries and a block of the corpus that may reach
    ``threshold`` and visits the corpus from the queries' cell outwards: their ``k``-th similarity so far, or the threshold, bounds how
    far a better hit may be.  It hands on ``k`` hits per query at most."""
    spark = corpus.sparkSession
    hits = "query_id long, row_id long, level int, similarity double"
    points = corpus.select(F.col("row_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("level").cast("long").alias("weight"))
    grid = PointGrid(points, threshold, rows_per_block)
    asked = queries.filter(usable("embedding")).select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(0).cast("long").alias("weight"))
    n = asked.count()
    if not grid.n or not n:
        return spark.createDataFrame([], hits)
    placed, radius, parts = place(asked, grid.pivots, n, rows_per_block)
    wanting = radius, parts, block_count(n, grid.pivots.shape[1], rows_per_block)
    both = spread(placed, grid.pivots, wanting, grid.side(), grid.reach, own=True).unionAll(spread(grid.placed, grid.pivots, grid.side(), wanting, grid.reach, own=False))
    shared = spark.sparkContext.broadcast(grid.pivots)  # at most MOST_PIVOTS vectors

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        q, c = Side(rows[rows["own"]]), Side(rows[~rows["own"]])
        return hits_frame(q, c, top_hits(q, c, k, threshold, exclude_self, lambda x, y: x @ y.T, rows_per_block, shared.value))

    return both.groupBy("i", "j").applyInPandas(top, hits)
