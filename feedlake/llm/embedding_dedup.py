"""Near-duplicate embeddings by sorted projection passes.

Each pass gives every vector a key of ``BITS`` concatenated random hashes (on which side of a
random hyperplane its unit vector lies) and sorts the vectors of a label by it, so that close
vectors tend to lie close in the order.  The hyperplanes are spread normally around the label's
mean, ``SPREAD`` times as widely as its vectors lie, so that a direction that a label has in common
takes no bits.  The order is cut into blocks of ``block`` vectors; each is compared with itself and
the next ``reach`` blocks.  Pairs with cosine (double precision) at or above the threshold are
links; the union over all passes counts.

A hyperplane parts two vectors at a distance ``d`` with a probability of at most ``d / (pi * t)``,
``t`` being the spread of the hyperplanes, wherever the vectors lie.  After a pass, the first keys
that a vector was not compared with show how many bits a partner would have to share with it to be
inside its window; the most bits of any of ``passes`` passes, charged to each of them, bound the probability
that all parted a pair at the threshold.  A vector leaves when this is at most ``miss``.  Those that remain, in dense
regions or large labels, go through further passes among themselves with windows twice as large, so
a link is missed with a probability of about ``miss`` at most; once the window holds what remains of a
label, the comparison is complete.  A label that fits the window takes one pass and misses nothing.

Equal vectors of a label are one point with a multiplicity, so copies form no pairs.  Vectors
that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors without label or of different length.  Rows that repeat an id and vector are one
vector.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrow_text import column
from feedlake.operators.components import connected_components
from feedlake.session import scratch_path

BITS = 62
SPREAD = 2.0
MOST_BLOCK, STEPS = 2048, 4
KEYED = "pass int, label long, dim int, hash long, point long, vector binary, agree double"


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # before squaring, so that tiny vectors keep a length
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _unpacked(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(-1, dim)


def _lists(rows: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return column(rows, name).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim)


def centres(points: DataFrame, window: int) -> DataFrame:
    """``(label, dim, centre)``: mean unit vector of each group of more than ``window`` points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dims = (column(batch, c).to_numpy() for c in ("label", "dim"))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                unit = _unit(_lists(batch.take(pa.array(at)), "vector", dim))
                names, of = np.unique(label[at], return_inverse=True)
                total = np.zeros((len(names), dim))
                np.add.at(total, of, unit)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), dim, np.int32)), pa.array(np.bincount(of)), pa.array(list(total), pa.list_(pa.float64()))], ["label", "dim", "n", "total"])

    large = points.groupBy("label", "dim").count().filter(F.col("count") > window).drop("count")
    parts = points.select("label", "dim", "vector").join(F.broadcast(large), ["label", "dim"]).mapInArrow(run, "label long, dim int, n long, total array<double>")
    means = parts.select("label", "dim", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "dim", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    listed = means.groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("means"))
    return listed.select("label", "dim", F.transform("means", lambda m: m["x"]).alias("centre"))


def keyed(points: DataFrame, passes: int, seed: list[int], window: int, threshold: float) -> DataFrame:
    """Every point (``point, label, dim, vector``) once per pass, with its key and the least
    probability that a partner agrees with it in a bit; once in all where its group fits the window."""
    distance = np.sqrt(max(0.0, 2 - 2 * threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, small = column(batch, "dim").to_numpy(), column(batch, "centre").is_null().to_numpy(zero_copy_only=False)
            for dim, few in sorted(set(zip(dims.tolist(), small.tolist(), strict=True))):
                rows = batch.take(pa.array(np.flatnonzero((dims == dim) & (small == few))))
                flat, n = _lists(rows, "vector", dim), rows.num_rows
                packed = pa.array([v.tobytes() for v in flat], pa.binary())
                if not few:
                    centre = _lists(rows, "centre", dim)
                    spread = SPREAD * np.maximum(np.sqrt(np.maximum(0, 1 - (centre * centre).sum(1))), distance)
                    away = (_unit(flat) - centre) / spread[:, None]
                for number in range(1 if few else passes):
                    code, agree = np.zeros(n, np.int64), np.ones(n)
                    if not few:
                        rng = np.random.default_rng([*seed, number, dim])
                        side = away @ rng.standard_normal((dim, BITS)) > rng.standard_normal(BITS)
                        code, agree = side @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)), 1 - distance / np.pi / spread
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int32)), column(rows, "label"), column(rows, "dim"), pa.array(code), column(rows, "point"), packed, pa.array(agree)], ["pass", "label", "dim", "hash", "point", "vector", "agree"])

    # at most one centre for every ``window`` points
    return points.join(F.broadcast(centres(points, window)), ["label", "dim"], "left").select("point", "label", "dim", "vector", "centre").mapInArrow(run, KEYED)


def ordered(rows: DataFrame, block: int) -> DataFrame:
    """The keyed points with their block in the order of all passes.  They are written once,
    because the order must not be dealt anew; only a count per task reaches the driver."""
    spark = rows.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "shard", "place"])
            at += n

    path = scratch_path(spark, "projections")
    order = ("pass", "label", "dim", "hash", "point")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{KEYED}, shard int, place long").write.parquet(path)
    placed = spark.read.schema(f"{KEYED}, shard int, place long").parquet(path)
    sizes = sorted(tuple(r) for r in placed.groupBy("shard").count().collect())
    ends = np.cumsum([n for _, n in sizes])
    bases = spark.createDataFrame([(s, int(e - n)) for (s, n), e in zip(sizes, ends, strict=True)], "shard int, base long")
    position = F.col("place") + F.col("base")
    return placed.join(F.broadcast(bases), "shard").select(*rows.columns, position.alias("position"), F.floor(position / block).cast("long").alias("block"))


def compared(rows: DataFrame, reach: int, threshold: float) -> DataFrame:
    """Links ``(a, b)`` between each block and the ``reach`` blocks behind it, ``STEPS`` of them a group."""

    def run(table: pa.Table) -> pa.Table:
        point, pos, step, number, label, dim = (table[c].to_numpy() for c in ("point", "position", "step", "pass", "label", "dim"))
        own = np.flatnonzero(step == 0)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        _, group = np.unique(np.stack([number, label, dim]), axis=1, return_inverse=True)
        group = group.reshape(-1)
        for g in np.unique(group[own]).tolist():
            at = np.flatnonzero(group == g)
            unit = _unit(_unpacked(table["vector"].take(pa.array(at)).to_pylist(), int(dim[at[0]])))
            asks = np.flatnonzero(step[at] == 0)
            for some in np.array_split(asks, -(-len(asks) // 256)):
                i, j = np.nonzero(unit[some] @ unit.T >= threshold)
                i = some[i]
                fresh = pos[at[j]] > pos[at[i]]
                i, j = at[i[fresh]], at[j[fresh]]
                left.append(np.minimum(point[i], point[j]))
                right.append(np.maximum(point[i], point[j]))
        return pa.table({"a": pa.array(np.concatenate(left)), "b": pa.array(np.concatenate(right))})

    parts = -(-reach // STEPS)
    places = [(0, part) for part in range(max(1, parts))] + [(s, (s - 1) // STEPS) for s in range(1, reach + 1)]
    offsets = F.explode(F.array(*(F.struct(F.lit(s).alias("step"), F.lit(part).alias("part")) for s, part in places))).alias("to")
    dealt = rows.drop("hash", "agree").select("*", offsets).select("*", "to.step", "to.part").withColumn("home", F.col("block") - F.col("step")).filter("home >= 0").drop("block", "to")
    return dealt.groupBy("home", "part").applyInArrow(run, "a long, b long")


def parted(rows: DataFrame, reach: int) -> DataFrame:
    """``(label, dim, point, log_miss)``: logarithm of the greatest probability that all passes of
    ``rows`` kept a pair at the threshold out of the point's windows."""
    light = rows.drop("vector")
    key = F.struct("pass", "label", "dim", "hash")
    ends = light.groupBy("block").agg(F.min_by(key, "position").alias("first"), F.max_by(key, "position").alias("last"))
    behind = ends.select((F.col("block") - reach - 1).alias("block"), F.col("first").alias("behind"))
    before = ends.select((F.col("block") + reach + 1).alias("block"), F.col("last").alias("before"))

    def needed(other: str):
        """Bits that a partner shares at least if it lies before the key ``other``; 0: all do."""
        same = (F.col(f"{other}.pass") == F.col("pass")) & (F.col(f"{other}.label") == F.col("label")) & (F.col(f"{other}.dim") == F.col("dim"))
        differ = F.col(f"{other}.hash").bitwiseXOR(F.col("hash"))
        return F.when(same, F.when(differ == 0, BITS + 1).otherwise(BITS + 1 - F.length(F.bin(differ)))).otherwise(0)

    bits = F.greatest(needed("behind"), needed("before"))
    placed = light.join(behind, "block", "left").join(before, "block", "left").withColumn("bits", bits)
    # A pass whose planes lie close to the point needs few bits but parts more, so all are charged alike.
    most = placed.groupBy("label", "dim", "point").agg(F.count("*").alias("n"), F.max("bits").alias("bits"), F.min("agree").alias("agree"))
    log_miss = F.when(F.col("bits") == 0, -1e9).when(F.col("bits") > BITS, 0.0).otherwise(F.col("n") * F.log1p(-F.pow("agree", "bits")))
    return most.select("label", "dim", "point", log_miss.alias("log_miss"))


def links(points: DataFrame, threshold: float, passes: int, block: int, reach: int, seed: int, miss: float) -> DataFrame:
    """Distinct links ``(a, b)`` between points, ``a < b``; each is missed with a probability of at
    most ``miss``."""
    spark = points.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rest = points.select("point", "label", F.size("vector").alias("dim"), "vector", F.lit(0.0).alias("log_miss"))
    parts, turn = [], 0
    while turn == 0 or not rest.isEmpty():
        rows = ordered(keyed(rest.drop("log_miss"), passes, [seed, turn], block * reach, threshold), block)
        parts.append(stored(compared(rows, reach, threshold).distinct(), "links"))
        now = parted(rows, reach).withColumnRenamed("log_miss", "more")
        both = rest.join(now, ["label", "dim", "point"]).withColumn("log_miss", F.col("log_miss") + F.col("more")).drop("more")
        rest = stored(both.filter(F.col("log_miss") > float(np.log(miss))).select(*rest.columns), "rest")
        turn += 1
        block, reach = (2 * block, reach) if 2 * block <= MOST_BLOCK else (block, 2 * reach)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, passes: int = 8, block: int = 512, reach: int = 2, seed: int = 7, miss: float = 1e-4) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector (``vec_id, embedding, label``)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector")).distinct()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    known = rows.filter(usable)
    points = known.groupBy("label", "vector").agg(F.min("vec_id").alias("point"), F.count("*").alias("copies"))
    path = scratch_path(vectors.sparkSession, "points")
    points.write.parquet(path)
    points = vectors.sparkSession.read.schema(points.schema).parquet(path)
    linked = links(points.select("point", "label", "vector"), threshold, passes, block, reach, seed, miss)
    both = linked.unionAll(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = points.select(F.col("point").alias("b"), "copies")
    partners = both.join(weight, "b").groupBy(F.col("a").alias("point")).agg(F.sum("copies").alias("others"))
    roots = connected_components(linked).withColumnRenamed("node", "point")
    placed = points.join(partners, "point", "left").join(roots, "point", "left")
    placed = placed.select("label", "vector", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "point").alias("component_id"))
    out = known.join(placed, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
