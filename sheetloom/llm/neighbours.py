"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are projected to ``PROJECTED`` Gaussian (2-stable) coordinates.  For two vectors at
distance d, the squared projected distance over d squared follows a chi-square law, so a
neighbour nearer than the k-th best so far lies, but for a probability of ``MISS``, within
``quantile * best ** 2`` of the query in the projection.  Projected neighbours are visited
nearest first, leaf by leaf of a kd-tree, and verified on the original vectors until the
next leaf is beyond that bound.

The upper levels of the kd-tree are fitted on a bounded sample and cut the space into
cells, each indexed in one task; every vector is indexed.  A query visits its own cell
first, and then only the cells that its bound reaches.  Equal vectors are one point
with as many of their smallest ids as an answer can hold, so a vector that a third of
all rows have is no burden to its cell.
"""
from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

PROJECTED = 8
MISS = 0.01
CELL_ROWS = 16_384       # expected points of a cell
SAMPLE_ROWS = 20_000     # vectors that the upper levels are fitted on, those of the smallest hash
LEAF_ROWS = 128
_SEED = 4


def quantile(miss: float, degrees: int = PROJECTED) -> float:
    """Value that a chi-square variable of an even number of degrees exceeds with probability ``miss``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
        low, high = (x, high) if tail > miss else (low, x)
    return high


def projection(dimension: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((dimension, PROJECTED))


@dataclass(frozen=True)
class Cells:
    """Upper levels: inner node i splits coordinate ``axis[i]`` at ``at[i]``; children 2i+1, 2i+2."""
    depth: int
    axis: np.ndarray
    at: np.ndarray

    @staticmethod
    def fit(points: np.ndarray, depth: int) -> "Cells":
        axis, at = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        held = {0: points}
        for i in range(2**depth - 1):
            p = held.pop(i)
            if len(p):
                axis[i] = int(np.argmax(p.var(axis=0)))
                at[i] = float(np.median(p[:, axis[i]]))
            left = p[:, axis[i]] < at[i]
            held[2 * i + 1], held[2 * i + 2] = p[left], p[~left]
        return Cells(depth, axis, at)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - (2**self.depth - 1)

    def within(self, point: np.ndarray, bound: float) -> list[int]:
        """Cells with a point at most this squared distance away."""
        out, stack = [], [(0, np.zeros(PROJECTED))]
        while stack:
            node, gaps = stack.pop()
            if node >= len(self.axis):
                out.append(node - len(self.axis))
                continue
            a, gap = int(self.axis[node]), point[self.axis[node]] - self.at[node]
            near, far = (2 * node + 2, 2 * node + 1) if gap >= 0 else (2 * node + 1, 2 * node + 2)
            stack.append((near, gaps))
            beyond = gaps.copy()
            beyond[a] = max(beyond[a], gap * gap)
            if beyond.sum() <= bound:
                stack.append((far, beyond))
        return out


class Tree:
    """kd-tree over the projected points of one cell."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray):
        self.vectors = vectors
        self.leaves: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        stack = [np.arange(len(vectors))]
        while stack:
            rows = stack.pop()
            p = projected[rows]
            if len(rows) > LEAF_ROWS:
                a = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                order = np.argsort(p[:, a], kind="stable")
                half = len(rows) // 2
                stack += [rows[order[half:]], rows[order[:half]]]
            elif len(rows):
                self.leaves.append(rows)
                self.low.append(p.min(axis=0))
                self.high.append(p.max(axis=0))
        self.boxes = (np.array(self.low), np.array(self.high)) if self.leaves else None

    def search(self, vector: np.ndarray, projected: np.ndarray, skip: int, ids: list[list[int]], k: int, factor: float,
               bound: float = math.inf) -> list[tuple[float, int]]:
        """The k nearest (distance, id), verified; ``bound`` is a distance that is known to hold k already."""
        if self.boxes is None:
            return []
        gap = np.maximum(0, np.maximum(self.boxes[0] - projected, projected - self.boxes[1]))
        reach = (gap * gap).sum(axis=1)
        best: list[tuple[float, int]] = []       # heap of (-distance, -id)
        for leaf in np.argsort(reach, kind="stable"):
            limit = min(bound, -best[0][0] if len(best) == k else math.inf)
            if reach[leaf] > factor * limit * limit:
                break
            rows = self.leaves[leaf]
            d = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(axis=1))
            # k + 1 points hold the k smallest (distance, id) and the query itself, if equal distances go by the smallest id
            for j in np.lexsort(([ids[r][0] for r in rows], d))[:k + 1]:
                if d[j] > limit:
                    break
                for i in ids[rows[j]]:
                    if i == skip:
                        continue
                    entry = (-float(d[j]), -i)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                limit = min(bound, -best[0][0] if len(best) == k else math.inf)
        return sorted((-d, -i) for d, i in best)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(_id, _v)`` of rows with an id whose vector is not null or zero and has only finite components."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).cast("long").alias("_id"), v.alias("_v")).filter(
        F.col("_id").isNotNull() & F.col("_v").isNotNull() & fine & some)


def nearest(df: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found for queries whose id is divisible by ``every``.

    Scores are Euclidean distances in double precision; ties go to the smaller id.  Rows with
    a null id, or a vector that is null, zero, holds null or non-finite components or has another
    length than most, take no part.  Rows that repeat an id count as that row's own.  Fewer
    candidates than k give fewer rows; an empty table gives none.  Other columns are not read.
    """
    spark = df.sparkSession
    rows = usable(df, vec_id, vector)
    sizes = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dimension, total = int(sizes["n"]), int(sizes["count"])
    rows = rows.filter(F.size("_v") == dimension)
    # an answer of k rows and the query itself need at most k + 1 ids of equal vectors
    first = Window.partitionBy("_v").orderBy("_id")
    points = stage(rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
                   .groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids")))
    depth = max(0, math.ceil(math.log2(max(1, total / CELL_ROWS))))
    sample = points.select("_v").orderBy(F.xxhash64("_v")).limit(SAMPLE_ROWS).collect()
    matrix = projection(dimension)
    cells = Cells.fit(np.array([r["_v"] for r in sample]) @ matrix, depth)
    factor = quantile(MISS)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.array(batch.column(0).to_pylist(), float)
                at = cells.of(v @ matrix)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0), batch.column(1)], names=["_cell", "_v", "_ids"])

    placed = points.mapInArrow(place, "_cell long, _v array<double>, _ids array<long>")
    queries = rows.filter(F.col("_id") % every == 0).dropDuplicates(["_id"])

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                at = cells.of(np.array(batch.column(1).to_pylist(), float) @ matrix)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0), batch.column(1), pa.array(np.full(len(at), math.inf))],
                                                 names=["_cell", "_query", "_q", "_bound"])

    def meet(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"_query": [], "_id": [], "_d": [], "_q": []}
        if index.num_rows and asked.num_rows:
            v = np.array(index.column("_v").to_pylist(), float)
            tree, ids = Tree(v, v @ matrix), index.column("_ids").to_pylist()
            for own, q, bound in zip(asked.column("_query").to_pylist(), asked.column("_q").to_pylist(), asked.column("_bound").to_pylist()):
                q = np.array(q)
                for d, i in tree.search(q, q @ matrix, own, ids, k, factor, bound):
                    for name, x in zip(out, (own, i, d, None)):
                        out[name].append(x)
        return pa.table({"_query": pa.array(out["_query"], pa.int64()), "_id": pa.array(out["_id"], pa.int64()), "_d": pa.array(out["_d"], pa.float64())})

    found_shape = "_query long, _id long, _d double"
    asked = queries.mapInArrow(ask, "_cell long, _query long, _q array<double>, _bound double")
    own = stage(placed.groupBy("_cell").cogroup(asked.groupBy("_cell")).applyInArrow(meet, found_shape))
    bounds = own.groupBy("_query").agg(F.max("_d").alias("_far"), F.count(F.lit(1)).alias("_n"))

    def spread(batches):
        for batch in batches:
            queries_of, vectors, fars, counts = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for own_id, q, far, n in zip(queries_of, vectors, fars, counts):
                bound = far if n is not None and n >= k else math.inf
                p = np.array(q) @ matrix
                home = int(cells.of(p[None])[0])
                out += [(c, own_id, q, bound) for c in cells.within(p, factor * bound * bound) if c != home]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                              pa.array([r[2] for r in out], pa.list_(pa.float64())), pa.array([r[3] for r in out], pa.float64())],
                                             names=["_cell", "_query", "_q", "_bound"])

    more = queries.join(bounds, queries["_id"] == bounds["_query"], "left").select("_id", "_v", "_far", "_n").mapInArrow(
        spread, "_cell long, _query long, _q array<double>, _bound double")
    others = placed.toDF("_cell", "_v", "_ids").groupBy("_cell").cogroup(more.groupBy("_cell")).applyInArrow(meet, found_shape)
    ranked = Window.partitionBy("_query").orderBy("_d", "_id")
    return (own.union(others).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select(F.col("_query").alias("query_id"), "rank", F.col("_id").alias("vec_id"), F.col("_d").alias("score")))
