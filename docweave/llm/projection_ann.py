"""Approximate nearest neighbours over low-dimensional stable projections indexed by kd-trees.

Vectors are projected by a fixed Gaussian (2-stable) matrix to ``PROJECTED`` dimensions.  A kd-tree over a bounded
sample of projections cuts the space into cells; every row is indexed in its cell, crowded cells are salted into shards,
and each shard has a kd-tree of its own with leaves of ``LEAF`` rows.  A query first searches its own cell.  With the
distance of its k-th neighbour so far, other cells follow in order of their projected distance, twice as many each round,
while the stopping test fails for them; only what is nearer than that neighbour is returned.  In a shard,
leaves are taken in order of their projected distance and verified with exact inner products in double precision until
the test holds: for a point at the k-th distance, squared projected over squared true distance follows a chi-square law,
so once its distribution function at (bound / k-th distance) squared passes ``confidence``, a nearer point would have
come up already with that probability.

Inner products become distances by the usual extra coordinate sqrt(M^2 - |x|^2), M the largest norm, and by scaling
queries to norm M, which changes no order.  Memory: a task holds one shard (``SHARD`` rows) and streams queries.

Defined results: vectors that are null, zero, of a length other than the most frequent one, or hold null
or non-finite components take no part, as query or as candidate; null ids neither; ties go to the smaller id; repeated
ids are candidates of their own, but never of a query with the same id; fewer candidates than k are all returned; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import groups_of
from .runtime import bounded_sample, partitions, stored

PROJECTED = 12
LEAF = 64
SHARD = 2048
SAMPLE = 16384


def chi_square(x: np.ndarray, m: int = PROJECTED) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def matrix(dims: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).standard_normal((dims, PROJECTED))


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, largest**2 - (x * x).sum(1, keepdims=True)))
    return np.concatenate([x, rest], 1)


def as_query(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate([x * (largest / np.linalg.norm(x, axis=1, keepdims=True)), np.zeros((len(x), 1))], 1)


class Cells:
    """The upper kd-tree: median splits of a sample along the widest dimension."""

    def __init__(self, sample: np.ndarray, count: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        inf = np.full(PROJECTED, np.inf)
        self.root = self._split(sample, count, -inf, inf)
        self.low, self.high = (np.array([b[k] for b in self.boxes]) for k in (0, 1))

    def _split(self, x, count, low, high) -> int:
        if count <= 1 or len(x) < 2:
            self.boxes.append((low, high))
            return -len(self.boxes)
        d = int(np.argmax(x.max(0) - x.min(0)))
        at = float(np.median(x[:, d]))
        left = x[:, d] < at
        if not left.any():
            self.boxes.append((low, high))
            return -len(self.boxes)
        me = len(self.nodes)
        self.nodes.append((d, at, 0, 0))
        up, down = high.copy(), low.copy()
        up[d], down[d] = at, at
        a, b = self._split(x[left], count // 2, low, up), self._split(x[~left], count - count // 2, down, high)
        self.nodes[me] = (d, at, a, b)
        return me

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                d, at, a, b = self.nodes[node]
                left = x[rows, d] < at
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


def box_distance2(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from queries to boxes, queries by boxes."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


class Shard:
    """Rows of a shard and their kd-tree, flattened to leaves with boxes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, p: np.ndarray, squares: float):
        self.ids, self.x, self.squares = ids, x, squares
        self.leaves: list[np.ndarray] = []
        todo = [np.argsort(ids, kind="stable")]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            d = int(np.argmax(p[rows].max(0) - p[rows].min(0)))
            order = rows[np.argsort(p[rows, d], kind="stable")]
            todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        self.low = np.array([p[r].min(0) for r in self.leaves])
        self.high = np.array([p[r].max(0) for r in self.leaves])

    def search(self, ids: np.ndarray, raw: np.ndarray, scale: np.ndarray, pq: np.ndarray, k: int, kth: np.ndarray, confidence: float):
        """(scores, ids) of the k best of each query, best first; kth: squared distances that are known to be reachable."""
        n = len(ids)
        best, named = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        bound = box_distance2(pq, self.low, self.high)
        order = np.argsort(bound, axis=1, kind="stable")
        active = np.arange(n)
        for step in range(len(self.leaves)):
            leaf = order[active, step]
            # inner product of the scaled query -> squared distance between augmented vectors
            mine = self.squares * 2 - 2 * best[active, k - 1] * scale[active]
            limit = np.maximum(np.minimum(np.where(np.isfinite(best[active, k - 1]), mine, np.inf), kth[active]), 1e-300)
            go = chi_square(bound[active, leaf] / limit) < confidence
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            cut = np.flatnonzero(np.diff(leaf[by], prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(by)]):
                rows, who = self.leaves[leaf[by[a]]], active[by[a:b]]
                score = exact_products(raw[who], self.x[rows])
                score[ids[who][:, None] == self.ids[rows][None, :]] = -np.inf
                s = np.concatenate([best[who], score], 1)
                i = np.concatenate([named[who], np.broadcast_to(self.ids[rows], score.shape)], 1)
                top = np.lexsort((i, -s), axis=1)[:, :k]
                best[who], named[who] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        return best, named


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components whatever the block's shape."""
    return np.einsum("ik,jk->ij", q, x, optimize=False)


def _finite(col: str) -> Column:
    v = F.col(col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda e: e != 0)


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, confidence: float = 0.97) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for each row that is a query, among all other rows, by inner product."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & _finite(vector_col))
    schema = "query_id long, rank int, id long, score double"
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)).alias("most")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, total, largest = sizes[0]["dims"], sizes[0]["n"], math.sqrt(sizes[0]["most"])
    rows = rows.where(F.size("v") == dims)
    project = matrix(dims + 1)
    sample = bounded_sample(rows, ["id", "v"], SAMPLE, total).select("v").toArrow()
    cells = Cells(augmented(_vectors(sample.column(0)), largest) @ project, math.ceil(total / SHARD))

    def place(batches):
        for batch in batches:
            x = _vectors(batch.column(1))
            own = cells.of(augmented(x, largest) @ project) if len(x) else np.zeros(0, np.int32)
            home = cells.of(as_query(x, largest) @ project) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(home, pa.int32())], names=["id", "v", "q", "cell", "home"])

    placed = stored(rows.mapInArrow(place, "id long, v array<double>, q boolean, cell int, home int"), "cells")
    # a row a cell, and there are no more cells than sampled rows
    crowd = F.broadcast(stored(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards")), "cell-sizes"))
    none = F.lit(None)
    data = placed.join(crowd, "cell").select("cell", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v", none.cast("double").alias("kth"))
    queries = placed.where("q")

    def search(batches):
        for group in groups_of(batches, ["cell", "shard"]):
            kind = group.column("kind").to_numpy()
            n = int((kind == 0).sum())
            if n == 0 or n == len(kind):
                continue
            ids, x = group.column("id").to_numpy(), _vectors(group.column("v"))
            kth = group.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            shard = Shard(ids[:n], x[:n], augmented(x[:n], largest) @ project, largest**2)
            for a in range(n, len(ids), 256):
                q, names = x[a : a + 256], ids[a : a + 256]
                scale = largest / np.linalg.norm(q, axis=1)
                best, named = shard.search(names, q, scale, as_query(q, largest) @ project, k, np.where(np.isnan(kth[a : a + 256]), np.inf, kth[a : a + 256]), confidence)
                # what is farther than the k already known isn't needed
                limit = kth[a : a + 256]
                real = np.isfinite(best) & (np.isnan(limit)[:, None] | (2 * largest**2 - 2 * best * scale[:, None] <= (limit * (1 + 1e-9))[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, real.sum(1))), pa.array(named[real]), pa.array(best[real])], names=["query_id", "id", "score"])

    def found(asked: DataFrame) -> DataFrame:
        both = data.unionByName(asked)
        return both.repartition(partitions(spark), "cell", "shard").sortWithinPartitions("cell", "shard", "kind").mapInArrow(search, "query_id long, id long, score double")

    def at_shards(df: DataFrame) -> DataFrame:
        # a cell without rows of its own has nothing to be searched
        return df.join(crowd, "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("cell", F.col("shard").cast("int"), F.lit(1).alias("kind"), "id", "v", "kth")

    def route(begin: int, end: int):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, home = _vectors(batch.column("v")), batch.column("home").to_numpy()
                reach = batch.column("reached").to_numpy(zero_copy_only=False).astype(np.float64)
                scale = largest / np.linalg.norm(x, axis=1)
                kth = np.where(np.isnan(reach), np.inf, np.maximum(2 * largest**2 - 2 * reach * scale, 1e-300))
                bound = box_distance2(as_query(x, largest) @ project, cells.low, cells.high)
                bound[np.arange(len(x)), home] = -1
                cell = np.argsort(bound, axis=1, kind="stable")[:, begin:end]
                go = chi_square(np.maximum(np.take_along_axis(bound, cell, 1), 0) / kth[:, None]) < confidence
                who, at = np.nonzero(go)
                cell = cell[who, at]
                for a in range(0, len(who), 4096):
                    rows = pa.array(who[a : a + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 4096], pa.int32()), batch.column("id").take(rows), batch.column("v").take(rows), pa.array(kth[who[a : a + 4096]])], names=["cell", "id", "v", "kth"])

        return run

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    asked = queries.select(F.col("home").alias("cell"), "id", "v", none.cast("double").alias("kth"))
    best, begin = None, 1
    while True:
        new = found(at_shards(asked))
        ranked = (new if best is None else best.union(new)).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
        best = stored(ranked.select("query_id", "id", "score", "rank"), "nearest")
        reached = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
        best = best.drop("rank")
        if begin >= len(cells.low):
            break
        # twice as many cells each round: what is left to improve halves, so rows go with k log(cells) a query
        end = 2 * begin + 1
        asked = stored(queries.select("id", "v", "home").join(reached, "id", "left").mapInArrow(route(begin, end), "cell int, id long, v array<double>, kth double"), "asked")
        if asked.isEmpty():
            break
        begin = end
    return best.withColumn("rank", F.row_number().over(order).cast("int")).select("query_id", "rank", "id", "score")
