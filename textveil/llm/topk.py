"""Exact top-k by inner product (operator 10): a pivot-distance index whose sorted annuli are expanded and cut short.

Vectors are lifted by one component, sqrt(M^2 - |x|^2) with M the largest norm, and queries by 0. Then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the smallest distances, and these obey the triangle
inequality: with r = |x' - p'| for a pivot p, |q' - x'| >= | |q' - p'| - r |.

Index: each vector under its nearest pivot, sorted by (pivot, r). Runs of rows with the same pivot are annuli [r1, r2].
Search: in every task, queries are taken by nearest pivot; the annuli at hand are sorted by their gap to those queries and
expanded from the nearest outwards; a query leaves the expansion as soon as its bound lies under its k-th best score. A
bounded sample gives every query a first k-th best score to start from. Queries go through in slabs of a bounded number
that are broadcast; the index is never shuffled again and no pair of rows is ever emitted: a task returns k rows a query."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.llm.common import shared_path, written

PIVOTS = 64
#: Vectors that give the first k-th best scores: 2 MB of 64 components.
SEEDS = 4096
#: Queries that are broadcast together: 8 MB of 64 components.
SLAB = 1 << 14
#: Rows of an annulus at most.
ANNULUS = 1024
#: Queries are numbered, for rows of one id may differ in their vectors.
RESULT_SQL = "query long, query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, *, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and v, the components floor(scale * x) as doubles, of the rows that take part."""
    x = F.col(vector_col)
    whole = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double")).alias("v"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return query[rank < k], vec[rank < k], score[rank < k]


class Slab:
    """Some queries and what is known of them: their distances to the pivots and their k-th best scores so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, lifts: np.ndarray, largest: float, k: int):
        self.ids, self.q, self.k, self.largest = ids, q, k, largest
        self.square = (q * q).sum(1)
        # the lift of a query is 0, so its distance to a lifted pivot needs no more than q.p
        self.to_pivot = np.sqrt(np.maximum(self.square[:, None] + largest - 2 * q @ pivots.T, 0))
        self.nearest = self.to_pivot.argmin(1) if len(pivots) else np.zeros(len(ids), int)
        self.kth = np.full(len(ids), -np.inf)
        self.top = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.float64))

    def meet(self, at: np.ndarray, vec: np.ndarray, x: np.ndarray, keep: bool = True) -> None:
        """Scores of the queries at `at` with all of x; their k best so far and k-th best scores follow."""
        scores = self.q[at] @ x.T
        scores[self.ids[at][:, None] == vec[None, :]] = -np.inf
        row, column = np.nonzero((scores >= self.kth[at][:, None]) & (scores > -np.inf))
        if not len(row):
            return
        new = (at[row], vec[column], scores[row, column])
        touched = np.isin(self.top[0], at)
        mine = _best(*(np.concatenate([t[touched], n]) for t, n in zip(self.top, new)), self.k)
        count = np.bincount(mine[0], minlength=len(self.ids))
        full = np.flatnonzero(count == self.k)
        last = np.full(len(self.ids), np.inf)
        np.minimum.at(last, mine[0], mine[2])
        self.kth[full] = np.maximum(self.kth[full], last[full])
        self.top = tuple(np.concatenate([t[~touched], m]) for t, m in zip(self.top, mine)) if keep else self.top

    def seed(self, vec: np.ndarray, x: np.ndarray) -> None:
        """k-th best scores among some vectors: no result of its own, only a bound that all tasks start from."""
        for low in range(0, len(self.ids), 512):
            self.meet(np.arange(low, min(low + 512, len(self.ids))), vec, x, keep=False)

    def expand(self, pivot: np.ndarray, r: np.ndarray, vec: np.ndarray, x: np.ndarray) -> None:
        """Meets the annuli that these rows, sorted by pivot and r within each file, fall into, nearest first, until no bound
        allows more. Files come in any order, so r may fall within a pivot."""
        cuts = np.r_[0, np.flatnonzero((np.diff(pivot) != 0) | (np.diff(r) < 0)) + 1, len(pivot)]
        annuli = [(a, min(a + ANNULUS, high)) for low, high in zip(cuts[:-1], cuts[1:]) for a in range(low, high, ANNULUS)]
        of = np.array([pivot[a] for a, _ in annuli])
        near, far = np.array([r[a] for a, _ in annuli]), np.array([r[b - 1] for _, b in annuli])
        slack = 1e-9 * (1 + self.largest + self.square.max(initial=0))  # for rounding in the distances
        for p in np.unique(self.nearest):
            group = np.flatnonzero(self.nearest == p)
            d = self.to_pivot[group][:, of]
            gap = np.maximum(0, np.maximum(near - d, d - far))
            bound = (self.square[group][:, None] + self.largest - gap * gap) / 2 + slack
            for j in np.argsort(gap.min(0), kind="stable"):
                open_ = bound[:, j] >= self.kth[group]
                if open_.any():
                    a, b = annuli[j]
                    self.meet(group[open_], vec[a:b], x[a:b])
                elif (bound[:, gap.min(0) >= gap[:, j].min()].max(1) < self.kth[group]).all():
                    break


def top_k(vectors: DataFrame, k: int = 5, *, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, seeds: int = SEEDS, slab: int = SLAB) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by `every`, its k highest integer inner
    products with the rows of other ids, ties to the smaller id; fewer if there are fewer.

    Rows with a null id, a null vector or a null or non-finite component take no part, nor do rows of another length than
    most. Rows that repeat an id are candidates each (of queries of other ids) and, where their vectors are equal, one
    query; where not, a query each, with k rows of its own under that id. Other columns are not looked at. An empty table gives an empty table. Scores are exact up to 2^53."""
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col=id_col, vector_col=vector_col, scale=scale)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    shapes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(square).alias("square")).orderBy(F.desc("rows"), "n").first()
    if shapes is None or not shapes.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, largest = shapes.n, shapes.square
    rows = rows.where(F.size("v") == width)

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(pivots, seeds)).collect()  # a bounded sample
    seed_ids, seed_x = np.array([r.vec_id for r in sample], np.int64), np.array([r.v for r in sample])
    centres = seed_x[:pivots]
    lifts = np.sqrt(np.maximum(largest - (centres**2).sum(1), 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), batch.num_rows)
            lift = np.sqrt(np.maximum(largest - (x * x).sum(1), 0))
            d = np.sqrt(np.maximum(2 * largest - 2 * x @ centres.T - 2 * lift[:, None] * lifts, 0))
            p = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(d[np.arange(len(p)), p]), batch.column(0), batch.column(1)], names=["pivot", "r", "vec_id", "v"])

    index = rows.mapInArrow(assign, "pivot int, r double, vec_id long, v array<double>")
    index = written(index.repartitionByRange("pivot", "r").sortWithinPartitions("pivot", "r"), "pivot-index")

    queries = written(index.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct(), "queries")
    # one slab is fetched at once; more of them partition by partition, as a job each
    fetched = iter(queries.collect()) if queries.count() <= slab else queries.toLocalIterator()
    parts: list[DataFrame] = []
    while some := list(islice(fetched, slab)):
        base = len(parts) * slab
        state = Slab(np.array([r.vec_id for r in some], np.int64), np.array([r.v for r in some]), centres, lifts, largest, k)
        state.seed(seed_ids, seed_x)
        parts.append(_searched(index, spark.sparkContext.broadcast(state), base))
    if len(parts) > 1:  # each slab is worked off before the next, so that no plan holds them all
        path = shared_path(spark, "top-k")
        for part in parts:
            part.write.mode("append").parquet(path)
        parts = [spark.read.schema(RESULT_SQL).parquet(path)]
    found = parts[0] if parts else spark.createDataFrame([], RESULT_SQL)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(index: DataFrame, state, base: int) -> DataFrame:
    """The k best of each query of a slab among the rows of each task; its queries are numbered from `base` on."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        slab = copy.copy(state.value)  # a task raises its own k-th best scores
        slab.kth = slab.kth.copy()
        for batch in batches:
            if batch.num_rows:
                pivot, r, vec = (batch.column(n).to_numpy() for n in range(3))
                slab.expand(pivot, r, vec, _matrix(batch.column(3), batch.num_rows))
        query, vec, score = slab.top
        yield pa.RecordBatch.from_arrays([pa.array(query + base), pa.array(slab.ids[query]), pa.array(vec), pa.array(score.astype(np.int64))], names=["query", "query_id", "vec_id", "score"])

    return index.select("pivot", "r", "vec_id", "v").mapInArrow(search, RESULT_SQL)
