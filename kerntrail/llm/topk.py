"""Exact top-k by inner product: distances to pivots bound the scores, candidates are met in the order of their bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, staged

#: Pivots for vectors of each length, and the rows of the sample (the least hashes of ids) that they are chosen from.
PIVOTS, SAMPLE = 24, 4096
#: Products of two vectors' norms below which doubles hold every sum of the score exactly.
EXACT = float(1 << 52)
LEAST = np.iinfo(np.int64).min + 1
#: Most queries in one broadcast (expected); more queries go in further scans of the candidates.
QUERY_BLOCK = 16_384
ROWS = 4096
STEPS = (64, 256, 1024)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, x: floor(scale * component); rows with a null or non-finite component go."""
    whole = F.transform("embedding", lambda v: v.cast("double"))
    odd = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").cast("long"), F.transform(whole, lambda v: F.floor(v * float(scale)).cast("double")).alias("x"))


def comparable(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows whose id and components are all there and finite."""
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~odd).select(F.col("vec_id").cast("long"), F.col("x").cast("array<double>"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def of_length(vectors: list, n: int) -> np.ndarray:
    own = [v for v in vectors if len(v) == n]
    return np.array(own, float).reshape(len(own), n)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances to the pivots, and to the origin in the last column."""
    square = (x * x).sum(axis=1)
    to = square[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(np.column_stack([to, square]), 0))


def farthest_first(vectors: list[list[float]], n: int) -> np.ndarray:
    """Of vectors of one length, the first and then each time the one that is farthest from those chosen."""
    x = np.array(vectors, float)
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


class Search:
    """The best k of the candidates seen so far, for each query. Scores are 64-bit integers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.table = distances(x, pivots)
        self.scores = np.full((len(x), k), LEAST)
        self.found = np.full((len(x), k), np.iinfo(np.int64).max)
        self.evaluated = self.met = 0

    def bounds(self, of: slice, table: np.ndarray) -> np.ndarray:
        """No score exceeds (|q|^2 + |x|^2 - b^2) / 2, where b is the greatest difference of distances to one pivot."""
        q, low = self.table[of], np.zeros((of.stop - of.start, len(table)))
        for p in range(table.shape[1]):
            np.maximum(low, np.abs(q[:, p, None] - table[None, :, p]), out=low)
        square = q[:, -1, None] ** 2 + table[None, :, -1] ** 2
        return (square - low * low) / 2 + 1e-6 * (1 + square)

    def keep(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.hstack([self.scores[rows], scores]), np.hstack([self.found[rows], ids])
        best = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[rows], self.found[rows] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)

    def products(self, x: np.ndarray, at: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
        """Scores of the candidates at `at` (a row for each query); in integers where doubles might round."""
        kind = float if exact else np.int64
        return np.matmul(x[at].astype(kind, copy=False), self.x[rows].astype(kind, copy=False)[:, :, None])[:, :, 0].astype(np.int64)

    def see(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray) -> None:
        """Meets the candidates in the order of their bounds, and stops where no bound reaches the k-th score."""
        exact = len(ids) == 0 or table[:, -1].max() * self.table[:, -1].max() < EXACT
        for start in range(0, len(self.x), 64):
            of = slice(start, min(start + 64, len(self.x)))
            top = self.bounds(of, table)
            order = np.argsort(-top, axis=1)
            rows, at, step = np.arange(of.start, of.stop), 0, 0
            self.met += top.size
            while len(rows) and at < len(ids):
                wide = STEPS[min(step, len(STEPS) - 1)]
                next_ = order[rows - start, at : at + wide]
                self.evaluated += next_.size
                score = self.products(x, next_, rows, exact)
                own = ids[next_] == self.ids[rows][:, None]  # the query's own row
                reach = (score >= self.scores[rows][:, -1:]) & ~own
                some = reach.any(axis=1)
                if some.any():
                    self.keep(rows[some], np.where(reach, score, LEAST)[some], np.where(reach, ids[next_], np.iinfo(np.int64).max)[some])
                at, step = at + wide, step + 1
                if at < len(ids):
                    rows = rows[top[rows - start, order[rows - start, at]] >= self.scores[rows][:, -1]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """vectors(vec_id, x), queries(vec_id, x) -> query_id, rank, vec_id, score: each query's k best, ties to smaller ids.

    Only vectors of one length are compared. A query's own row is any with its id; a query given repeatedly counts once
    (by the least vector); repeated candidates are candidates each; no candidates, no rows. Candidates' distances to the
    pivots are written once, then scanned for each block of queries, at most QUERY_BLOCK at a time in a broadcast;
    a task emits its own k best of each query. Components are integers; scores are exact up to 64 bits. Rows with a null id,
    a null vector or a null or non-finite component take no part, as candidates or as queries; empty vectors meet each other
    alone, with score 0; no queries, no rows; other columns, whatever their names, are left out.
    """
    spark, vectors, queries = vectors.sparkSession, comparable(vectors), comparable(queries)
    sample: dict[int, list[list[float]]] = {}
    parts = vectors.count() // (2 * SAMPLE) + 1  # every task sends its least rows to the driver, so few rows go in
    some = vectors.filter(F.pmod(F.xxhash64("vec_id", "x", F.lit("pivots")), F.lit(parts)) == 0)
    for r in some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        sample.setdefault(len(r["x"]), []).append(r["x"])
    chosen = [p.tolist() for x in sample.values() for p in farthest_first(x, pivots)]

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.diff(batch["x"].offsets.to_numpy())
            for n in np.unique(length):
                part = batch.filter(pa.array(length == n))
                d = distances(matrix(part["x"]), of_length(chosen, n))
                yield pa.record_batch([part["vec_id"], part["x"], pa.array(list(d), pa.list_(pa.float64()))], ["vec_id", "x", "d"])

    candidates = staged(vectors.mapInArrow(table, "vec_id long, x array<double>, d array<double>"), "pivot-table")
    asked = staged(queries.groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    blocks = asked.count() // QUERY_BLOCK + 1
    found = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(), rows["x"].to_pylist()))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, xs = shared.value
            length, open_ = np.array([len(x) for x in xs], int), {}
            for batch in batches:
                sizes = np.diff(batch["x"].offsets.to_numpy())
                for n in np.intersect1d(sizes, length):
                    own = np.flatnonzero(length == n)
                    if n not in open_:
                        open_[n] = Search(ids[own], of_length(xs, n), of_length(chosen, n), k)
                    part = batch.filter(pa.array(sizes == n))
                    for i in range(0, part.num_rows, ROWS):
                        some = part.slice(i, ROWS)
                        open_[n].see(some["vec_id"].to_numpy(), matrix(some["x"]), matrix(some["d"]))
            for one in open_.values():
                there = one.found != np.iinfo(np.int64).max
                query = np.broadcast_to(one.ids[:, None], there.shape)[there]
                yield pa.record_batch([pa.array(query), pa.array(one.found[there]), pa.array(one.scores[there])], ["query_id", "vec_id", "score"])

        part = candidates.mapInArrow(search, "query_id long, vec_id long, score long")
        found = part if found is None else found.union(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for every row whose id is divisible by 50."""
    vectors = quantised(load(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
