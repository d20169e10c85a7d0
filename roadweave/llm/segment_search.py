"""Exact top-k inner products with segment statistics at several resolutions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_ROWS, CANDIDATE_ROWS = 512, 2048
_EXACT = float(1 << 53)


def _segments(dim: int) -> list[np.ndarray]:
    """Where the segments begin at each resolution, coarse to fine: 1, 4, 16, ... segments of at least four components."""
    return [np.arange(n) * dim // n for n in (4**i for i in range(8)) if n <= max(1, dim // 4)]


def _statistics(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per resolution: segment means times the root of the segment's length, and the segments' root sums of squared deviations."""
    out = []
    for begins in _segments(x.shape[1]) if x.shape[1] else []:
        lengths = np.diff(np.append(begins, x.shape[1]))
        means = np.add.reduceat(x, begins, axis=1) / lengths
        rest = x - np.repeat(means, lengths, axis=1)
        out.append((means * np.sqrt(lengths), np.sqrt(np.add.reduceat(rest * rest, begins, axis=1))))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        raise OverflowError("components are too large for exact scores in 53 bits")
    return a @ b.T


def _blocks(table: DataFrame, scale: int, rows: int, k: int = 0) -> DataFrame:
    """Blocks of up to `rows` usable vectors of one dimension; with k, each also has its members' k-th best score within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, x = (np.array(c) for c in zip(*have.pop(dim), strict=True))
            x, floor = x.reshape(len(ids), dim).astype(np.float64), np.full(len(ids), -np.inf)
            if k:
                scores = _product(x, x)
                for i in range(len(ids)):
                    other = np.flatnonzero(ids != ids[i])
                    best = other[_best(scores[i, other], ids[other], k)]
                    floor[i] = scores[i, best[-1]] if len(best) == k else -np.inf
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "x": [x.tobytes()], "floor": [floor.tobytes()]})

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = np.floor(np.asarray(vector.values).astype(np.float64) * scale)
                if np.isfinite(x).all():
                    have.setdefault(len(x), []).append((key, x))
                    if len(have[len(x)]) == rows:
                        yield row(len(x))
        for dim in list(have):
            yield row(dim)

    return table.mapInArrow(run, "dim int, ids binary, x binary, floor binary")


def _dealt(spark: SparkSession, share: float) -> tuple[int, int]:
    """Groups of candidates and of queries: together as many pairs as the session has tasks, and the least copying of both."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    of_queries = max(1, math.isqrt(int(tasks * share)))
    return -(-tasks // of_queries), of_queries


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, among: bool = True, share: float = 1 / 50) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest integer inner products; ties go to the smaller id.

    Both tables have an id and a vector; a component x counts as floor(scale * x). The squared distance of two vectors
    is at least the sum over segments of the squared differences of their means (times the length) and of their
    deviations, or, with the norms known, their inner product is at most the same sums of products. A pair of blocks is
    tested with one segment, then with four times as many, and only for candidates that could still reach some query's
    k-th best score so far the exact product is taken. That score starts from the query's own block of queries (`among`:
    the queries are candidates too) and grows with each block. Blocks of candidates and blocks of queries are dealt into groups, and
    each pair of groups is work of its own; there are as many pairs as tasks, at any size, so a candidate is copied once
    a group of queries and a query once a group of candidates. `share` is about how many queries there are per candidate; it sets
    the shape of the groups, never the result.

    A query is not compared with rows of its own id. Vectors that are null, or hold null or non-finite components, and null
    ids take no part; vectors are compared with those of their own length only; an id that repeats counts once, with its
    best score, so repeated rows change nothing. Queries without candidates, and empty tables, give no rows. Scores
    beyond 2^53 raise an error.
    """
    groups, q_groups = _dealt(candidates.sparkSession, share)
    own = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n).cast("long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    blocks = _blocks(candidates, scale, CANDIDATE_ROWS).select("dim", "ids", "x", own(groups).alias("g"), each(q_groups).alias("h"))
    asked = _blocks(queries, scale, QUERY_ROWS, k if among else 0)
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), "floor", own(q_groups).alias("h"), each(groups).alias("g"))
    # dealt by hand: a small table would be joined where it was read, in one task
    pairs = blocks.repartition(groups * q_groups, "dim", "g", "h").join(asked, ["dim", "g", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # k-th best scores so far, by block of queries
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, x, q_ids, q_x, floor = (batch.column(n)[i].as_py() for n in ("dim", "ids", "x", "q_ids", "q_x", "floor"))
                floor = known.setdefault(q_ids, np.frombuffer(floor).copy())
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                x, q_x = np.frombuffer(x).reshape(-1, dim) if dim else np.zeros((len(ids), 0)), np.frombuffer(q_x).reshape(-1, dim) if dim else np.zeros((len(q_ids), 0))
                found, stats, q_stats = [], _statistics(x), _statistics(q_x)
                for a in range(0, len(q_ids), 32):
                    part, alive = slice(a, a + 32), np.arange(len(ids))
                    for (m, d), (q_m, q_d) in zip(stats, q_stats, strict=True):
                        most = q_m[part] @ m[alive].T + q_d[part] @ d[alive].T
                        most += 1e-9 * (1 + np.abs(most))  # rounding must not lose a pair
                        alive = alive[(most >= floor[part, None]).any(0)]
                    scores = _product(q_x[part], x[alive])
                    for j, row in enumerate(scores, a):
                        good = np.flatnonzero((row >= floor[j]) & (ids[alive] != q_ids[j]))
                        best = good[_best(row[good], ids[alive][good], k)]
                        if len(best) == k:
                            floor[j] = max(floor[j], row[best[-1]])
                        found += [(q_ids[j], ids[alive[b]], int(row[b])) for b in best]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
