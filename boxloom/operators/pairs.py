"""Scores of all pairs of base rows (vec_id, x) and queries (qid, q, rg), for jobs that need every one of them.

The numbers are those of ``functions.distance.weighted_dense`` and ``functions.predicates.in_box``; NumPy computes them
tile by tile, dimension after dimension, where higher-order functions take some microseconds for each dimension of a
pair.  Queries are sent in blocks of at most ``joins.BROADCAST_QUERIES`` rows; base rows are dealt so that a task has
some ``TASK_PAIRS`` pairs, however few files or row groups the base lies in."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins

TASK_PAIRS = 4_000_000
TILE_ROWS, TILE_QUERIES = 512, 128


def matrix(column, d: int) -> np.ndarray:
    """A column of lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if len(flat) != len(column) * d or flat.null_count:
        raise ValueError(f"vectors do not have {d} numbers")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def tile(x: np.ndarray, q: np.ndarray, w: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and hits, a row per query and a column per base row; arguments have a row per dimension."""
    dist, hit = np.zeros((q.shape[1], x.shape[1])), np.ones((q.shape[1], x.shape[1]), bool)
    wide = x.astype("f8"), q.astype("f8"), w.astype("f8") + 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b, r, a8, b8, r8 in zip(x, q[:, :, None], w[:, :, None], wide[0], wide[1][:, :, None], wide[2][:, :, None], strict=True):
            hit &= np.abs(a - b) <= r
            t = np.abs(a8 - b8)
            same = t == 0 if (r8 == 0).any() else None
            t /= r8
            if same is not None:
                t[same & (r8 == 0)] = 0.0
            dist += t * t if p == 2 else np.power(t, p)
    return dist, hit


def rounded(values: np.ndarray, places: int) -> np.ndarray:
    """Half away from zero, as SQL rounds; values too large to have such places stay."""
    scaled = values * 10.0**places
    return np.where(scaled < 2.0**52, np.floor(scaled + 0.5) / 10.0**places, values)


def scored(base: DataFrame, queries: DataFrame, d: int, p: int = 2, places: int = 9) -> DataFrame:
    """(qid, vec_id, dist, hit) of every pair: weighted distance, rounded, and whether the row lies in the query's box."""
    n_rows, n_queries = base.count(), queries.count()
    blocks = 1 if n_queries <= joins.BROADCAST_QUERIES else -(-2 * n_queries // joins.BROADCAST_QUERIES)
    part = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    # not divided by the blocks: Spark may run equal partitions of a union in one task
    tasks = max(1, min(-(-n_rows * n_queries // TASK_PAIRS), -(-n_rows // TILE_ROWS)))
    dealt = base.select("vec_id", "x").repartition(tasks)
    return reduce(DataFrame.unionByName, [_block(dealt, queries.where(part == k), d, p, places) for k in range(blocks)])


def _block(base: DataFrame, queries: DataFrame, d: int, p: int, places: int) -> DataFrame:
    sent = queries.select(F.col("qid").cast("long").alias("qid"), "q", "rg").toArrow()
    qid, q, w = sent["qid"].to_numpy(), matrix(sent["q"], d).T.copy(), matrix(sent["rg"], d).T.copy()

    def score(batches):
        for batch in batches:
            ids, x = batch["vec_id"].to_numpy(), matrix(batch["x"], d)
            for row in range(0, len(ids), TILE_ROWS):
                some = slice(row, row + TILE_ROWS)
                part = x[some].T.copy()
                for first in range(0, len(qid), TILE_QUERIES):
                    at = slice(first, first + TILE_QUERIES)
                    dist, hit = tile(part, q[:, at], w[:, at], p)
                    columns = np.repeat(qid[at], part.shape[1]), np.tile(ids[some], len(qid[at])), rounded(dist, places).ravel(), hit.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "vec_id", "dist", "hit"])

    return base.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(score, "qid long, vec_id long, dist double, hit boolean")
