"""Clustered layout with bounding boxes: what a KD-tree or R-tree is for, as a table.

A tree of median cuts deals base rows to leaf blocks; a block's bounding box is a row of minima and maxima.  A search
first meets the boxes, one row per block, then joins the rows of reached blocks by block number: rows of other blocks
are never compared.  The cuts are a few numbers on the driver (at most 2 ** ``MOST_LEVELS``), exact medians found for
each level from a table of the axes' values; rows and boxes stay distributed.  A layout written with ``partitionBy("block")`` also lets a scan skip the files of
blocks that no query reaches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.vectors import literal
from ..sources.shared import stored
from .joins import renewed, theta_join
from .stats import quantiles

MOST_LEVELS = 16


@dataclass
class KdTree:
    """``cuts[n]`` cuts node n (the root is 1, the children of n are 2n and 2n + 1) along axis ``level % d``; a node
    without rows has no cut and sends everything to the left."""

    levels: int
    axes: int
    cuts: np.ndarray

    def block(self, x: Column) -> Column:
        """Number of the leaf of a vector, from 0."""
        node = F.lit(1)
        for level in range(self.levels):
            cut = F.get(literal(self.cuts, "array<double>"), node)
            node = node * 2 + F.when(x[level % self.axes].cast("double") >= cut, 1).otherwise(0)
        return node - 2**self.levels


def kd_tree(base: DataFrame, levels: int, axes: int) -> KdTree:
    """Lower medians along the first ``axes`` dimensions in turn, exact at any number of rows."""
    if levels > MOST_LEVELS:
        raise ValueError("too many levels")
    cuts = np.full(2**levels, np.inf)
    rows = stored(base.select(F.slice("x", 1, axes).alias("x")), "axes")
    for level in range(levels):
        tree = KdTree(level, axes, cuts)
        node = tree.block(F.col("x")) + 2**level
        value = F.col("x")[level % axes].cast("double")
        for r in quantiles(rows.select(node.alias("i"), value.alias("v")), [0.5], lower=True).collect():  # 2 ** level rows
            cuts[r["i"]] = r["value"]
    return KdTree(levels, axes, cuts)


def laid_out(base: DataFrame, tree: KdTree) -> DataFrame:
    return base.withColumn("block", tree.block(F.col("x")))


def bounds(rows: DataFrame, d: int) -> DataFrame:
    """(block, n, lo, hi) of rows (block, x): number of rows and bounding box."""
    sides = [F.array(*[f(F.col("x")[i]) for i in range(d)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    return rows.groupBy("block").agg(F.count("*").alias("n"), *sides)


def extended(boxes: DataFrame, new: DataFrame, d: int) -> DataFrame:
    """Boxes after the insertion of rows (block, x): only the new rows are read."""
    both = boxes.unionByName(bounds(new, d))
    sides = [F.array(*[f(F.col(name)[i]) for i in range(d)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    return both.groupBy("block").agg(F.sum("n").alias("n"), *sides)


def reached(boxes: DataFrame, queries: DataFrame, prefix: int) -> DataFrame:
    """(block, qid, q, rg) where a query's box meets a block's in the first ``prefix`` dimensions."""
    meets = lambda: P.box_reaches(F.col("lo"), F.col("hi"), F.col("q"), F.col("rg"), 0, prefix)
    return theta_join(boxes.select("block", "lo", "hi"), queries, meets).select("block", "qid", "q", "rg")


def block_search(rows: DataFrame, boxes: DataFrame, queries: DataFrame, d: int, prefix: int | None = None) -> DataFrame:
    """(qid, vec_id) of rows (vec_id, x, block) in the queries' boxes.  Blocks are chosen by the first ``prefix``
    dimensions (all if None), rows by all ``d``; every hit's block is reached, so the result is exact."""
    found = renewed(rows).join(renewed(reached(boxes, queries, prefix or d)), "block")
    return found.where(P.in_box(F.col("x"), F.col("q"), F.col("rg"), d)).select("qid", "vec_id")
