"""Box joins of a base table (vec_id, x) with a query table (qid, q, rg[, dims]).

The query side is broadcast only if it is at most ``BROADCAST_QUERIES`` rows.  A larger one is cut into blocks of
that size, each of which is broadcast to the base where it lies: the base is read once for each block and never
shuffled.  Where the boxes are selective in a few dimensions, :func:`grid_search` joins on grid cells instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

BROADCAST_QUERIES = 20_000
#: Grid cells that a query is copied to at most.
MOST_CELLS = 4_096


def renewed(rows: DataFrame) -> DataFrame:
    """``rows`` with new attribute ids.  Spark numbers the variables of a lambda from 0 when it compares expressions; a
    condition whose lambda uses a column with such a small id, as in a fresh session, would be pushed to one side."""
    return rows.select(*[F.col(c).alias(c, metadata={"renewed": True}) for c in rows.columns])


def theta_join(base: DataFrame, queries: DataFrame, condition: Callable[[], Column], limit: int = BROADCAST_QUERIES) -> DataFrame:
    """Base rows with the queries for which the condition holds."""
    base, queries = renewed(base), renewed(queries)
    count = queries.limit(limit + 1).count()
    if count <= limit:
        return base.join(F.broadcast(queries), condition())
    blocks = -(-2 * queries.count() // limit)  # blocks by hash are of unequal size, half full on average
    part = F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))
    return reduce(DataFrame.unionByName, [base.join(F.broadcast(queries.where(part == k)), condition()) for k in range(blocks)])


def interval_search(base: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """(qid, vec_id) of each base point in a query's box."""
    return theta_join(base, queries, lambda: P.in_box(F.col("x"), F.col("q"), F.col("rg"), d)).select("qid", "vec_id")


def interval_stab(boxes: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """(qid, vec_id) of each stored box (x, rg of the base) that contains the query point."""
    return theta_join(boxes, queries.select("qid", "q"), lambda: P.in_box(F.col("x"), F.col("q"), F.col("rg"), d)).select("qid", "vec_id")


def sparse_search(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Box search on each query's active dimensions ``dims``; widths come from the query, or from the base if it has ``rg``."""
    side = queries.drop("rg") if "rg" in base.columns else queries
    return theta_join(base, side, lambda: P.in_sparse_box(F.col("x"), F.col("q"), F.col("rg"), F.col("dims"))).select("qid", "vec_id")


def overlap_search(boxes: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """(qid, vec_id) of stored boxes (x, xw) that meet the query's box."""
    return theta_join(boxes, queries, lambda: P.boxes_overlap(F.col("x"), F.col("xw"), F.col("q"), F.col("rg"), d)).select("qid", "vec_id")


def scaled_search(base: DataFrame, queries: DataFrame, scale: float, d: int) -> DataFrame:
    return theta_join(base, queries, lambda: P.in_scaled_box(F.col("x"), F.col("q"), F.col("rg"), F.lit(scale).cast("float"), d)).select("qid", "vec_id")


def cube_search(base: DataFrame, queries: DataFrame, radius: float, d: int) -> DataFrame:
    return theta_join(base, queries, lambda: P.in_cube(F.col("x"), F.col("q"), radius, d)).select("qid", "vec_id")


def prefix_search(base: DataFrame, queries: DataFrame, prefix: int) -> DataFrame:
    """Box search on the first ``prefix`` dimensions: what a tree over them returns as candidates."""
    return theta_join(base, queries, lambda: P.in_box(F.col("x"), F.col("q"), F.col("rg"), prefix)).select("qid", "vec_id")


def prefix_filter_refine(base: DataFrame, queries: DataFrame, prefix: int, d: int) -> DataFrame:
    """Candidates of the prefix, checked on all dimensions; the short test comes first."""
    both = lambda: P.in_box(F.col("x"), F.col("q"), F.col("rg"), prefix) & P.in_box(F.col("x"), F.col("q"), F.col("rg"), d)
    return theta_join(base, queries, both).select("qid", "vec_id")


def grid_search(base: DataFrame, queries: DataFrame, axes: list[int], cell: float, d: int, most_cells: int = MOST_CELLS) -> DataFrame:
    """The box join by grid cells along ``axes``: base rows fall into one cell, queries are copied to the cells that
    their box meets, the cell is an equi-join key, and the box is checked on all dimensions.  Queries whose box meets
    more than ``most_cells`` cells, which such a grid cannot serve, take :func:`interval_search`."""
    at = lambda v: F.floor(v / F.lit(cell)).cast("long")
    left, right, cells = base, queries, F.lit(1.0)
    for n, axis in enumerate(axes):
        left = left.withColumn(f"__c{n}", at(F.col("x")[axis].cast("double")))
        q, w = F.col("q")[axis].cast("double"), F.col("rg")[axis].cast("double")
        right = right.where(w >= 0)
        # one cell to spare on each side, for the rounding of the difference form
        right = right.withColumns({f"__a{n}": at(q - w) - 1, f"__b{n}": at(q + w) + 1})
        cells = cells * (2 * w / cell + 4)
    wide = right.where(~(cells <= most_cells)).select(*queries.columns)
    right = right.where(cells <= most_cells)
    for n in range(len(axes)):
        right = right.withColumn(f"__c{n}", F.explode(F.sequence(f"__a{n}", f"__b{n}")))
    keys = [f"__c{n}" for n in range(len(axes))]
    found = renewed(left).join(renewed(right), keys).where(P.in_box(F.col("x"), F.col("q"), F.col("rg"), d)).select("qid", "vec_id")
    return found if wide.isEmpty() else found.unionByName(interval_search(base, wide, d))


def refine(candidates: DataFrame, base: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """Candidate pairs (qid, vec_id) that lie in the box."""
    found = candidates.join(base.select("vec_id", "x"), "vec_id").join(queries.select("qid", "q", "rg"), "qid")
    return found.where(P.in_box(F.col("x"), F.col("q"), F.col("rg"), d)).select("qid", "vec_id")


def brute_force(base: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """Per query: hits and probed items, which are all base rows."""
    hits = interval_search(base, queries, d).groupBy("qid").agg(F.count("*").alias("hits"))
    rows = base.count()
    return queries.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), F.lit(rows).cast("long").alias("probed"))
