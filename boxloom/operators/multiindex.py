"""Inverted multi-index over two code parts, and product-quantization boxes.

Codes are (vec_id, code, k0, k1).  Lookup is an equi-join on the cell (k0, k1); which cells a query probes, and where it
stops, are window sums over its ranked non-empty cells, whose number is bounded by the codebook and not by the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from .joins import theta_join
from .quantize import Codebook, adc
from .ranking import running_before


def build(base: DataFrame, book: Codebook) -> DataFrame:
    """``base`` with code, k0 and k1."""
    return base.withColumn("code", book.encode(F.col("x"))).withColumns({"k0": F.get("code", F.lit(0)), "k1": F.get("code", F.lit(1))})


def bucket_bounds(codes: DataFrame, book: Codebook) -> DataFrame:
    """(m, k, i, lo, hi): hull, per subspace dimension, of a centroid and the rows coded with it."""
    spark = codes.sparkSession
    rows = [(m, k, i, float(v)) for m, part in enumerate(book.centroids) for k, c in enumerate(part) for i, v in enumerate(c)]
    own = spark.createDataFrame(rows, "m int, k int, i int, v double")
    parts = F.array(*[F.struct(F.lit(m).alias("m"), F.get("code", F.lit(m)).alias("k"), F.slice("x", first + 1, n).alias("piece")) for m, (first, n) in enumerate(book.parts)])
    pieces = codes.select(F.explode(parts).alias("p")).select("p.m", "p.k", F.posexplode("p.piece").alias("i", "v"))
    hulls = pieces.groupBy("m", "k", "i").agg(F.min(F.col("v").cast("double")).alias("a"), F.max(F.col("v").cast("double")).alias("b"))
    joined = own.join(hulls, ["m", "k", "i"], "left")
    return joined.select("m", "k", "i", F.least("v", F.coalesce("a", "v")).alias("lo"), F.greatest("v", F.coalesce("b", "v")).alias("hi"))


def boxes(bounds: DataFrame) -> DataFrame:
    """(m, k, lo, hi) with arrays, a row per centroid."""
    at = F.sort_array(F.collect_list(F.struct("i", "lo", "hi")))
    return bounds.groupBy("m", "k").agg(at.alias("at")).select("m", "k", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))


def reachable(queries: DataFrame, box: DataFrame, book: Codebook) -> DataFrame:
    """(qid, m, k) of the buckets whose box meets the query's box.  ``box`` has a row per centroid."""
    tests = [(F.col("m") == m) & P.box_reaches(F.col("lo"), F.col("hi"), F.col("q"), F.col("rg"), first, n) for m, (first, n) in enumerate(book.parts)]
    condition = tests[0]
    for t in tests[1:]:
        condition = condition | t
    return queries.join(F.broadcast(box), condition).select("qid", "m", "k")


def sparse_reachable(queries: DataFrame, box: DataFrame, book: Codebook) -> DataFrame:
    tests = [(F.col("m") == m) & P.sparse_box_reaches(F.col("lo"), F.col("hi"), F.col("q"), F.col("rg"), F.col("dims"), first, n) for m, (first, n) in enumerate(book.parts)]
    condition = tests[0]
    for t in tests[1:]:
        condition = condition | t
    return queries.join(F.broadcast(box), condition).select("qid", "m", "k")


def possible(reach: DataFrame, parts: int) -> DataFrame:
    """(qid, may): for each part the array of codes that a hit of the query can have."""
    per = [F.collect_set(F.when(F.col("m") == m, F.col("k"))).alias(f"p{m}") for m in range(parts)]
    return reach.groupBy("qid").agg(*per).select("qid", F.array(*[f"p{m}" for m in range(parts)]).alias("may"))


def code_possible(code: Column, may: Column, parts: int) -> Column:
    out = F.lit(True)
    for m in range(parts):
        out = out & F.array_contains(F.get(may, F.lit(m)), F.get(code, F.lit(m)))
    return out


def pq_filtered(codes: DataFrame, queries: DataFrame, reach: DataFrame, parts: int) -> DataFrame:
    """Pairs of queries and base rows whose codes are all possible: what the boxes do not rule out."""
    side = queries.join(possible(reach, parts), "qid")
    return theta_join(codes, side, lambda: code_possible(F.col("code"), F.col("may"), parts))


def cells(codes: DataFrame) -> DataFrame:
    """(k0, k1, n) of the non-empty cells."""
    return codes.groupBy("k0", "k1").agg(F.count("*").alias("n"))


def cell_stats(codes: DataFrame) -> DataFrame:
    rows = cells(codes)
    return rows.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count("*").alias("nonempty"), F.floor(F.sum("n") / F.count("*")).alias("mean"))


def reachable_cells(codes: DataFrame, reach: DataFrame) -> DataFrame:
    """(qid, k0, k1, n) of the non-empty cells both of whose buckets the query's box meets."""
    first = reach.where("m = 0").select("qid", F.col("k").alias("k0"))
    second = reach.where("m = 1").select("qid", F.col("k").alias("k1"))
    return first.join(second, "qid").join(cells(codes), ["k0", "k1"])


def ranked_cells(codes: DataFrame, queries: DataFrame, book: Codebook) -> DataFrame:
    """(qid, k0, k1, n, dist, place): non-empty cells in ascending order of the sum of both weighted subspace distances."""
    table = queries.select("qid", book.adc_table(F.col("q"), F.col("rg")).alias("t"))
    pairs = table.join(F.broadcast(cells(codes)))  # at most ks * ks rows
    dist = F.round(F.get(F.get("t", F.lit(0)), F.col("k0")) + F.get(F.get("t", F.lit(1)), F.col("k1")), 9)
    order = Window.partitionBy("qid").orderBy("dist", "k0", "k1")
    return pairs.select("qid", "k0", "k1", "n", dist.alias("dist")).withColumn("place", F.row_number().over(order))


ORDER = ["dist", "k0", "k1"]


def probed_top_k(ranked: DataFrame, items: int) -> DataFrame:
    """Cells until at least ``items`` rows were probed; the last cell is taken whole."""
    return ranked.withColumn("before", running_before(F.col("n"), "qid", ORDER)).where(F.col("before") < items).drop("before")


def probed_threshold(ranked: DataFrame, distance: float) -> DataFrame:
    return ranked.where(F.col("dist") <= distance)


def probed_precision(ranked: DataFrame, hits_by_cell: DataFrame, precision: float, least: int = 100) -> DataFrame:
    """Cells until, with more than ``least`` rows probed, the share of hits falls below ``precision``.
    ``hits_by_cell``: (qid, k0, k1, hits)."""
    with_hits = ranked.join(hits_by_cell, ["qid", "k0", "k1"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    sums = with_hits.withColumns({"probed_before": running_before(F.col("n"), "qid", ORDER), "hits_before": running_before(F.col("hits"), "qid", ORDER)})
    stops = F.when((F.col("probed_before") > least) & (F.col("hits_before") / F.nullif(F.col("probed_before"), F.lit(0)) < precision), F.col("place"))
    first = F.min(stops).over(Window.partitionBy("qid"))
    return sums.withColumn("stop", first).where(F.col("stop").isNull() | (F.col("place") < F.col("stop"))).select(*ranked.columns)


def members(probed: DataFrame, codes: DataFrame) -> DataFrame:
    """(qid, vec_id, x, code) of the rows in the probed cells."""
    return codes.join(probed.select("qid", "k0", "k1"), ["k0", "k1"])


def hits(candidates: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """Candidates (qid, vec_id, x) in the query's box."""
    side = queries.select("qid", "q", "rg")
    return candidates.join(side, "qid").where(P.in_box(F.col("x"), F.col("q"), F.col("rg"), d)).select("qid", "vec_id")


def ranked_candidates(candidates: DataFrame, queries: DataFrame, book: Codebook, keep: int, code: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """The ``keep`` candidates of each query with the smallest asymmetric distance."""
    table = queries.select("qid", book.adc_table(F.col("q"), F.col("rg")).alias("t"))
    scored = candidates.join(table, "qid").withColumn("adc", F.round(adc(F.col("t"), F.col("code"), len(book.parts)), 9)).drop("t")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("adc", "vec_id"))
    return scored.withColumn("place", place).where(F.col("place") <= keep)
