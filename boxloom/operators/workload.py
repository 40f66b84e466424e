"""Query workloads: widths of a target selectivity, active dimensions, and the search for a percentage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.vectors import literal
from .joins import theta_join
from .ranking import top_k
from .stats import percentiles, quantiles, vector_of

#: Factors of the noise: a number in [0, 1) that depends on query and dimension only (fixed values).
NOISE_Q, NOISE_I, NOISE_MOD = 7919, 104729, 10007


def unit_noise(qid: Column, i: Column) -> Column:
    return F.pmod(qid.cast("long") * NOISE_Q + (i.cast("long") + 1) * NOISE_I, F.lit(NOISE_MOD)).cast("double") / NOISE_MOD


def noise(kind: str, qid: Column, i: Column) -> Column:
    """uniform: 1 + u; normal: 1 + |z| with z a logistic approximation of the normal quantile; zipf: floor(1 / (1 - u)),
    whose tail falls like that of Zipf's law with exponent 2."""
    u = unit_noise(qid, i)
    if kind == "uniform":
        return 1 + u
    if kind == "normal":
        v = (1 + u) / 2
        return 1 + F.abs(F.log(v / (1 - v)) / F.lit(1.702))
    if kind == "zipf":
        return F.floor(1 / (1 - u)).cast("double")
    raise ValueError(kind)


def percentile_spread(base: DataFrame, percent: float, d: int):
    """Distance of the percentiles 50 +- percent / 2 in each dimension."""
    return vector_of(percentiles(base, 0.5 + percent / 200), "value", d) - vector_of(percentiles(base, 0.5 - percent / 200), "value", d)


def with_widths(queries: DataFrame, base: DataFrame, percent: float, kind: str, d: int) -> DataFrame:
    """Queries with widths noise * spread."""
    spread = literal(percentile_spread(base, percent, d), "array<double>")
    return queries.withColumn("rg", F.transform(spread, lambda s, i: (noise(kind, F.col("qid"), i) * s).cast("float")))


def active_dims(queries: DataFrame, count: int, d: int) -> DataFrame:
    """Queries with ``dims``: ``count`` dimensions in ascending order, those of the smallest noise."""
    ranked = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(unit_noise(F.col("qid"), i).alias("u"), i.alias("i"))))
    return queries.withColumn("dims", F.sort_array(F.transform(F.slice(ranked, 1, count), lambda s: s["i"])))


def find_scale(base: DataFrame, queries: DataFrame, lower: int, upper: int, d: int) -> DataFrame:
    """(qid, scale, n): the smallest factor of a query's box with at least ``lower`` rows, and the number of rows in the
    box so scaled, or ``upper`` + 1 if that is more.  Each query keeps at most ``upper`` + 1 rows before the shuffle."""
    scored = theta_join(base, queries, lambda: F.lit(True)).select("qid", "vec_id", D.least_scale(F.col("x"), F.col("q"), F.col("rg"), d).alias("s"))
    near = top_k(scored, "s", upper + 1)
    at = near.groupBy("qid").agg(F.min(F.when(F.col("rank") >= lower, F.col("s"))).alias("scale"))
    return near.join(at, "qid").groupBy("qid").agg(F.first("scale").alias("scale"), F.count(F.when(F.col("s") <= F.col("scale"), 1)).alias("n"))


def range_by_percent(values: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, width): percentile ``share`` of |x - q| over a table of numbers x, for queries (qid, q, share)."""
    pairs = theta_join(values, queries, lambda: F.lit(True)).select(F.col("qid").alias("i"), F.abs(F.col("x") - F.col("q")).alias("v"))
    shares = [r[0] for r in queries.select("share").distinct().collect()]  # the selectivities of a workload are few
    return quantiles(pairs, shares).join(queries.select(F.col("qid").alias("i"), "share"), ["i", "share"]).select(F.col("i").alias("qid"), F.col("value").alias("width"))


def find_percent(mean_size: Callable[[float], float], target: float, tolerance: float = 0.05, most: int = 64, least_step: float = 1e-4) -> tuple[float, float, bool]:
    """(percent, mean size, reached): bisection until the mean result size is within the tolerance of the target, or the
    interval is below ``least_step`` or ``most`` steps are over, when ``reached`` is false."""
    low, high = 0.0, 100.0
    percent = size = 0.0
    reached = False
    for _ in range(most):
        percent = (low + high) / 2
        size = mean_size(percent)
        reached = abs(size - target) <= tolerance * target
        if reached or high - low < least_step:
            break
        low, high = (percent, high) if size < target else (low, percent)
    return percent, size, reached


def hold_out(rows: DataFrame, queries: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(queries, base): the rows with the smallest MD5 of their key are the queries."""
    chosen = rows.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(queries)
    return chosen, rows.join(chosen.select(key), key, "left_anti")
