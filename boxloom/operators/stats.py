"""Statistics of each dimension of a vector column, and table-wide transforms that use them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import literal, norm


def long_form(base: DataFrame, x: str = "x", key: str = "vec_id") -> DataFrame:
    """(key, i, v): a row for each element."""
    return base.select(key, F.posexplode(x).alias("i", "v"))


def per_dim(base: DataFrame, *aggregates: Column, x: str = "x") -> DataFrame:
    """Aggregates of ``v`` for each dimension ``i``; partial sums keep the shuffle at a row per task and dimension."""
    return base.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(*aggregates)


def vector_of(stats: DataFrame, value: str, d: int) -> np.ndarray:
    """A statistic of all ``d`` dimensions as a driver-side vector."""
    out = np.zeros(d)
    for row in stats.select("i", value).collect():  # d rows
        out[row["i"]] = row[value]
    return out


def means(base: DataFrame, d: int) -> np.ndarray:
    return vector_of(per_dim(base, F.avg(F.col("v").cast("double")).alias("m")), "m", d)


def largest(base: DataFrame, d: int) -> np.ndarray:
    return vector_of(per_dim(base, F.max(F.abs(F.col("v").cast("double"))).alias("m")), "m", d)


BINS = 4_096


def quantiles(rows: DataFrame, shares: list[float], lower: bool = False) -> DataFrame:
    """(i, share, value): exact quantiles of ``v`` for each ``i``, interpolated linearly between neighbours, or the lower
    neighbour with ``lower``.

    A histogram of ``BINS`` bins for each ``i`` tells which bins hold the wanted ranks; only the values in these are
    counted and ordered, so no state holds all values of a group."""
    ends = rows.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
    width = F.col("hi") - F.col("lo")
    at = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / width * BINS))).otherwise(F.lit(0)).cast("int")
    binned = rows.join(F.broadcast(ends), "i").select("i", "v", at.alias("bin"))  # ends: a row per i
    before = Window.partitionBy("i").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy("i", "bin").agg(F.count("*").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    wanted = ends.select("i", "n", share.alias("share")).withColumn("rank", F.col("share") * (F.col("n") - 1))
    ranks = wanted.select("i", "share", "rank", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("place")).distinct()
    bins = starts.join(ranks, "i").where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("size")))
    held = binned.join(F.broadcast(bins.select("i", "bin", "start").distinct()), ["i", "bin"])  # a row per i, share and rank
    upto = Window.partitionBy("i", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    values = held.groupBy("i", "bin", "start", "v").agg(F.count("*").alias("times"))
    values = values.withColumn("first", F.col("start") + F.coalesce(F.sum("times").over(upto), F.lit(0)))
    near = values.join(ranks, "i").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("times")))
    low, high = F.min("v"), F.max("v")
    value = low if lower else low + (high - low) * F.first(F.col("rank") - F.floor("rank"))
    return near.groupBy("i", "share").agg(value.alias("value"))


def percentiles(base: DataFrame, at: float, absolute: bool = False) -> DataFrame:
    """(i, value): exact percentile of each dimension."""
    v = F.col("v").cast("double")
    rows = base.select(F.posexplode("x").alias("i", "v")).select("i", (F.abs(v) if absolute else v).alias("v"))
    return quantiles(rows, [at]).select("i", "value")


def shifted(x: Column, by: np.ndarray) -> Column:
    return F.zip_with(x, literal(by, "array<double>"), lambda v, m: v.cast("double") - m)


def divided(x: Column, by: np.ndarray) -> Column:
    """Element-wise quotient; a zero divisor leaves the element as it is."""
    return F.zip_with(x, literal(np.where(by == 0, 1.0, by), "array<double>"), lambda v, m: v.cast("double") / m)


def multiplied(x: Column, by: np.ndarray) -> Column:
    return F.zip_with(x, literal(by, "array<double>"), lambda v, m: v.cast("double") * m)


def zero_mean(base: DataFrame, d: int, x: str = "x") -> DataFrame:
    return base.withColumn(x, shifted(F.col(x), means(base, d)))


def scale_to(base: DataFrame, s: float, d: int, x: str = "x") -> DataFrame:
    """Each dimension scaled to a largest absolute value of ``s``."""
    return base.withColumn(x, divided(F.col(x), largest(base, d) / s))


def scale_mean(base: DataFrame, queries: DataFrame, scalar: float, d: int) -> tuple[DataFrame, DataFrame]:
    """Base and queries minus the base mean, and with the widths divided by the largest absolute value / ``scalar``."""
    mean = means(base, d)
    centred = base.withColumn("x", shifted(F.col("x"), mean))
    scale = np.full(d, largest(centred, d).max() / scalar)
    moved = queries.withColumns({"q": divided(shifted(F.col("q"), mean), scale), "rg": divided(F.col("rg"), scale)})
    return centred.withColumn("x", divided(F.col("x"), scale)), moved


def mips_augmented(base: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One more dimension, so that nearest neighbours are largest inner products: sqrt(M^2 - |x|^2), and 0 for queries."""
    top = base.agg(F.max(norm(F.col("x")))).first()[0] or 0.0
    more = F.sqrt(F.greatest(F.lit(0.0), F.lit(top * top) - F.pow(norm(F.col("x")), F.lit(2))))
    double = lambda c: F.transform(c, lambda v: v.cast("double"))
    return base.withColumn("x", F.concat(double(F.col("x")), F.array(more))), queries.withColumn("q", F.concat(double(F.col("q")), F.array(F.lit(0.0))))


def extent(base: DataFrame) -> DataFrame:
    """(i, lo, hi, centre, half) of each dimension."""
    v = F.col("v").cast("double")
    rows = per_dim(base, F.min(v).alias("lo"), F.max(v).alias("hi"))
    return rows.select("i", "lo", "hi", ((F.col("lo") + F.col("hi")) / 2).alias("centre"), ((F.col("hi") - F.col("lo")) / 2).alias("half"))


def sparse_to_dense(queries: DataFrame, base: DataFrame, d: int) -> DataFrame:
    """Queries whose inactive dimensions get the base's centre and half-width, so that the dense test equals the sparse one."""
    rows = extent(base)
    centre, half = literal(vector_of(rows, "centre", d), "array<double>"), literal(vector_of(rows, "half", d), "array<double>")
    pick = lambda own, other: F.zip_with(F.sequence(F.lit(0), F.lit(d - 1)), other, lambda i, v: F.when(F.array_contains("dims", i), own[i].cast("double")).otherwise(v))
    return queries.withColumns({"q": pick(F.col("q"), centre), "rg": pick(F.col("rg"), half)})
