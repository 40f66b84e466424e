"""Distances, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dims, total


def ratio(difference: Column, width: Column) -> Column:
    """|difference| / width; with a width of zero infinite, or 0 where both coincide."""
    t, w = F.abs(difference), width.cast("double")
    return F.when(w != 0, t / w).when(t == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


def weighted(x: Column, q: Column, w: Column, p: int, over: Column) -> Column:
    """Sum over the given dimensions of (|x - q| / w) ** p, without a root."""
    return total(F.transform(over, lambda i: F.pow(ratio(x[i].cast("double") - q[i].cast("double"), w[i]), F.lit(p))))


def weighted_dense(x: Column, q: Column, w: Column, p: int, d: int) -> Column:
    return weighted(x, q, w, p, dims(d))


def squared(x: Column, q: Column) -> Column:
    return total(F.zip_with(x, q, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))))


def l2(x: Column, q: Column) -> Column:
    return F.sqrt(squared(x, q))


def power_sum(x: Column, q: Column, p: int) -> Column:
    return total(F.zip_with(x, q, lambda a, b: F.pow(F.abs(a.cast("double") - b.cast("double")), F.lit(p))))


def least_scale(x: Column, q: Column, w: Column, d: int) -> Column:
    """The smallest factor of the box around q that takes x in."""
    return F.array_max(F.transform(dims(d), lambda i: ratio(x[i].cast("double") - q[i].cast("double"), w[i])))


def hamming(a: Column, b: Column) -> Column:
    """Share of unequal elements."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda v: v)) / F.size(a)


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda u, v: u + v)
