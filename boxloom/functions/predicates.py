"""Box predicates.  All are inclusive, work on the difference form |x - q| <= w in the elements' own type, and stop at
the first dimension that fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dims


def in_box(x: Column, q: Column, w: Column, d: int) -> Column:
    """The point x lies in the box of half-widths w around q.  A negative width matches nothing."""
    return ~F.exists(dims(d), lambda i: F.abs(x[i] - q[i]) > w[i])


def in_scaled_box(x: Column, q: Column, w: Column, scale: Column, d: int) -> Column:
    return ~F.exists(dims(d), lambda i: F.abs(x[i] - q[i]) > scale * w[i])


def in_sparse_box(x: Column, q: Column, w: Column, active: Column) -> Column:
    """As :func:`in_box` on the active dimensions only."""
    return ~F.exists(active, lambda i: F.abs(x[i] - q[i]) > w[i])


def in_cube(x: Column, q: Column, radius: float, d: int) -> Column:
    return ~F.exists(dims(d), lambda i: F.abs(x[i] - q[i]) > F.lit(radius).cast("float"))


def boxes_overlap(x: Column, xw: Column, q: Column, qw: Column, d: int) -> Column:
    return ~F.exists(dims(d), lambda i: F.abs(x[i] - q[i]) > xw[i] + qw[i])


def box_reaches(lo: Column, hi: Column, q: Column, w: Column, first: int, n: int) -> Column:
    """The box [lo, hi] of a subspace meets the query's box in the dimensions first .. first + n - 1."""
    return ~F.exists(dims(n), lambda i: (lo[i] - q[i + first] > w[i + first]) | (q[i + first] - hi[i] > w[i + first]))


def sparse_box_reaches(lo: Column, hi: Column, q: Column, w: Column, active: Column, first: int, n: int) -> Column:
    here = F.filter(active, lambda i: (i >= first) & (i < first + n))
    return ~F.exists(here, lambda i: (lo[i - first] - q[i] > w[i]) | (q[i] - hi[i - first] > w[i]))


def violations(x: Column, q: Column, w: Column, d: int) -> Column:
    return F.size(F.filter(dims(d), lambda i: F.abs(x[i] - q[i]) > w[i]))
