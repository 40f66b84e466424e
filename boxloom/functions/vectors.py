"""Column expressions over array columns that hold one vector each.  All are JVM-side higher-order functions."""

from __future__ import annotations

import json
from math import comb

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values, kind: str) -> Column:
    """A (nested) array literal; folded to a constant by the optimizer."""
    return F.from_json(F.lit(json.dumps(np.asarray(values).tolist())), kind)


def dims(d: int) -> Column:
    return F.sequence(F.lit(0), F.lit(d - 1))


def total(values: Column) -> Column:
    """Sum of an array of doubles, in array order."""
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def valid(x: Column, d: int) -> Column:
    """Ingest rule: ``d`` elements, none null or NaN."""
    return x.isNotNull() & (F.size(x) == d) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))


def checked(rows, d: int, x: str = "x"):
    """``rows``, or an error that says how many break the ingest rule (a count over all rows)."""
    bad = rows.where(~F.coalesce(valid(F.col(x), d), F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} vectors do not have {d} numbers")
    return rows


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def normalized(x: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    return let(norm(x), lambda n: F.transform(x, lambda v: F.when(n != 0, v.cast("double") / n).otherwise(F.lit(0.0))))


def split_dims(d: int, parts: int) -> list[tuple[int, int]]:
    """(first dimension, number) of each subspace; the first ``d % parts`` get one more."""
    sizes = [d // parts + (m < d % parts) for m in range(parts)]
    return [(sum(sizes[:m]), n) for m, n in enumerate(sizes)]


def subspaces(x: Column, parts: list[tuple[int, int]]) -> Column:
    return F.array(*[F.slice(x, first + 1, n) for first, n in parts])


def inner_product_sides(x: Column, q: Column, w: Column, p: int, stored_widths: bool = False) -> tuple[Column, Column]:
    """Sides whose inner product is minus the weighted L_p distance, for even ``p``.  The widths belong to the query, or
    to the stored vector with ``stored_widths``."""
    if p % 2:
        raise ValueError("p must be even")

    def power(v: Column, k: int) -> Column:
        return F.pow(v.cast("double"), F.lit(k))

    def term(k: int) -> tuple[Column, Column]:
        weight = F.lit(-float(comb(p, k) * (-1) ** k))
        if stored_widths:
            return F.zip_with(x, w, lambda v, r: weight * power(v, p - k) / power(r, p)), F.transform(q, lambda v: power(v, k))
        return F.transform(x, lambda v: weight * power(v, p - k)), F.zip_with(q, w, lambda v, r: power(v, k) / power(r, p))

    left, right = (F.concat(*side) for side in zip(*map(term, range(p + 1)), strict=True))
    return left, right


def trig(x: Column) -> Column:
    return F.concat(F.transform(x, lambda v: F.cos(v)), F.transform(x, lambda v: F.sin(v)))


def trig_weighted(q: Column, w: Column) -> Column:
    return F.concat(F.zip_with(q, w, lambda v, r: r * F.cos(v)), F.zip_with(q, w, lambda v, r: r * F.sin(v)))
