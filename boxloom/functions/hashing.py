"""Locality-sensitive hashes with seeded projections that are injected as literals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dot, literal

SEED = 808
DIGITS = 9  # hash inputs are rounded, so that two engines agree at a boundary


@dataclass(frozen=True)
class E2Lsh:
    """``tables`` hash tables of ``functions`` projections each, with bucket width ``r``."""

    d: int
    functions: int
    r: float
    tables: int = 1
    seed: int = SEED

    @property
    def projections(self) -> np.ndarray:
        return np.round(np.random.default_rng(self.seed).normal(size=(self.tables, self.functions, self.d)), 6)

    @property
    def offsets(self) -> np.ndarray:
        return np.round(np.random.default_rng(self.seed + 1).uniform(0, self.r, size=(self.tables, self.functions)), 6)

    def position(self, x: Column, table: int) -> Column:
        """(a.x + b) / r for each function of a table."""
        rows, offsets = literal(self.projections[table], "array<array<double>>"), literal(self.offsets[table], "array<double>")
        return F.zip_with(rows, offsets, lambda a, b: F.round((dot(a, x) + b) / F.lit(self.r), DIGITS))

    def hash(self, x: Column, table: int) -> Column:
        return F.transform(self.position(x, table), lambda v: F.ceil(v).cast("int"))

    def hash_truncated(self, x: Column, table: int = 0) -> Column:
        """Variant with one offset for all functions and truncation toward zero."""
        rows, offset = literal(self.projections[table], "array<array<double>>"), float(self.offsets[table][0])
        return F.transform(rows, lambda a: F.round((dot(a, x) + F.lit(offset)) / F.lit(self.r), DIGITS).cast("int"))

    def reach(self, w: Column, table: int) -> Column:
        """How far a box of half-widths w extends along each function, in buckets."""
        rows = literal(np.abs(self.projections[table]), "array<array<double>>")
        return F.transform(rows, lambda a: dot(a, w) / F.lit(self.r))

    def probes(self, q: Column, w: Column, table: int) -> Column:
        """The home bucket, and its neighbour along each function whose boundary the box crosses, in all combinations."""
        home = self.position(q, table)
        options = F.zip_with(home, self.reach(w, table), lambda v, s: F.filter(F.array(F.ceil(v), F.when(F.ceil(F.round(v - s, DIGITS)) < F.ceil(v), F.ceil(v) - 1), F.when(F.ceil(F.round(v + s, DIGITS)) > F.ceil(v), F.ceil(v) + 1)), lambda k: k.isNotNull()))
        start = F.array(F.array().cast("array<int>"))
        return F.aggregate(options, start, lambda keys, more: F.flatten(F.transform(keys, lambda key: F.transform(more, lambda k: F.concat(key, F.array(k.cast("int")))))))


@dataclass(frozen=True)
class SignHash:
    """``bits`` signs of random projections."""

    d: int
    bits: int
    tables: int = 1
    seed: int = SEED

    @property
    def projections(self) -> np.ndarray:
        return np.round(np.random.default_rng(self.seed + 2).normal(size=(self.tables, self.bits, self.d)), 6)

    def products(self, x: Column, table: int) -> Column:
        return F.transform(literal(self.projections[table], "array<array<double>>"), lambda a: F.round(dot(a, x), DIGITS))

    def key(self, x: Column, table: int) -> Column:
        """The bits (product > 0) as one number, first bit most significant."""
        return F.aggregate(self.products(x, table), F.lit(0).cast("long"), lambda h, v: F.shiftleft(h, 1) + F.when(v > 0, 1).otherwise(0))

    def signs(self, x: Column, table: int = 0) -> Column:
        return F.transform(self.products(x, table), lambda v: F.signum(v).cast("int"))
