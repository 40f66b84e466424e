"""Vector quantizers: product, residual, rotated and norm-explicit.

A codebook is a small driver-side array (parts x centroids x dimensions); encoding and decoding inject it as a literal
and run as column expressions.  Training iterates aggregations over the base; each step brings one row per
centroid and dimension to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.vectors import let, literal, norm, normalized, split_dims
from .stats import quantiles

DIGITS = 9
POWERS = (1, 2, 3, 4, 6, 8, 16)


@dataclass
class Codebook:
    """Centroids of each subspace: ``parts[m]`` is (first dimension, number), ``centroids[m]`` a (ks x number) array."""

    parts: list[tuple[int, int]]
    centroids: list[np.ndarray]
    p: int = 2

    @property
    def ks(self) -> int:
        return len(self.centroids[0])

    def _part(self, m: int) -> Column:
        return literal(self.centroids[m], "array<array<double>>")

    def distances(self, x: Column, m: int) -> Column:
        """Sum of |x - c| ** p to each centroid of a subspace."""
        first, n = self.parts[m]
        piece = F.slice(x, first + 1, n)
        return F.transform(self._part(m), lambda c: F.round(D.squared(piece, c) if self.p == 2 else D.power_sum(piece, c, self.p), DIGITS))

    def nearest(self, x: Column, m: int) -> Column:
        """(dist, k) of the nearest centroid; ties go to the lowest k."""
        return F.array_min(F.transform(self.distances(x, m), lambda v, k: F.struct(v.alias("dist"), k.alias("k"))))

    def encode(self, x: Column) -> Column:
        return F.array(*[self.nearest(x, m)["k"] for m in range(len(self.parts))])

    def decode(self, code: Column) -> Column:
        return F.flatten(F.array(*[F.get(self._part(m), F.get(code, F.lit(m))) for m in range(len(self.parts))]))

    def compress(self, x: Column) -> Column:
        return let(self.encode(x), self.decode)

    def adc_table(self, q: Column, w: Column, p: int = 2) -> Column:
        """Weighted distances of the query's subspaces to all centroids: an array of ``ks`` values for each part."""

        def table(m: int) -> Column:
            first, n = self.parts[m]
            over, qs, ws = F.sequence(F.lit(0), F.lit(n - 1)), F.slice(q, first + 1, n), F.slice(w, first + 1, n)
            return F.transform(self._part(m), lambda c: F.round(D.weighted(c, qs, ws, p, over), DIGITS))

        return F.array(*map(table, range(len(self.parts))))


def adc(table: Column, code: Column, parts: int) -> Column:
    """Asymmetric distance: the table's entries at the code, summed."""
    return sum((F.get(F.get(table, F.lit(m)), F.get(code, F.lit(m))) for m in range(parts)), F.lit(0.0))


def first_rows(base: DataFrame, ks: int, parts: list[tuple[int, int]], p: int = 2) -> Codebook:
    """A codebook from the ``ks`` rows of smallest id, as a fixed model or a start for training."""
    rows = np.array([r["x"] for r in base.orderBy("vec_id").limit(ks).select("x").collect()], np.float64)
    if len(rows) < ks:
        raise ValueError("there must be at least ks rows")
    return Codebook(parts, [rows[:, first : first + n] for first, n in parts], p)


def lloyd(base: DataFrame, book: Codebook, weight: Column | str | None = None) -> Codebook:
    """One step of (weighted) k-means: means of the rows nearest to each centroid; an empty cluster keeps its centroid.
    ``weight``: a column, ``cluster_size`` or ``cluster_radius``."""
    if book.p != 2:
        return newton(base, book)
    new = []
    for m, (first, n) in enumerate(book.parts):
        rows = base.select(F.slice("x", first + 1, n).alias("piece"), book.nearest(F.col("x"), m).alias("near"), (weight if isinstance(weight, Column) else F.lit(1.0)).alias("w"))
        if weight == "cluster_radius":
            rows = rows.withColumn("w", F.sqrt("near.dist"))
        # "cluster_size" gives all rows of a cluster one weight, which their mean does not depend on
        long = rows.select("near.k", "w", F.posexplode("piece").alias("i", "v"))
        sums = long.groupBy("k", "i").agg((F.sum(F.col("w") * F.col("v").cast("double")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
        centroids = book.centroids[m].copy()
        for r in sums.where("mean is not null").collect():  # ks x n rows
            centroids[r["k"], r["i"]] = r["mean"]
        new.append(centroids)
    return Codebook(book.parts, new, book.p)


def newton(base: DataFrame, book: Codebook, steps: int = 10) -> Codebook:
    """Centroids moved by Newton steps on the sum of |x - c| ** p, members fixed; for p = 1 the second derivative is 0
    and centroids stay."""
    p = book.p
    if p not in POWERS:
        raise ValueError(f"p must be one of {POWERS}")
    new = []
    for m, (first, n) in enumerate(book.parts):
        members = base.select(F.slice("x", first + 1, n).alias("piece"), book.nearest(F.col("x"), m)["k"].alias("k"))
        centroids = book.centroids[m].copy()
        for _ in range(steps if p > 1 else 0):
            for r in newton_sums(members, centroids, p).collect():  # ks x n rows
                if r["h"]:
                    centroids[r["k"], r["i"]] -= r["g"] / r["h"]
        new.append(centroids)
    return Codebook(book.parts, new, p)


def newton_sums(members: DataFrame, centroids: np.ndarray, p: int) -> DataFrame:
    """(k, i, g, h): sums of first and second derivatives, up to the factor p, over members (k, piece)."""
    at = literal(centroids, "array<array<double>>")
    t = F.zip_with("piece", F.get(at, F.col("k")), lambda v, c: c - v.cast("double"))
    long = members.select("k", F.posexplode(t).alias("i", "t"))
    power = F.pow(F.abs("t"), F.lit(p - 2))
    return long.groupBy("k", "i").agg(F.sum(F.col("t") * power).alias("g"), F.sum((p - 1) * power).alias("h"))


@dataclass
class PQ:
    """Product quantizer."""

    parts: int
    ks: int
    p: int = 2
    book: Codebook | None = None

    def fit(self, base: DataFrame, d: int, steps: int = 5, weight: Column | str | None = None) -> PQ:
        self.book = first_rows(base, self.ks, split_dims(d, self.parts), self.p)
        for _ in range(steps):
            self.book = lloyd(base, self.book, weight)
        return self

    def encode(self, x: Column) -> Column:
        return self.book.encode(x)

    def decode(self, code: Column) -> Column:
        return self.book.decode(code)

    def compress(self, x: Column) -> Column:
        return self.book.compress(x)


@dataclass
class RQ:
    """Residual quantizer: each layer quantizes what the layers before left."""

    layers: list[PQ]

    def fit(self, base: DataFrame, d: int, steps: int = 5, weight: Column | str | None = None) -> RQ:
        rest = base
        for layer in self.layers:
            layer.fit(rest, d, steps, weight)
            rest = rest.withColumn("x", F.zip_with("x", layer.compress(F.col("x")), lambda a, b: a.cast("double") - b))
        return self

    def encode(self, x: Column) -> Column:
        """An array with the code of each layer."""

        def step(rest: Column, left: list[PQ]) -> Column:
            if len(left) == 1:
                return F.array(left[0].encode(rest))
            remain = lambda code: F.zip_with(rest, left[0].decode(code), lambda a, b: a.cast("double") - b)
            return let(left[0].encode(rest), lambda code: F.concat(F.array(code), let(remain(code), lambda r: step(r, left[1:]))))

        return step(x, self.layers)

    def decode(self, codes: Column) -> Column:
        out = self.layers[0].decode(F.get(codes, F.lit(0)))
        for k, layer in enumerate(self.layers[1:], 1):
            out = F.zip_with(out, layer.decode(F.get(codes, F.lit(k))), lambda a, b: a + b)
        return out

    def compress(self, x: Column) -> Column:
        return let(self.encode(x), self.decode)


def rotated(x: Column, rotation: np.ndarray) -> Column:
    """The row vector x times a matrix."""
    return F.transform(literal(rotation.T, "array<array<double>>"), lambda column: F.aggregate(F.zip_with(x, column, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda u, v: u + v))


def cross_moments(rows: DataFrame, a: str, b: str, d: int) -> np.ndarray:
    """The d x d matrix of sums of products: a matrix product for each batch of rows, summed in Spark."""

    def products(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (np.asarray(batch[c].flatten(), np.float64).reshape(-1, d) for c in ("a", "b"))
                yield pa.RecordBatch.from_arrays([pa.array([(left.T @ right).ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    parts = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInArrow(products, "m array<double>")
    out = np.zeros(d * d)
    for r in parts.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s")).collect():  # d * d rows
        out[r["i"]] = r["s"]
    return out.reshape(d, d)


#: Weight of the rotation before, against the largest singular value of the moments.
KEEP = 1e-6


def procrustes(moments: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The orthogonal matrix that fits the moments best.  Directions that the codebook does not span, in which every
    matrix fits alike, turn as little as they can from ``before``, so that rounding does not choose among them."""
    u, _, v = np.linalg.svd(moments + KEEP * np.linalg.norm(moments, 2) * before)
    return u @ v


@dataclass
class OPQ:
    """Product (or residual) quantizer after a rotation that is fitted by alternating with a Procrustes step, p = 2."""

    parts: int
    ks: int
    layers: int = 1
    rotation: np.ndarray | None = None
    rq: RQ | None = None

    def fit(self, base: DataFrame, d: int, rotations: int = 3, steps: int = 5) -> OPQ:
        self.rotation = np.eye(d)
        for k in range(rotations):
            turned = base.withColumn("y", rotated(F.col("x"), self.rotation))
            last = k == rotations - 1
            self.rq = RQ([PQ(self.parts, self.ks) for _ in range(self.layers)]).fit(turned.select("vec_id", F.col("y").alias("x")), d, steps if last else 1)
            if not last:
                self.rotation = procrustes(cross_moments(turned.withColumn("z", self.rq.compress(F.col("y"))), "x", "z", d), self.rotation)
        return self

    def rotate(self, x: Column) -> Column:
        return rotated(x, self.rotation)

    def encode(self, x: Column) -> Column:
        return let(self.rotate(x), self.rq.encode)

    def decode(self, codes: Column) -> Column:
        return let(self.rq.decode(codes), lambda y: rotated(y, self.rotation.T))

    def compress(self, x: Column) -> Column:
        return let(self.encode(x), self.decode)


def quantile_values(norms: DataFrame, shares: list[float]) -> list[float]:
    """Quantiles of the column ``n``."""
    rows = quantiles(norms.select(F.lit(0).alias("i"), F.col("n").alias("v")), shares)
    return [r["value"] for r in rows.orderBy("share").collect()]  # a row per share


@dataclass
class NEQ:
    """Norm-explicit quantizer: the direction by an inner quantizer, the (corrected) norm by ``ks`` levels.

    ``method``: kmeans, kmeans_partial (half of the levels for the smaller 70 % of the norms), percentile, uniform or
    exponential.  The last three have ``ks`` bins with their midpoints as levels; the largest norm is in the last bin."""

    ks: int
    quantizer: PQ | RQ
    method: str = "kmeans"
    ratio: float = 0.98
    levels: list[float] = field(default_factory=list)

    def corrected(self, x: Column) -> Column:
        """Norm of x over that of its compressed direction."""
        return let(norm(self.quantizer.compress(normalized(x))), lambda n: F.when(n != 0, norm(x) / n).otherwise(F.lit(0.0)))

    def fit(self, base: DataFrame, d: int, steps: int = 5) -> NEQ:
        self.quantizer.fit(base.withColumn("x", normalized(F.col("x"))), d, steps)
        norms = base.select(F.round(self.corrected(F.col("x")), DIGITS).alias("n"))
        if self.method == "kmeans":
            self.levels = self._kmeans(norms, self.ks, steps)
        elif self.method == "kmeans_partial":
            cut = quantile_values(norms, [0.7])[0]
            self.levels = self._kmeans(norms.where(F.col("n") <= cut), self.ks // 2, steps) + self._kmeans(norms.where(F.col("n") > cut), self.ks // 2, steps)
        elif self.method == "percentile":
            self.levels = quantile_values(norms, np.linspace(0, 1, self.ks + 1).tolist())
        elif self.method in ("uniform", "exponential"):
            lo, hi = norms.agg(F.min("n"), F.max("n")).first()
            share = np.linspace(0, 1, self.ks + 1) if self.method == "uniform" else (1 - self.ratio ** np.arange(self.ks + 1)) / (1 - self.ratio**self.ks)
            self.levels = [float(lo + s * (hi - lo)) for s in share]
        else:
            raise ValueError(self.method)
        return self

    @staticmethod
    def _kmeans(norms: DataFrame, ks: int, steps: int) -> list[float]:
        levels = quantile_values(norms, [(k + 0.5) / ks for k in range(ks)])
        for _ in range(steps):
            near = F.array_min(F.transform(literal(levels, "array<double>"), lambda c, k: F.struct(F.abs(c - F.col("n")).alias("dist"), k.alias("k"))))["k"]
            for r in norms.groupBy(near.alias("k")).agg(F.avg("n").alias("m")).collect():  # ks rows
                levels[r["k"]] = r["m"]
        return list(levels)

    def encode_norm(self, n: Column) -> Column:
        if self.method.startswith("kmeans"):
            return F.array_min(F.transform(literal(self.levels, "array<double>"), lambda c, k: F.struct(F.round(F.abs(c - n), DIGITS).alias("dist"), k.alias("k"))))["k"]
        inner = literal(self.levels[1:-1], "array<double>")
        return F.size(F.filter(inner, lambda edge: edge <= n))

    def decode_norm(self, k: Column) -> Column:
        levels = np.array(self.levels)
        values = levels if self.method.startswith("kmeans") else (levels[1:] + levels[:-1]) / 2
        return F.get(literal(values, "array<double>"), k)

    def compress(self, x: Column) -> Column:
        level = self.decode_norm(self.encode_norm(F.round(self.corrected(x), DIGITS)))
        return let(level, lambda s: F.transform(self.quantizer.compress(normalized(x)), lambda v: v * s))
