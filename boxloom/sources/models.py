"""Files of a trained quantizer: codebook (.fvecs, parts * ks rows padded to the widest subspace), codes (.ivecs) and the
scale of the dimensions (.fvecs, one row); result records and stored truth."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text, vecs


def write_centroids(spark: SparkSession, centroids: list[np.ndarray], path: str) -> None:
    width = max(c.shape[1] for c in centroids)
    padded = np.concatenate([np.pad(c, ((0, 0), (0, width - c.shape[1]))) for c in centroids])
    vecs.write(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(padded)], "vec_id long, x array<float>"), path, "fvecs")


def write_codes(codes: DataFrame, path: str) -> None:
    """(vec_id, code), in ascending order of the id."""
    vecs.write(codes.select("vec_id", F.col("code").cast("array<int>").alias("x")), path, "ivecs")


def write_scale(spark: SparkSession, scale: np.ndarray, path: str) -> None:
    vecs.write(spark.createDataFrame([(0, [float(v) for v in scale])], "vec_id long, x array<float>"), path, "fvecs")


def read_codes(spark: SparkSession, path: str, rows: int, parts: int) -> DataFrame:
    """(vec_id, code); refused unless there are ``rows`` codes of ``parts`` numbers."""
    return vecs.read(spark, path, "ivecs", parts, rows).select("vec_id", F.col("x").alias("code"))


def read_scale(spark: SparkSession, path: str, d: int) -> np.ndarray:
    """The scale of each dimension, from a file of one row; refused if it has another shape."""
    return np.array(vecs.read(spark, path, "fvecs", d, 1).first()["x"], np.float32)


def scaled_centroids(centroids: DataFrame, scale: np.ndarray, parts: list[tuple[int, int]]) -> DataFrame:
    """(m, k, centroid) times the scale of each subspace's dimensions; padding stays zero."""
    pieces = F.array(*[F.array(*[F.lit(float(v)) for v in scale[first : first + n]]) for first, n in parts])
    own = F.get(pieces, F.col("m"))
    return centroids.withColumn("centroid", F.transform("centroid", lambda v, i: (v * F.coalesce(F.get(own, i), F.lit(0.0))).cast("float")))


def write_records(rows: DataFrame, path: str) -> None:
    """Workload records (dataset, kind, target, size, percent) as comma-separated lines without a header."""
    rows.select("dataset", "kind", "target", "size", "percent").write.mode("overwrite").csv(path, ignoreLeadingWhiteSpace=True)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="dataset string, kind string, target int, size double, percent double", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def truth(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """(qid, ids) from ``path``, computed and written there first if there is nothing yet."""
    if not vecs.exists(path):
        text.write_id_lists(compute(), path)
    return text.read_id_lists(spark, path)
