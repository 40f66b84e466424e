"""Changes of a vector table: insertion, deletion, and the smallest coordinate of a dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(base: DataFrame, new: DataFrame) -> DataFrame:
    return base.unionByName(new)


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("vec_id"), "vec_id", "left_anti")


def find_min(base: DataFrame, d: int) -> DataFrame:
    """(i, vec_id, v): the row with the smallest coordinate in each dimension, ties by id."""
    rows = base.select("vec_id", F.posexplode("x").alias("i", "v"))
    least = rows.groupBy("i").agg(F.min(F.struct("v", "vec_id")).alias("m"))
    return least.where(F.col("i") < d).select("i", "m.vec_id", "m.v")
