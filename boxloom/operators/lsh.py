"""Locality-sensitive hashing: tables are (table_id, hash, vec_id), lookups are equi-joins on (table_id, hash)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.hashing import E2Lsh, SignHash
from ..functions.vectors import dims
from .joins import theta_join


def hash_rows(rows: DataFrame, of: Callable[[int], Column], tables: int, key: str, extra: list[str] = ()) -> DataFrame:
    """(table_id, hash, key): a row per table."""
    entries = F.array(*[F.struct(F.lit(t).alias("table_id"), of(t).alias("hash")) for t in range(tables)])
    return rows.select(key, *extra, F.explode(entries).alias("e")).select(key, *extra, "e.table_id", "e.hash")


def build(base: DataFrame, lsh: E2Lsh) -> DataFrame:
    return hash_rows(base, lambda t: lsh.hash(F.col("x"), t), lsh.tables, "vec_id")


def build_signs(base: DataFrame, lsh: SignHash) -> DataFrame:
    return hash_rows(base, lambda t: lsh.key(F.col("x"), t), lsh.tables, "vec_id")


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, vec_id), once each, of rows that share a bucket with a key in any table."""
    return index.join(keys, ["table_id", "hash"]).select("qid", "vec_id").distinct()


def home_keys(queries: DataFrame, lsh: E2Lsh) -> DataFrame:
    return hash_rows(queries, lambda t: lsh.hash(F.col("q"), t), lsh.tables, "qid")


def probe_keys(queries: DataFrame, lsh: E2Lsh) -> DataFrame:
    """Home buckets and those neighbours that the query's box reaches."""
    many = hash_rows(queries, lambda t: lsh.probes(F.col("q"), F.col("rg"), t), lsh.tables, "qid")
    return many.select("qid", "table_id", F.explode("hash").alias("hash"))


def split_range(queries: DataFrame, axes: int, d: int) -> DataFrame:
    """(qid, q) centres: the box is cut along its ``axes`` widest dimensions into floor(w / next + 0.6) parts each, next
    being the width that follows in order."""
    order = F.sort_array(F.transform(dims(d), lambda i: F.struct((-F.col("rg")[i].cast("double")).alias("w"), i.alias("i"))))
    out = queries.withColumn("order", order).withColumn("next", -F.col("order")[axes]["w"])
    for n in range(axes):
        axis, width = F.col("order")[n]["i"], -F.col("order")[n]["w"]
        parts = F.greatest(F.lit(1), F.floor(width / F.col("next") + 0.6)).cast("int")
        out = out.withColumn("part", F.explode(F.sequence(F.lit(1), parts))).withColumn("parts", parts)
        out = out.withColumn("q", F.zip_with(dims(d), "q", moved(axis, width)))
    return out.select("qid", "q")


def moved(axis: Column, width: Column):
    """Puts the centre of part ``part`` of ``parts`` at the place of the axis."""
    return lambda i, v: F.when(i == axis, v.cast("double") - width + (2 * F.col("part") - 1) * width / F.col("parts")).otherwise(v.cast("double"))


def ranked_probe(base: DataFrame, queries: DataFrame, lsh: E2Lsh, items: int) -> DataFrame:
    """(qid, vec_id): whole buckets in ascending L1 distance of their keys until at least ``items`` rows are taken.
    Ties go to the smaller key.  The stated queries meet every bucket, not every row."""
    hashed = base.select("vec_id", lsh.hash_truncated(F.col("x")).alias("hash"))
    buckets = hashed.groupBy("hash").agg(F.count("*").alias("n"))
    keys = queries.select("qid", lsh.hash_truncated(F.col("q")).alias("key"))
    order = Window.partitionBy("qid").orderBy("dist", "hash").rowsBetween(Window.unboundedPreceding, -1)
    pairs = theta_join(buckets, keys, lambda: F.lit(True)).withColumn("dist", D.l1(F.col("hash"), F.col("key")))
    taken = pairs.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < items)
    return taken.select("qid", "hash").join(hashed, "hash").select("qid", "vec_id")


def table_stats(index: DataFrame) -> DataFrame:
    """Number of buckets of each table and, in every row, their mean."""
    rows = index.groupBy("table_id").agg(F.count_distinct("hash").alias("buckets"))
    return rows.withColumn("mean_buckets", F.avg("buckets").over(Window.partitionBy()))  # a row per table
