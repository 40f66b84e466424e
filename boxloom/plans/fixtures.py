"""Frames that the queries work on, and their SQL counterparts.

Base: the ``embeddings`` table.  Queries: every base row whose id is divisible by 100.  Half-widths are closed forms
of query and dimension, so that both engines compute the same; codebooks are the base rows of smallest id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dims, split_dims, valid
from ..operators.quantize import Codebook, first_rows

D = 64
KS, PARTS = 16, 4
CELL_KS = 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("x"))
    return rows.where(valid(F.col("x"), D))


def widths(factor: float = 1.0):
    w = F.transform(dims(D), lambda i: ((F.lit(30) + F.pmod(F.col("qid") * 7 + i * 3, F.lit(13))) / F.lit(100.0)).cast("float"))
    return w if factor == 1.0 else F.transform(w, lambda v: v * F.lit(factor).cast("float"))


def queries(spark: SparkSession, sf_dir: str, factor: float = 1.0) -> DataFrame:
    rows = base(spark, sf_dir).where(F.col("vec_id") % 100 == 0)
    return rows.select(F.col("vec_id").alias("qid"), F.col("x").alias("q")).withColumn("rg", widths(factor))


def boxes(spark: SparkSession, sf_dir: str, factor: float = 1.0) -> DataFrame:
    """Base rows with half-widths of their own."""
    rg = F.transform(dims(D), lambda i: ((F.lit(30) + F.pmod(F.col("vec_id") * 5 + i, F.lit(13))) / F.lit(100.0)).cast("float") * F.lit(factor).cast("float"))
    return base(spark, sf_dir).withColumn("rg", rg)


def with_dims(rows: DataFrame) -> DataFrame:
    """Queries with eight active dimensions."""
    return rows.withColumn("dims", F.filter(dims(D), lambda i: F.pmod(i + F.col("qid") / 100, F.lit(8)) == 0))


def book(spark: SparkSession, sf_dir: str) -> Codebook:
    return first_rows(base(spark, sf_dir), KS, split_dims(D, PARTS))


def cell_book(spark: SparkSession, sf_dir: str) -> Codebook:
    return first_rows(base(spark, sf_dir), CELL_KS, split_dims(D, 2))


#: Common table expressions.  ``b``: base elements; ``q``: query elements; ``cb``: codebook; ``ccb``: cell codebook.
B = "b AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS x FROM embeddings)"


def q_sql(factor: float = 1.0) -> str:
    w = "CAST((30 + (vec_id * 7 + i * 3) % 13) / 100.0 AS FLOAT)"
    w = w if factor == 1.0 else f"{w} * CAST({factor} AS FLOAT)"
    return f"q AS (SELECT vec_id AS qid, i, x AS q, {w} AS rg FROM b WHERE vec_id % 100 = 0)"


Q, Q_HALF = q_sql(), q_sql(0.5)
ACTIVE_SQL = "(i + qid // 100) % 8 = 0"
HITS = "hits AS (SELECT qid, vec_id FROM b JOIN q USING (i) GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= rg))"
CB = "cb AS (SELECT CAST(i // 16 AS INTEGER) AS m, vec_id AS k, i, CAST(x AS DOUBLE) AS c FROM b WHERE vec_id < 16)"
CODES = """codes AS (SELECT vec_id, m, k FROM (
  SELECT b.vec_id, cb.m, cb.k, row_number() OVER (PARTITION BY b.vec_id, cb.m ORDER BY round(sum((x - c) * (x - c)), 9), cb.k) AS r
  FROM b JOIN cb USING (i) GROUP BY b.vec_id, cb.m, cb.k) WHERE r = 1)"""
DECODED = "decoded AS (SELECT vec_id, i, c AS v FROM codes JOIN cb USING (m, k))"
ADC = "adct AS (SELECT qid, m, k, round(sum(pow(abs(CAST(q AS DOUBLE) - c) / rg, 2)), 9) AS dist FROM q JOIN cb USING (i) GROUP BY qid, m, k)"
BOUNDS = """bounds AS (SELECT m, k, i, least(c, coalesce(lo, c)) AS lo, greatest(c, coalesce(hi, c)) AS hi FROM cb LEFT JOIN (
  SELECT m, k, i, min(CAST(x AS DOUBLE)) AS lo, max(CAST(x AS DOUBLE)) AS hi FROM b JOIN codes USING (vec_id) WHERE codes.m = b.i // 16 GROUP BY m, k, i) USING (m, k, i))"""
REACH = "reach AS (SELECT qid, m, k FROM bounds JOIN q USING (i) GROUP BY qid, m, k HAVING bool_and(lo - q <= rg AND q - hi <= rg))"
PQ_PASS = "pq_pass AS (SELECT qid, vec_id FROM codes JOIN reach USING (m, k) GROUP BY qid, vec_id HAVING count(*) = 4)"
CELL_CB = "ccb AS (SELECT CAST(i // 32 AS INTEGER) AS m, vec_id AS k, i, CAST(x AS DOUBLE) AS c FROM b WHERE vec_id < 8)"
CELL_CODES = """ccodes AS (SELECT vec_id, max(CASE WHEN m = 0 THEN k END) AS k0, max(CASE WHEN m = 1 THEN k END) AS k1 FROM (
  SELECT b.vec_id, ccb.m, ccb.k, row_number() OVER (PARTITION BY b.vec_id, ccb.m ORDER BY round(sum((x - c) * (x - c)), 9), ccb.k) AS r
  FROM b JOIN ccb USING (i) GROUP BY b.vec_id, ccb.m, ccb.k) WHERE r = 1 GROUP BY vec_id)"""
CELLS = "cells AS (SELECT k0, k1, count(*) AS n FROM ccodes GROUP BY k0, k1)"
RANKED = """cadct AS (SELECT qid, m, k, round(sum(pow(abs(CAST(q AS DOUBLE) - c) / rg, 2)), 9) AS dist FROM q JOIN ccb USING (i) GROUP BY qid, m, k),
ranked AS (SELECT t0.qid, k0, k1, n, round(t0.dist + t1.dist, 9) AS dist,
  row_number() OVER (PARTITION BY t0.qid ORDER BY round(t0.dist + t1.dist, 9), k0, k1) AS place
  FROM cells JOIN cadct t0 ON t0.m = 0 AND t0.k = k0 JOIN cadct t1 ON t1.m = 1 AND t1.k = k1 AND t1.qid = t0.qid)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
