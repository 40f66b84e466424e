"""Evaluation of result sets (qid, vec_id) against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(queries: DataFrame, result: DataFrame, name: str) -> DataFrame:
    """(qid, name): result size of every query, 0 included."""
    counts = result.groupBy("qid").agg(F.count("*").alias(name))
    return queries.select("qid").join(counts, "qid", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def recall_precision(queries: DataFrame, truth: DataFrame, hits: DataFrame, probed: DataFrame) -> DataFrame:
    """One row: mean and overall recall and precision, and mean probed, over queries with a true result.  ``probed``:
    (qid, probed).  A query that probed nothing has no precision and is left out of its mean."""
    rows = sizes(queries, truth, "true_size").join(sizes(queries, hits, "hits"), "qid").join(probed, "qid", "left").withColumn("probed", F.coalesce("probed", F.lit(0))).where("true_size > 0")
    share = F.when(F.col("probed") > 0, F.col("hits") / F.col("probed"))
    return rows.agg(
        F.avg(F.col("hits") / F.col("true_size")).alias("recall"),
        F.avg(share).alias("precision"),
        (F.sum("hits") / F.sum("true_size")).alias("overall_recall"),
        F.when(F.sum("probed") > 0, F.sum("hits") / F.sum("probed")).alias("overall_precision"),
        F.avg("probed").alias("mean_probed"),
    )


def truth_summary(queries: DataFrame, truth: DataFrame) -> DataFrame:
    rows = sizes(queries, truth, "n")
    return rows.agg(F.avg("n").alias("mean_size"), F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("mean_nonempty_size"), F.count(F.when(F.col("n") > 0, 1)).alias("nonempty"))
