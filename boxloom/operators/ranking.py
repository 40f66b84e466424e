"""Rankings per query and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Largest table, in rows, that is sent whole to every executor.
MOST_SENT = 1_000_000


def rank_all(rows: DataFrame, by: str, group: str = "qid", tie: str = "vec_id", buckets_per_unit: float = 16.0) -> DataFrame:
    """``rows`` with ``rank`` from 1 in each group, ascending by ``by``, ties by ``tie``.

    The rank is the place in a bucket of ``by`` plus the rows of the buckets before, so no task orders a whole group."""
    placed = rows.withColumn("__bucket", F.floor(F.col(by) * buckets_per_unit))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    starts = sizes.select(F.col(group), "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(by, tie))
    return placed.withColumn("__place", place).join(starts, [group, "__bucket"]).withColumn("rank", F.col("__start") + F.col("__place")).drop("__bucket", "__place", "__start")


def top_k(rows: DataFrame, by: str, k: int, group: str = "qid", tie: str = "vec_id") -> DataFrame:
    """The ``k`` first rows of each group with their rank; each task keeps at most ``k`` rows of a group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(by, tie))).where(F.col("rank") <= k)


def recall_at(ranked: DataFrame, truth: DataFrame, items: int) -> DataFrame:
    """(t, recall, precision) for t = 1, 2, 4 ... of ranked (qid, vec_id, rank), over queries that have a true result.
    The last t exceeds the number of items and is clipped to it."""
    steps = [2**i for i in range(items.bit_length() + 1)]
    sizes = truth.groupBy("qid").agg(F.count("*").alias("true_size"))
    hits = ranked.join(truth, ["qid", "vec_id"]).select("qid", "rank")
    t = F.explode(F.array(*[F.lit(x).cast("long") for x in steps]))
    found = hits.select("qid", "rank", t.alias("t")).where("rank <= t").groupBy("qid", "t").agg(F.count("*").alias("hits"))
    all_steps = sizes.select("qid", "true_size", t.alias("t")).join(found, ["qid", "t"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return all_steps.groupBy("t").agg(F.avg(F.col("hits") / F.col("true_size")).alias("recall"), F.avg(F.col("hits") / F.least(F.col("t"), F.lit(items))).alias("precision"))


def recall_of_scored(scored: DataFrame, items: int, tie: str = "vec_id", buckets_per_unit: float = 16.0) -> DataFrame:
    """:func:`recall_at` of all pairs (qid, vec_id, dist, hit), which are read twice and never ranked as a whole.

    Rows and hits are counted by buckets of ``dist``.  Only in the buckets in which a step t of a query falls, and only
    if they hold a hit, are rows put in order."""
    steps = [2**i for i in range(items.bit_length() + 1)]
    t = F.explode(F.array(*[F.lit(x).cast("long") for x in steps]))
    placed = scored.withColumn("bucket", F.floor(F.col("dist") * buckets_per_unit))
    sizes = stored(placed.groupBy("qid", "bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("hits")), "buckets")
    wanted = sizes.groupBy("qid").agg(F.sum("hits").alias("true_size")).where("true_size > 0").select("qid", "true_size", t.alias("t"))
    before = lambda c: running_before(F.col(c), "qid", ["bucket"])
    starts = sizes.select("qid", "bucket", "n", "hits", before("n").alias("start"), before("hits").alias("hits_before"))
    steps_in = starts.select("*", t.alias("t")).where("start < t AND t <= start + n")
    cut = steps_in.where("t < start + n AND hits > 0").select("qid", "bucket", "start", "t")
    buckets = cut.select("qid", "bucket", "start").distinct()
    buckets = F.broadcast(buckets) if sizes.select("qid").distinct().count() * len(steps) <= MOST_SENT else buckets
    place = F.row_number().over(Window.partitionBy("qid", "bucket").orderBy("dist", tie))
    held = placed.join(buckets, ["qid", "bucket"]).select("qid", "bucket", "hit", (F.col("start") + place).alias("rank")).where("hit")
    found = held.join(cut.drop("start"), ["qid", "bucket"]).where("rank <= t").groupBy("qid", "t").agg(F.count("*").alias("within"))
    rows = wanted.join(steps_in.drop("bucket"), ["qid", "t"], "left").join(found, ["qid", "t"], "left")
    counted = F.col("hits_before") + F.when(F.col("t") == F.col("start") + F.col("n"), F.col("hits")).otherwise(F.coalesce("within", F.lit(0)))
    h = F.coalesce(counted, F.col("true_size"))  # beyond the last row a query has all its hits
    return rows.groupBy("t").agg(F.avg(h / F.col("true_size")).alias("recall"), F.avg(h / F.least(F.col("t"), F.lit(items))).alias("precision"))


def running_before(value: Column, group: str, order: list) -> Column:
    """Sum of ``value`` over the rows before, in a total order."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))
