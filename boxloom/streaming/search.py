"""Box search over a stream of vectors: stateless, so each micro-batch is filtered against the static queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import in_box
from ..operators.joins import theta_join

SCHEMA = "vec_id long, embedding array<float>, label int"


def stream_interval_search(stream: DataFrame, queries: DataFrame, d: int) -> DataFrame:
    """(qid, vec_id) of arriving vectors (vec_id, x) in the boxes of the queries, which are sent in blocks of at most
    ``BROADCAST_QUERIES`` however many there are; the stream is filtered by each."""
    return theta_join(stream, queries, lambda: in_box(F.col("x"), F.col("q"), F.col("rg"), d)).select("qid", "vec_id")


def run_to_end(found: DataFrame, path: str) -> DataFrame:
    """Writes what the stream has now to ``path`` and reads it; exactly once by the file sink's log."""
    query = found.writeStream.format("parquet").option("checkpointLocation", path + "-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(path)


def vectors(spark: SparkSession, folder: str, name: str = "embeddings.parquet") -> DataFrame:
    rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}")
    return rows.select("vec_id", F.col("embedding").alias("x"))
