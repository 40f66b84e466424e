"""A training-corpus pipeline: quality rules, language identification, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.common import broadcast_if_small, delete, fresh_path, intermediate, stored, table
from boxloom.llm.decontamination import without_overlaps
from boxloom.llm.jaccard_join import jaccard_components
from boxloom.llm.language_id import predict, train
from boxloom.llm.quality_rules import quality_rules
from boxloom.llm.sentencepiece_codec import default_model, sentencepiece_decode, sentencepiece_encode

#: Texts whose best language scores lower are rejected; so are those in no language.
LEAST_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outliers of their language and source.  Rows are told apart by two
    hashes of all their columns, so that no text is stored; rows that agree in all columns are judged alike."""
    keys = {"__k1": F.xxhash64(*docs.columns), "__k2": F.hash(*docs.columns)}
    judged = quality_rules(docs.withColumns(keys), list(keys))
    rejected = broadcast_if_small(stored(judged.where("not kept").select(*keys).distinct(), "rejected"))
    return docs.withColumns(keys).join(rejected, list(keys), "left_anti").drop(*keys)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    return predict(docs, train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) exactly one row: that with the smallest id; of
    several texts with this id, or if no row of the group has an id, that with the smallest hash of id and text; of
    rows that agree in id and text any one.  Rows are told apart by this hash, so rows without an id and different texts
    under one id are judged each for itself.  Rows without words belong to no group and all stay."""
    rows = docs.withColumn("__row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    found = jaccard_components(rows, key="__row").where("n_shingles > 0").select("__row", F.col("component_id").alias("group")).distinct()
    named = rows.groupBy("__row").agg(F.first("doc_id").alias("id"), F.count("*").alias("times"))
    grouped = stored(found.join(named, "__row"), "near-duplicates")
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "__row", "times")).alias("first")).select("first.__row", "first.times")
    first = stored(first, "near-duplicates")
    others = broadcast_if_small(stored(grouped.select("__row").join(first, "__row", "left_anti"), "near-duplicates"))
    left = rows.join(others, "__row", "left_anti")
    repeated = first.where("times > 1").select("__row")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    repeated = broadcast_if_small(repeated)
    once = left.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
    return left.join(repeated, "__row", "left_anti").unionByName(once).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its SentencePiece ids; ``round_trip`` tells whether decoding gives the text back."""
    model = default_model()
    coded = sentencepiece_decode(sentencepiece_encode(docs, model), model)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_ids"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [("quality_rules", quality), ("language_id", language), ("jaccard_join", near_duplicates), ("decontamination", decontaminated), ("sentencepiece", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written; what it was made from is deleted then, so one copy of the corpus is kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with intermediate(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, [before])
        docs, before = spark.read.parquet(path), path
    return docs


#: Medians, kernels and encodings have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
