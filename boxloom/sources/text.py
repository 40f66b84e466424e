"""Text formats: id lists, numeric tables, vector lines and metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_id_lists(rows: DataFrame, path: str) -> None:
    """(qid, ids) as lines ``qid<TAB>id id ...``; an empty list leaves the part after the tab blank.  The id is explicit,
    so that the lines may stand in any part file."""
    rows.select(F.concat_ws("\t", F.col("qid").cast("string"), F.array_join(F.transform("ids", lambda v: v.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ids) of keyed lines."""
    at = F.split("value", "\t")
    return spark.read.text(path).select(at[0].cast("long").alias("qid"), ids_of(at[1]).alias("ids"))


def write_plain_id_lists(rows: DataFrame, path: str) -> None:
    """(qid, ids) as lines of ids in ascending order of qid, in one file, as the line number is the query: for query sets
    of a size for one task.  Larger ones are written with keys."""
    lines = rows.select("qid", F.array_join(F.transform("ids", lambda v: v.cast("string")), " ").alias("value"))
    lines.repartition(1).sortWithinPartitions("qid").select("value").write.mode("overwrite").text(path)


def read_plain_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ids) of a single file without keys, whose line number from 0 is the query."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("qid", "line"))
    return lines.select(F.col("qid").cast("long").alias("qid"), ids_of(F.col("line")).alias("ids"))


def ids_of(line: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.trim(line), " +"), ""), lambda v: v.cast("int"))


def ragged(queries: DataFrame, result: DataFrame) -> DataFrame:
    """(qid, ids) with sorted ids; queries without a result keep an empty list."""
    lists = result.groupBy("qid").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return queries.select("qid").join(lists, "qid", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def read_table(spark: SparkSession, path: str, columns: list[str], separator: str = ",", header: bool = False) -> DataFrame:
    """(columns) of a numeric table as doubles, with a schema and so without a pass to infer one."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    return spark.read.csv(path, schema=schema, sep=separator, header=header, ignoreLeadingWhiteSpace=True)


def vectors_of(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return rows.select(F.col(key).alias("vec_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def write_range_export(rows: DataFrame, path: str) -> None:
    """Lines ``v:v:...:(id)`` of (vec_id, x) for an external index."""
    rows.select(F.concat(F.array_join(F.transform("x", lambda v: v.cast("string")), ":"), F.lit(":("), F.col("vec_id").cast("string"), F.lit(")")).alias("value")).write.mode("overwrite").text(path)


def read_metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, name, value): the numbers of tab-separated metric lines, named by the header line before them."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    cells = F.transform(F.split("value", "\t"), lambda v: F.trim(v))
    numeric = F.forall(cells, lambda v: v.rlike(r"^[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?$"))
    parsed = lines.select("file", "line", cells.alias("cells"), numeric.alias("numeric"))
    header = F.last(F.when(~F.col("numeric") & (F.size("cells") > 1), F.col("cells")), ignorenulls=True).over(Window.partitionBy("file").orderBy("line"))
    named = parsed.withColumn("header", header).where("numeric and header is not null")
    return named.select("file", "line", F.explode(F.arrays_zip(F.col("header").alias("name"), F.col("cells").alias("value"))).alias("c")).select("file", "line", "c.name", F.col("c.value").cast("double").alias("value"))


def faster_than(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Settings in which ``one`` took less time than ``other``; both have ``keys`` and ``time``."""
    return one.withColumnRenamed("time", "time_one").join(other.withColumnRenamed("time", "time_other"), keys).where("time_one < time_other")
