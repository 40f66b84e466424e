"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Largest table, in rows, that is sent whole to every executor.
BROADCAST_ROWS = 1_000_000
#: Rows from which on a key is hot: its rows are joined where they are, not gathered by key.
HOT_ROWS = 1_000
#: Rows of texts in an Arrow batch.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.  Only where a session on a single
    machine (tests) has none is a temporary one set; on a cluster a missing one is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="boxloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Folders written within each open ``intermediate`` block.
_written: list[list[str]] = []


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there, so a lost executor costs no
    recomputation of what lies before."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """Tables stored in the block are deleted when it ends; what is needed afterwards must be stored after it or by
    ``kept`` within it."""
    _written.append([])
    try:
        yield
    finally:
        delete(spark, _written.pop())


def kept(df: DataFrame, tag: str) -> DataFrame:
    """As ``stored``, in the surrounding ``intermediate`` block, if there is one, instead of the innermost."""
    inner = _written.pop() if _written else None
    try:
        return stored(df, tag)
    finally:
        if inner is not None:
            _written.append(inner)


def bound_batches(spark: SparkSession) -> None:
    """Rows of texts go to Python in batches of at most ``BATCH_ROWS``: with the default of 10,000 a batch, held by the
    executor and by each worker of a task, takes a large part of their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over: it does so once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a count; beyond the bound the table stays as it is and the join shuffles."""
    return F.broadcast(df) if is_small(df, rows) else df


def hot_keys(sizes: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys of ``sizes`` (key, size) with more than ``rows`` rows, or None if there are none, or so many that the
    rows are dealt well by key."""
    hot = stored(sizes.where(F.col("size") > rows).select(key), "hot-keys")
    return hot if 0 < hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None


def join_hot(rows: DataFrame, info: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``info``, a row per key ("inner", "left" or "left_semi").  The entries of hot keys are sent to
    the rows, whose tasks keep them; the rest is joined by key.  Rows without a key are not gathered either."""
    parts = [] if hot is None else [rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(info.join(F.broadcast(hot), key, "left_semi")), key, how)]
    cold = rows if hot is None else rows.join(F.broadcast(hot), key, "left_anti")
    if how == "left":
        parts.append(cold.where(F.col(key).isNull()).join(F.broadcast(info.limit(0)), key, "left"))
    parts.append(cold.where(F.col(key).isNotNull()).join(info, key, how))
    return reduce(DataFrame.unionByName, parts)


def join_with_hot_keys(rows: DataFrame, info: DataFrame, key: str, sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """The same where hot keys are yet to be found and ``info`` may hold several rows of a key."""
    hot = hot_keys(rows.groupBy(key).agg(F.count("*").alias("size")) if sizes is None else sizes, key)
    if hot is not None and not is_small(info.join(F.broadcast(hot), key, "left_semi")):
        hot = None
    return join_hot(rows, info, key, hot, how)


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def words(column):
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(column, F.lit("")), SPACE_CLASS + "+"), "")
