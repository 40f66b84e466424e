"""Sharding by jump consistent hashing: a stable key and the number of shards decide a row's shard, without a ring
table; appending a shard moves rows only into the new one.

The key is ``doc_id``; a row without one is keyed by the CRC of its text, so that such rows spread too.  Slots number
the rows of a shard from 0 without gaps.  They are dealt in two levels, so that no task orders a whole shard: rows fall
into ``blocks`` by the MD5 of their key, CRC and size, a row's slot is its place in (shard, block) plus the rows in the shard's
blocks before.  Only the block counts, one row for each shard and block, are ordered by shard.  Rows that agree in all three are
counted first and get a run of slots, which several tasks write if it is long, so neither a key with many texts nor many
equal rows are gathered in one task.

Defined results: a null text has size 1 and the CRC of no bytes (0); a text of any length is hashed whole; repeated rows get slots of their own, in any order (ties); an empty
table gives an empty result; other columns do not matter and are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 16
BLOCK_DIGITS = 3  # hexadecimal digits of the block: 4,096 blocks in each shard
#: Slots of equal rows that one task writes.
RUN = 100_000
#: Multiplier of the 64-bit linear congruential generator of jump consistent hashing (fixed value).
JUMP_MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys jumping in step."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    while len(active):
        state[active] = state[active] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        ahead = (shard[active] + 1) * (2.0**31 / ((state[active] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        on = ahead < shards
        active = active[on]
        shard[active] = ahead[on].astype(np.int64)
    return shard


def jump_shard(key, shards: int):
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(key)


def shard_documents(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, shard, slot, grown_shard."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias(key), (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))
    rows = stored(rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("times")), "equal-rows")
    by = F.coalesce(F.col(key), F.col("text_crc32"))
    block = F.substring(F.md5(F.concat_ws(" ", by, "text_crc32", "size").cast("binary")), 1, BLOCK_DIGITS)
    rows = rows.withColumns({"shard": jump_shard(by, shards), "grown_shard": jump_shard(by, shards + 1), "block": block})
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "block").agg(F.sum("times").alias("n"))
    # one row per shard and block, whatever the input: at most (shards * 16 ** BLOCK_DIGITS) rows
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = Window.partitionBy("shard", "block").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumn("place", F.coalesce(F.sum("times").over(place), F.lit(0))).join(F.broadcast(offsets), ["shard", "block"])
    dealt = dealt.select(key, "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).alias("first"), "grown_shard", "times")
    run = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    if not rows.where(F.col("times") > RUN).isEmpty():
        runs = dealt.withColumn("at", F.explode(run(F.ceil(F.col("times") / RUN)))).repartition(key, "text_crc32", "size", "at")
        start = F.col("at") * RUN
        dealt = runs.withColumns({"first": F.col("first") + start, "times": F.least(F.lit(RUN), F.col("times") - start)}).drop("at")
    return dealt.withColumn("copy", F.explode(run(F.col("times")))).select(key, "size", "text_crc32", "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard")


def op3_sharding(spark, sf_dir) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The jump law by recursion in whole numbers of 128 bits, the CRC byte by byte, slots by the order of blocks.
OP3_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(0, 256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
hashed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
             lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
keyed AS (SELECT *, coalesce(doc_id, text_crc32) AS base, row_number() OVER () AS row FROM hashed),
jump(row, n, state, b, j) AS (
  SELECT row, n, CASE WHEN base < 0 THEN CAST(base AS HUGEINT) + 18446744073709551616 ELSE CAST(base AS HUGEINT) END, CAST(-1 AS BIGINT), CAST(0 AS BIGINT)
  FROM keyed, (VALUES (16), (17)) s(n)
  UNION ALL
  SELECT row, n, next, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT row, n, j, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jump WHERE j < n)),
ends AS (SELECT row, max(b) FILTER (n = 16 AND j >= n) AS shard, max(b) FILTER (n = 17 AND j >= n) AS grown FROM jump GROUP BY row),
placed AS (SELECT k.*, e.shard, e.grown, substr(md5(base || ' ' || text_crc32 || ' ' || size), 1, 3) AS block FROM keyed k JOIN ends e ON k.row = e.row)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM placed
"""
