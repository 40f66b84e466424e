"""Queries of file formats, prepared datasets and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import maintenance as MT
from ..operators import workload as W
from ..sources import models as MO
from ..sources import text as TX
from ..sources import vecs as VS
from ..sources.shared import shared_path
from .fixtures import B, HITS, Q, D, base, queries, query, with_


def long(rows):
    out = rows.select("vec_id", F.posexplode("x").alias("i", "v"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), "v")


def round_trip(spark, rows, kind):
    path = shared_path(spark, kind)
    VS.write(rows, path, kind)
    return long(VS.read(spark, path, kind, D))


@query("scan_fvecs", with_(B) + "SELECT vec_id, i, round(CAST(x AS DOUBLE), 6) AS v FROM b")
def scan_fvecs(spark, sf):
    return round_trip(spark, base(spark, sf), "fvecs").withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("scan_ivecs", with_(B) + "SELECT vec_id, i, CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS v FROM b")
def scan_ivecs(spark, sf):
    rows = base(spark, sf).withColumn("x", F.transform("x", lambda v: F.floor(v.cast("double") * 1000).cast("int")))
    return round_trip(spark, rows, "ivecs").withColumn("v", F.col("v").cast("long"))


@query("scan_bvecs", with_(B) + "SELECT vec_id, i, CAST(floor((CAST(x AS DOUBLE) + 1) * 100) AS BIGINT) AS v FROM b")
def scan_bvecs(spark, sf):
    rows = base(spark, sf).withColumn("x", F.transform("x", lambda v: F.floor((v.cast("double") + 1) * 100).cast("int")))
    return round_trip(spark, rows, "bvecs").withColumn("v", F.col("v").cast("long"))


@query("scan_idlist", with_(B, Q, HITS) + "SELECT qid, vec_id FROM (SELECT DISTINCT qid FROM q) LEFT JOIN hits USING (qid)")
def scan_idlist(spark, sf):
    q, path = queries(spark, sf), shared_path(spark, "idlist")
    TX.write_id_lists(TX.ragged(q, J.interval_search(base(spark, sf), q, D)), path)
    return TX.read_id_lists(spark, path).select("qid", F.explode_outer(F.col("ids").cast("array<bigint>")).alias("vec_id"))


@query("scan_plain_idlist", with_(B, Q, HITS, "o AS (SELECT qid, CAST(row_number() OVER (ORDER BY qid) - 1 AS BIGINT) AS line FROM (SELECT DISTINCT qid FROM q))") + "SELECT line, vec_id FROM o LEFT JOIN hits USING (qid)")
def scan_plain_idlist(spark, sf):
    """Lines without keys, in the order of the queries."""
    q, path = queries(spark, sf), shared_path(spark, "idlist")
    TX.write_plain_id_lists(TX.ragged(q, J.interval_search(base(spark, sf), q, D)), path)
    return TX.read_plain_id_lists(spark, path).select(F.col("qid").alias("line"), F.explode_outer(F.col("ids").cast("array<bigint>")).alias("vec_id"))


@query("truth_load", with_(B, Q, HITS) + "SELECT * FROM hits")
def truth_load(spark, sf):
    """Stored truth: computed by the first call, read by the second, which must not compute."""
    q, path = queries(spark, sf), shared_path(spark, "truth")
    MO.truth(spark, path, lambda: TX.ragged(q, J.interval_search(base(spark, sf), q, D)))

    def never():
        raise AssertionError("the truth is there")

    return MO.truth(spark, path, never).select("qid", F.explode(F.col("ids").cast("array<bigint>")).alias("vec_id"))


@query("range_export", with_(B) + "SELECT vec_id, i, round(CAST(x AS DOUBLE), 6) AS v FROM b")
def range_export(spark, sf):
    path = shared_path(spark, "rcd")
    TX.write_range_export(base(spark, sf), path)
    at = F.split(F.regexp_extract("value", r"^(.*):\(\d+\)$", 1), ":")
    rows = spark.read.text(path).select(F.regexp_extract("value", r"\((\d+)\)$", 1).cast("long").alias("vec_id"), F.transform(at, lambda v: v.cast("float")).alias("x"))
    return long(rows).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query(
    "dataset_prepare",
    """WITH r AS (SELECT c_custkey, c_acctbal, c_nationkey, n_regionkey, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS r FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey AS vec_id, CASE WHEN r <= 100 THEN 'query' ELSE 'base' END AS part, CAST(c_nationkey AS DOUBLE) AS x0, CAST(c_acctbal AS DOUBLE) AS x1, CAST(n_regionkey AS DOUBLE) AS x2 FROM r""",
)
def dataset_prepare(spark, sf):
    """A table joined with its metadata, its numeric columns as vectors, and a seeded hold-out of queries."""
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    joined = read("customer").join(read("nation").withColumnRenamed("n_nationkey", "c_nationkey").select("c_nationkey", "n_regionkey"), "c_nationkey", "left")
    chosen, rest = W.hold_out(joined.select("c_custkey", "c_nationkey", "c_acctbal", "n_regionkey"), 100, "c_custkey")
    rows = chosen.withColumn("part", F.lit("query")).unionByName(rest.withColumn("part", F.lit("base")))
    vectors = rows.select("part", F.col("c_custkey").alias("vec_id"), F.array(*[F.col(c).cast("double") for c in ("c_nationkey", "c_acctbal", "n_regionkey")]).alias("x"))
    return vectors.select("vec_id", "part", *[F.col("x")[k].alias(f"x{k}") for k in range(3)])


@query("low_dim_box", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_quantity - 25) <= 5 AND abs(l_extendedprice - 30000) <= 4000 AND abs(l_discount - 0.05) <= 0.02 AND abs(l_tax - 0.04) <= 0.02")
def low_dim_box(spark, sf):
    """A box over scalar columns: plain ranges reach the parquet scan, the exact difference form decides."""
    box = {"l_quantity": (25, 5), "l_extendedprice": (30000, 4000), "l_discount": (0.05, 0.02), "l_tax": (0.04, 0.02)}
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    for c, (q, w) in box.items():
        slack = 1e-6 * (abs(q) + w)
        rows = rows.where(F.col(c).between(q - w - slack, q + w + slack)).where(F.abs(F.col(c) - q) <= w)
    return rows.select("l_orderkey", "l_linenumber")


def new_rows(rows):
    """Rows to insert: those with odd labels, under new ids."""
    return rows.where(F.col("vec_id") % 7 == 3).withColumn("vec_id", F.col("vec_id") + 1_000_000)


@query("kd_insert", with_(B) + "SELECT vec_id, i, round(CAST(x AS DOUBLE), 6) AS v FROM (SELECT * FROM b UNION ALL SELECT vec_id + 1000000, i, x FROM b WHERE vec_id % 7 = 3)")
def kd_insert(spark, sf):
    b = base(spark, sf)
    return long(MT.insert(b, new_rows(b))).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("kd_delete", "SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 3")
def kd_delete(spark, sf):
    b = base(spark, sf)
    return MT.delete(b, b.where(F.col("vec_id") % 7 == 3)).select("vec_id")


@query("kd_find_min", with_(B) + "SELECT i, vec_id, round(CAST(x AS DOUBLE), 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY x, vec_id) AS r FROM b) WHERE r = 1")
def kd_find_min(spark, sf):
    return MT.find_min(base(spark, sf), D).select(F.col("i").cast("long").alias("i"), "vec_id", F.round(F.col("v").cast("double"), 6).alias("v"))
