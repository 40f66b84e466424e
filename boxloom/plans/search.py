"""Queries of box joins, distances, rankings and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance as DI
from ..functions import predicates as P
from ..functions.vectors import dims
from ..operators import blocks as BL
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import pairs as X
from ..operators import ranking as R
from ..sources.shared import shared_path
from ..streaming import search as S
from .fixtures import ACTIVE_SQL as ACTIVE
from .fixtures import B, HITS, Q, Q_HALF, D, base, boxes, queries, query, with_, with_dims

DIST = "dist AS (SELECT qid, vec_id, round(sum(pow(abs(CAST(x AS DOUBLE) - CAST(q AS DOUBLE)) / rg, 2)), 9) AS dist FROM b JOIN q USING (i) GROUP BY qid, vec_id)"
BOXED = "bw AS (SELECT vec_id, i, x, CAST((30 + (vec_id * 5 + i) % 13) / 100.0 AS FLOAT) AS w FROM b)"
TRUE_SIZES = "sizes AS (SELECT qid, count(vec_id) AS n FROM (SELECT DISTINCT qid FROM q) LEFT JOIN hits USING (qid) GROUP BY qid)"
PREFIX = "prefix AS (SELECT qid, vec_id FROM b JOIN q USING (i) WHERE i < 8 GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= rg))"


def pairs(b, q):
    return J.theta_join(b, q, lambda: F.lit(True))


def weighted(spark, sf):
    dist = F.round(DI.weighted_dense(F.col("x"), F.col("q"), F.col("rg"), 2, D), 9)
    return pairs(base(spark, sf), queries(spark, sf)).select("qid", "vec_id", dist.alias("dist"))


@query("interval_search", with_(B, Q, HITS) + "SELECT * FROM hits")
def interval_search(spark, sf):
    return J.interval_search(base(spark, sf), queries(spark, sf), D)


@query("grid_search", with_(B, Q, HITS) + "SELECT * FROM hits")
def grid_search(spark, sf):
    return J.grid_search(base(spark, sf), queries(spark, sf), [0, 1, 2], 0.42, D)


@query("stream_interval_search", with_(B, Q, HITS) + "SELECT * FROM hits")
def stream_interval_search(spark, sf):
    found = S.stream_interval_search(S.vectors(spark, sf), queries(spark, sf), D)
    return S.run_to_end(found, shared_path(spark, "stream"))


@query("interval_point", with_(B, Q) + "SELECT qid, vec_id, bool_and(abs(x - q) <= rg) AS inside FROM b JOIN q USING (i) GROUP BY qid, vec_id")
def interval_point(spark, sf):
    inside = P.in_box(F.col("x"), F.col("q"), F.col("rg"), D)
    return pairs(base(spark, sf), queries(spark, sf)).select("qid", "vec_id", inside.alias("inside"))


@query("interval_stab", with_(B, Q, BOXED) + "SELECT qid, vec_id FROM bw JOIN q USING (i) GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= w)")
def interval_stab(spark, sf):
    return J.interval_stab(boxes(spark, sf), queries(spark, sf), D)


@query(
    "interval_overlap",
    with_(B, Q, BOXED.replace("AS FLOAT)", "AS FLOAT) * CAST(0.25 AS FLOAT)")) + "SELECT qid, vec_id FROM bw JOIN q USING (i) GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= w + rg)",
)
def interval_overlap(spark, sf):
    return J.overlap_search(boxes(spark, sf, 0.25).withColumnRenamed("rg", "xw"), queries(spark, sf), D)


SCALED = "SELECT qid, vec_id FROM b JOIN q USING (i) GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= CAST(1.25 AS FLOAT) * rg)"


@query("interval_scaled", with_(B, Q) + SCALED)
def interval_scaled(spark, sf):
    return J.scaled_search(base(spark, sf), queries(spark, sf), 1.25, D)


@query("range_count", with_(B, Q, f"s AS ({SCALED})") + "SELECT qid, count(*) AS n FROM s GROUP BY qid")
def range_count(spark, sf):
    return interval_scaled(spark, sf).groupBy("qid").agg(F.count("*").alias("n"))


SPARSE = f"SELECT qid, vec_id FROM b JOIN q USING (i) WHERE {ACTIVE} GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= rg)"


@query("sparse_interval_search", with_(B, Q_HALF) + SPARSE)
def sparse_interval_search(spark, sf):
    return J.sparse_search(base(spark, sf), with_dims(queries(spark, sf, 0.5)))


@query("sparse_interval", with_(B, Q_HALF) + f"SELECT qid, vec_id, bool_and(abs(x - q) <= rg) AS inside FROM b JOIN q USING (i) WHERE {ACTIVE} GROUP BY qid, vec_id")
def sparse_interval(spark, sf):
    inside = P.in_sparse_box(F.col("x"), F.col("q"), F.col("rg"), F.col("dims"))
    return pairs(base(spark, sf), with_dims(queries(spark, sf, 0.5))).select("qid", "vec_id", inside.alias("inside"))


@query(
    "sparse_interval_stab",
    with_(B, Q, BOXED.replace("AS FLOAT)", "AS FLOAT) * CAST(0.5 AS FLOAT)")) + f"SELECT qid, vec_id FROM bw JOIN q USING (i) WHERE {ACTIVE} GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= w)",
)
def sparse_interval_stab(spark, sf):
    return J.sparse_search(boxes(spark, sf, 0.5), with_dims(queries(spark, sf)))


@query(
    "brute_force",
    with_(B, Q, HITS, TRUE_SIZES) + "SELECT qid, n AS hits, (SELECT count(*) FROM embeddings) AS probed FROM sizes",
)
def brute_force(spark, sf):
    return J.brute_force(base(spark, sf), queries(spark, sf), D)


@query("cube_search", with_(B, Q) + "SELECT qid, vec_id FROM b JOIN q USING (i) GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= CAST(0.36 AS FLOAT))")
def cube_search(spark, sf):
    return J.cube_search(base(spark, sf), queries(spark, sf), 0.36, D)


@query("prefix_range", with_(B, Q_HALF, PREFIX) + "SELECT * FROM prefix")
def prefix_range(spark, sf):
    return J.prefix_search(base(spark, sf), queries(spark, sf, 0.5), 8)


@query("prefix_filter_refine", with_(B, Q, HITS) + "SELECT * FROM hits")
def prefix_filter_refine(spark, sf):
    return J.prefix_filter_refine(base(spark, sf), queries(spark, sf), 8, D)


KD_LEVELS, KD_AXES = 4, 3


def kd_sql():
    """Rows with the node of each level; the cut is the lower median along the level's axis."""
    parts = ["n0 AS (SELECT DISTINCT vec_id, 1 AS node FROM b)"]
    for level in range(KD_LEVELS):
        parts.append(f"v{level} AS (SELECT n{level}.vec_id, node, CAST(x AS DOUBLE) AS x FROM n{level} JOIN b ON b.vec_id = n{level}.vec_id AND b.i = {level % KD_AXES})")
        parts.append(f"n{level + 1} AS (SELECT vec_id, 2 * node + CASE WHEN x >= cut THEN 1 ELSE 0 END AS node FROM v{level} JOIN (SELECT node, quantile_disc(x, 0.5) AS cut FROM v{level} GROUP BY node) USING (node))")
    return [*parts, f"leaf AS (SELECT vec_id, node - {2**KD_LEVELS} AS block FROM n{KD_LEVELS})"]


BOUNDS = "SELECT block, count(DISTINCT vec_id) AS n, i, round(CAST(min(x) AS DOUBLE), 6) AS lo, round(CAST(max(x) AS DOUBLE), 6) AS hi FROM {rows} GROUP BY block, i"


def layout(spark, sf):
    b = base(spark, sf)
    return BL.laid_out(b, BL.kd_tree(b, KD_LEVELS, KD_AXES))


def long_bounds(boxes):
    rows = boxes.select("block", "n", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "s"))
    return rows.select(F.col("block").cast("long").alias("block"), "n", F.col("i").cast("long").alias("i"), *[F.round(F.col(f"s.{c}").cast("double"), 6).alias(c) for c in ("lo", "hi")])


@query("kd_build", with_(B, *kd_sql()) + "SELECT vec_id, CAST(block AS BIGINT) AS block FROM leaf")
def kd_build(spark, sf):
    return layout(spark, sf).select("vec_id", F.col("block").cast("long").alias("block"))


@query("kd_traverse", with_(B, *kd_sql()) + BOUNDS.format(rows="leaf JOIN b USING (vec_id)"))
def kd_traverse(spark, sf):
    """The leaves of the tree with their boxes."""
    return long_bounds(BL.bounds(layout(spark, sf), D))


@query("kd_range_search", with_(B, Q_HALF, "hits AS (SELECT qid, vec_id FROM b JOIN q USING (i) GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= rg))") + "SELECT * FROM hits")
def kd_range_search(spark, sf):
    rows = layout(spark, sf)
    return BL.block_search(rows, BL.bounds(rows, D), queries(spark, sf, 0.5), D)


@query("rtree_filter_refine", with_(B, Q, HITS) + "SELECT * FROM hits")
def rtree_filter_refine(spark, sf):
    """Blocks by the first eight dimensions, rows by all."""
    rows = layout(spark, sf)
    return BL.block_search(rows, BL.bounds(rows, D), queries(spark, sf), D, 8)


@query(
    "rtree_insert",
    with_(B, *kd_sql(), "more AS (SELECT block, vec_id, i, x FROM leaf JOIN b USING (vec_id) UNION ALL SELECT block, vec_id + 1000000, i, CAST(x * CAST(1.5 AS FLOAT) AS FLOAT) FROM leaf JOIN b USING (vec_id) WHERE vec_id % 7 = 3)") + BOUNDS.format(rows="more"),
)
def rtree_insert(spark, sf):
    """Boxes after an insertion: each new row goes to the block of the row that it is made from, whose box grows."""
    rows = layout(spark, sf)
    new = rows.where("vec_id % 7 = 3").withColumns({"vec_id": F.col("vec_id") + 1_000_000, "x": F.transform("x", lambda v: (v * F.lit(1.5).cast("float")).cast("float"))})
    return long_bounds(BL.extended(BL.bounds(rows, D), new, D))


@query("weighted_dist", with_(B, Q, DIST) + "SELECT qid, vec_id, round(dist, 6) AS dist FROM dist")
def weighted_dist(spark, sf):
    return weighted(spark, sf).withColumn("dist", F.round("dist", 6))


@query(
    "weighted_dist_interval",
    with_(B, Q, BOXED) + "SELECT qid, vec_id, round(sum(pow(abs(CAST(x AS DOUBLE) - CAST(q AS DOUBLE)) / w, 4)), 6) AS dist FROM bw JOIN q USING (i) GROUP BY qid, vec_id",
)
def weighted_dist_interval(spark, sf):
    dist = F.round(DI.weighted_dense(F.col("x"), F.col("q"), F.col("rg"), 4, D), 6)
    return pairs(boxes(spark, sf), queries(spark, sf).drop("rg")).select("qid", "vec_id", dist.alias("dist"))


@query(
    "sparse_weighted_dist",
    with_(B, Q) + f"SELECT qid, vec_id, round(sum(pow(abs(CAST(x AS DOUBLE) - CAST(q AS DOUBLE)) / rg, 2)), 6) AS dist FROM b JOIN q USING (i) WHERE {ACTIVE} GROUP BY qid, vec_id",
)
def sparse_weighted_dist(spark, sf):
    dist = F.round(DI.weighted(F.col("x"), F.col("q"), F.col("rg"), 2, F.col("dims")), 6)
    return pairs(base(spark, sf), with_dims(queries(spark, sf))).select("qid", "vec_id", dist.alias("dist"))


@query("l2_dist", with_(B, Q) + "SELECT qid, vec_id, round(sqrt(sum(pow(CAST(x AS DOUBLE) - CAST(q AS DOUBLE), 2))), 6) AS dist FROM b JOIN q USING (i) GROUP BY qid, vec_id")
def l2_dist(spark, sf):
    return pairs(base(spark, sf), queries(spark, sf)).select("qid", "vec_id", F.round(DI.l2(F.col("x"), F.col("q")), 6).alias("dist"))


@query("violation_count", with_(B, Q_HALF) + "SELECT qid, vec_id, count(CASE WHEN abs(x - q) > rg THEN 1 END) AS violated FROM b JOIN q USING (i) GROUP BY qid, vec_id")
def violation_count(spark, sf):
    violated = P.violations(F.col("x"), F.col("q"), F.col("rg"), D).cast("long")
    return pairs(base(spark, sf), queries(spark, sf, 0.5)).select("qid", "vec_id", violated.alias("violated"))


ORDERED = "SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM dist"


@query("rank_by_dist", with_(B, Q, DIST) + ORDERED)
def rank_by_dist(spark, sf):
    return R.rank_all(weighted(spark, sf), "dist").select("qid", "vec_id", "rank")


@query("topk", with_(B, Q, DIST, f"o AS ({ORDERED})") + "SELECT qid, vec_id, rank FROM o WHERE rank <= 10")
def topk(spark, sf):
    return R.top_k(weighted(spark, sf), "dist", 10).select("qid", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("argsort", with_(B, Q) + "SELECT qid, i, row_number() OVER (PARTITION BY qid ORDER BY q, i) AS place FROM q")
def argsort(spark, sf):
    order = F.sort_array(F.transform(dims(D), lambda i: F.struct(F.col("q")[i].alias("v"), i.cast("long").alias("i"))))
    rows = queries(spark, sf).select("qid", F.posexplode(order).alias("place", "e"))
    return rows.select("qid", "e.i", (F.col("place") + 1).cast("long").alias("place"))


@query(
    "recall_at_t",
    with_(B, Q, HITS, DIST, f"o AS ({ORDERED})", "n AS (SELECT count(*) AS n FROM embeddings)", "t AS (SELECT CAST(pow(2, e) AS BIGINT) AS t FROM (SELECT unnest(range(0, 40)) AS e), n WHERE e <= floor(log2(n)) + 1)", "s AS (SELECT qid, count(*) AS size FROM hits GROUP BY qid)")
    + """SELECT t, round(avg(h / size), 9) AS recall, round(avg(h / least(t, (SELECT n FROM n))), 9) AS precision FROM (
  SELECT s.qid, t, size, CAST(count(CASE WHEN rank <= t THEN 1 END) AS DOUBLE) AS h FROM s JOIN t ON true JOIN (SELECT hits.qid, rank FROM hits JOIN o ON hits.qid = o.qid AND hits.vec_id = o.vec_id) r ON r.qid = s.qid GROUP BY s.qid, t, size) GROUP BY t""",
)
def recall_at_t(spark, sf):
    b = base(spark, sf)
    out = R.recall_of_scored(X.scored(b, queries(spark, sf), D), b.count())
    return out.select("t", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query(
    "recall_precision",
    with_(B, Q, HITS, TRUE_SIZES, PREFIX, "p AS (SELECT qid, count(*) AS probed FROM prefix GROUP BY qid)", "r AS (SELECT n, coalesce(probed, 0) AS probed FROM sizes LEFT JOIN p USING (qid) WHERE n > 0)")
    + """SELECT 1.0::DOUBLE AS recall, round(avg(CASE WHEN probed > 0 THEN n / probed END), 9) AS precision, 1.0::DOUBLE AS overall_recall,
  round(sum(n) / sum(probed), 9) AS overall_precision, round(avg(probed), 9) AS mean_probed FROM r""",
)
def recall_precision(spark, sf):
    b, q = base(spark, sf), queries(spark, sf)
    probed = J.prefix_search(b, q, 8).groupBy("qid").agg(F.count("*").alias("probed"))
    out = M.recall_precision(q, J.interval_search(b, q, D), J.prefix_filter_refine(b, q, 8, D), probed)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "gt_summary",
    with_(B, Q, HITS, TRUE_SIZES) + "SELECT round(avg(n), 9) AS mean_size, round(avg(CASE WHEN n > 0 THEN n END), 9) AS mean_nonempty_size, count(CASE WHEN n > 0 THEN 1 END) AS nonempty FROM sizes",
)
def gt_summary(spark, sf):
    out = M.truth_summary(queries(spark, sf), interval_search(spark, sf))
    return out.select(F.round("mean_size", 9).alias("mean_size"), F.round("mean_nonempty_size", 9).alias("mean_nonempty_size"), "nonempty")
