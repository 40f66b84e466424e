"""Queries of transforms, statistics and workload generation."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.distance import squared
from ..operators import joins as J
from ..operators import lsh as L
from ..operators import ranking as R
from ..operators import stats as ST
from ..operators import workload as W
from ..sources import models as MO
from ..sources.shared import shared_path
from .fixtures import ACTIVE_SQL, B, D, Q, base, boxes, queries, query, with_, with_dims

STATS = "st AS (SELECT i, avg(CAST(x AS DOUBLE)) AS mean, min(CAST(x AS DOUBLE)) AS lo, max(CAST(x AS DOUBLE)) AS hi, max(abs(CAST(x AS DOUBLE))) AS top FROM b GROUP BY i)"
MAX_ABS = "(SELECT max(abs(x - mean)) FROM b JOIN st USING (i))"
NOISE = "((qid * 7919 + (i + 1) * 104729) % 10007) / 10007.0::DOUBLE"


def long(rows, column, key="vec_id", digits=6):
    out = rows.select(key, F.posexplode(column).alias("i", "v"))
    return out.select(key, F.col("i").cast("long").alias("i"), F.round(F.col("v").cast("double"), digits).alias("v"))


def spread_sql(percent):
    return f"sp AS (SELECT i, quantile_cont(CAST(x AS DOUBLE), {0.5 + percent / 200}) - quantile_cont(CAST(x AS DOUBLE), {0.5 - percent / 200}) AS s FROM b GROUP BY i)"


@query(
    "ip_transform",
    with_(B, Q)
    + """SELECT 'x' AS side, vec_id AS id, k * 64 + i AS i, round(c * pow(CAST(x AS DOUBLE), 2 - k), 6) + 0.0::DOUBLE AS v FROM b, (VALUES (0, -1.0), (1, 2.0), (2, -1.0)) AS t(k, c)
UNION ALL SELECT 'q', qid, k * 64 + i, round(pow(CAST(q AS DOUBLE), k) / pow(CAST(rg AS DOUBLE), 2), 6) + 0.0::DOUBLE FROM q, (VALUES (0), (1), (2)) AS t(k)""",
)
def ip_transform(spark, sf):
    x, _ = V.inner_product_sides(F.col("x"), F.col("x"), F.col("x"), 2)
    _, q = V.inner_product_sides(F.col("q"), F.col("q"), F.col("rg"), 2)
    left = long(base(spark, sf), x).select(F.lit("x").alias("side"), F.col("vec_id").alias("id"), "i", "v")
    return left.unionByName(long(queries(spark, sf), q, "qid").select(F.lit("q").alias("side"), F.col("qid").alias("id"), "i", "v"))


IP = "ip AS (SELECT qid, vec_id, round(sum(CAST(x AS DOUBLE) * x / pow(CAST(rg AS DOUBLE), 2) - 2 * CAST(x AS DOUBLE) * q / pow(CAST(rg AS DOUBLE), 2) + CAST(q AS DOUBLE) * q / pow(CAST(rg AS DOUBLE), 2)), 9) AS dist FROM b JOIN q USING (i) GROUP BY qid, vec_id)"


@query("ip_rank", with_(B, Q, IP) + "SELECT qid, vec_id, rank FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM ip) WHERE rank <= 20")
def ip_rank(spark, sf):
    left, _ = V.inner_product_sides(F.col("x"), F.col("x"), F.col("x"), 2)
    _, right = V.inner_product_sides(F.col("q"), F.col("q"), F.col("rg"), 2)
    b, q = base(spark, sf).select("vec_id", left.alias("x")), queries(spark, sf).select("qid", right.alias("q"))
    dist = F.round(-V.dot(F.col("x"), F.col("q")), 9)
    scored = J.theta_join(b, q, lambda: F.lit(True)).select("qid", "vec_id", dist.alias("dist"))
    return R.top_k(scored, "dist", 20).select("qid", "vec_id", F.col("rank").cast("long").alias("rank"))


#: Projection to 32 dimensions of the transformed vectors, seeded.
RANDOM = np.round(np.random.default_rng(808).normal(size=(32, 3 * D)) / np.sqrt(32), 4)
RANDOM_SQL = "rp(j, n, a) AS (VALUES " + ", ".join(f"({j}, {n}, {a})" for j, row in enumerate(RANDOM) for n, a in enumerate(row)) + ")"


@query(
    "rp_rank",
    with_(B, Q, RANDOM_SQL)
    + """, tx AS (SELECT vec_id, k * 64 + i AS n, c * pow(CAST(x AS DOUBLE), 2 - k) AS v FROM b, (VALUES (0, -1.0), (1, 2.0), (2, -1.0)) AS t(k, c)),
tq AS (SELECT qid, k * 64 + i AS n, pow(CAST(q AS DOUBLE), k) / pow(CAST(rg AS DOUBLE), 2) AS v FROM q, (VALUES (0), (1), (2)) AS t(k)),
px AS (SELECT vec_id, j, sum(v * a) AS v FROM tx JOIN rp USING (n) GROUP BY vec_id, j), pq AS (SELECT qid, j, sum(v * a) AS v FROM tq JOIN rp USING (n) GROUP BY qid, j),
s AS (SELECT qid, vec_id, round(-sum(px.v * pq.v), 6) AS dist FROM px JOIN pq USING (j) GROUP BY qid, vec_id)
SELECT qid, vec_id, rank FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM s) WHERE rank <= 20""",
)
def rp_rank(spark, sf):
    left, _ = V.inner_product_sides(F.col("x"), F.col("x"), F.col("x"), 2)
    _, right = V.inner_product_sides(F.col("q"), F.col("q"), F.col("rg"), 2)
    project = lambda v: V.let(v, lambda t: F.transform(V.literal(RANDOM, "array<array<double>>"), lambda row: V.dot(row, t)))
    b, q = base(spark, sf).select("vec_id", project(left).alias("x")), queries(spark, sf).select("qid", project(right).alias("q"))
    scored = J.theta_join(b, q, lambda: F.lit(True)).select("qid", "vec_id", F.round(-V.dot(F.col("x"), F.col("q")), 6).alias("dist"))
    return R.top_k(scored, "dist", 20).select("qid", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(
    "mips_augment",
    with_(B, "n AS (SELECT vec_id, sum(CAST(x AS DOUBLE) * x) AS s FROM b GROUP BY vec_id)") + """SELECT vec_id, 64 AS i, round(sqrt(greatest(0, (SELECT max(s) FROM n) - s)), 6) AS v FROM n
UNION ALL SELECT vec_id, i, round(CAST(x AS DOUBLE), 6) FROM b""",
)
def mips_augment(spark, sf):
    return long(ST.mips_augmented(base(spark, sf), queries(spark, sf))[0], F.col("x"))


@query(
    "scale_mean",
    with_(B, Q, STATS, f"m AS (SELECT {MAX_ABS} / 2.0 AS m)") + """SELECT 'x' AS side, vec_id AS id, i, round((x - mean) / m, 6) AS v FROM b JOIN st USING (i), m
UNION ALL SELECT 'q', qid, i, round((q - mean) / m, 6) FROM q JOIN st USING (i), m UNION ALL SELECT 'w', qid, i, round(rg / m, 6) FROM q, m""",
)
def scale_mean(spark, sf):
    b, q = ST.scale_mean(base(spark, sf), queries(spark, sf), 2.0, D)
    side = lambda rows, c, name, key: long(rows, F.col(c), key).select(F.lit(name).alias("side"), F.col(key).alias("id"), "i", "v")
    return side(b, "x", "x", "vec_id").unionByName(side(q, "q", "q", "qid")).unionByName(side(q, "rg", "w", "qid"))


@query("zero_mean", with_(B, STATS) + "SELECT vec_id, i, round(x - mean, 6) AS v FROM b JOIN st USING (i)")
def zero_mean(spark, sf):
    return long(ST.zero_mean(base(spark, sf), D), F.col("x"))


@query("scale_to", with_(B, STATS) + "SELECT vec_id, i, round(x * 3.0::DOUBLE / top, 6) AS v FROM b JOIN st USING (i)")
def scale_to(spark, sf):
    return long(ST.scale_to(base(spark, sf), 3.0, D), F.col("x"))


@query("trig_embed", with_(B) + "SELECT vec_id, i, round(cos(CAST(x AS DOUBLE)), 6) AS v FROM b UNION ALL SELECT vec_id, i + 64, round(sin(CAST(x AS DOUBLE)), 6) FROM b")
def trig_embed(spark, sf):
    return long(base(spark, sf), V.trig(F.col("x")))


@query(
    "trig_embed_q",
    with_(B, Q) + "SELECT qid, i, round(rg * cos(CAST(q AS DOUBLE)), 6) AS v FROM q UNION ALL SELECT qid, i + 64, round(rg * sin(CAST(q AS DOUBLE)), 6) FROM q",
)
def trig_embed_q(spark, sf):
    return long(queries(spark, sf), V.trig_weighted(F.col("q"), F.col("rg")), "qid")


P75 = "p AS (SELECT i, quantile_cont(abs(CAST(x AS DOUBLE)), 0.75) AS p FROM b GROUP BY i)"


@query("p75_scale", with_(B, P75) + "SELECT i, round(p, 6) AS value FROM p")
def p75_scale(spark, sf):
    return ST.percentiles(base(spark, sf), 0.75, absolute=True).select(F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


@query("dim_scale", with_(B, P75) + "SELECT vec_id, i, round(x / p, 6) AS v FROM b JOIN p USING (i)")
def dim_scale(spark, sf):
    b = base(spark, sf)
    return long(b, ST.divided(F.col("x"), ST.vector_of(ST.percentiles(b, 0.75, absolute=True), "value", D)))


@query("l2_normalize", with_(B, "n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM b GROUP BY vec_id)") + "SELECT vec_id, i, round(x / n, 6) AS v FROM b JOIN n USING (vec_id)")
def l2_normalize(spark, sf):
    return long(base(spark, sf), V.normalized(F.col("x")))


@query("subspace_split", with_(B) + "SELECT vec_id, CASE WHEN i < 52 THEN i // 13 ELSE 4 END AS m, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 6) AS total FROM b GROUP BY 1, 2")
def subspace_split(spark, sf):
    parts = V.subspaces(F.col("x"), V.split_dims(D, 5))
    rows = base(spark, sf).select("vec_id", F.posexplode(parts).alias("m", "part"))
    return rows.select("vec_id", F.col("m").cast("long").alias("m"), F.size("part").cast("long").alias("n"), F.round(V.total(F.transform("part", lambda v: v.cast("double"))), 6).alias("total"))


@query("dim_extent", with_(B, STATS) + "SELECT i, round(lo, 6) AS lo, round(hi, 6) AS hi, round((lo + hi) / 2, 6) AS centre, round((hi - lo) / 2, 6) AS half FROM st")
def dim_extent(spark, sf):
    out = ST.extent(base(spark, sf))
    return out.select(F.col("i").cast("long").alias("i"), *[F.round(c, 6).alias(c) for c in ("lo", "hi", "centre", "half")])


@query("dim_moments", with_(B, STATS) + "SELECT i, round(mean, 6) AS mean, round(top, 6) AS top FROM st")
def dim_moments(spark, sf):
    v = F.col("v").cast("double")
    out = ST.per_dim(base(spark, sf), F.round(F.avg(v), 6).alias("mean"), F.round(F.max(F.abs(v)), 6).alias("top"))
    return out.withColumn("i", F.col("i").cast("long"))


@query(
    "sparse_to_dense",
    with_(B, Q, STATS)
    + f"SELECT qid, i, round(CASE WHEN {ACTIVE_SQL} THEN CAST(q AS DOUBLE) ELSE (lo + hi) / 2 END, 6) AS q, round(CASE WHEN {ACTIVE_SQL} THEN CAST(rg AS DOUBLE) ELSE (hi - lo) / 2 END, 6) AS rg FROM q JOIN st USING (i)",
)
def sparse_to_dense(spark, sf):
    out = ST.sparse_to_dense(with_dims(queries(spark, sf)), base(spark, sf), D)
    rows = out.select("qid", F.posexplode(F.arrays_zip("q", "rg")).alias("i", "e"))
    return rows.select("qid", F.col("i").cast("long").alias("i"), F.round("e.q", 6).alias("q"), F.round("e.rg", 6).alias("rg"))


#: Widths from 0.1 to 1.38, so that the widest dimension is cut in several parts.
WIDE = "wq AS (SELECT qid, i, q, CAST((10 + (qid // 100 + i * 5) % 129) / 100.0 AS DOUBLE) AS w FROM q)"


def wide(rows):
    return rows.withColumn("rg", F.transform(V.dims(D), lambda i: (F.lit(10) + F.pmod(F.floor(F.col("qid") / 100) + i * 5, F.lit(129))) / F.lit(100.0)))


@query(
    "split_range",
    with_(
        B,
        Q,
        WIDE,
        "o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, i) AS r FROM wq)",
        "c AS (SELECT a.qid, a.i, a.q, a.w, greatest(1, CAST(floor(a.w / n.w + 0.6) AS INTEGER)) AS parts FROM o a JOIN o n ON a.qid = n.qid AND a.r = 1 AND n.r = 2)",
        "cut AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM c)",
    )
    + "SELECT cut.qid, part, o.i, round(CASE WHEN o.i = cut.i THEN o.q - cut.w + (2 * part - 1) * cut.w / parts ELSE CAST(o.q AS DOUBLE) END, 6) AS v FROM cut JOIN o ON o.qid = cut.qid",
)
def split_range(spark, sf):
    from pyspark.sql import Window

    out = L.split_range(wide(queries(spark, sf)), 1, D)
    rows = out.withColumn("part", F.row_number().over(Window.partitionBy("qid").orderBy("q")).cast("long"))  # few parts of a query
    return rows.select("qid", "part", F.posexplode("q").alias("i", "v")).select("qid", "part", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("percentile_width", with_(B, spread_sql(40)) + "SELECT i, round(s, 6) AS width FROM sp")
def percentile_width(spark, sf):
    spread = W.percentile_spread(base(spark, sf), 40, D)
    return spark.createDataFrame([(i, round(float(s), 6)) for i, s in enumerate(spread)], "i long, width double")


NOISES = {"uniform": f"1 + {NOISE}", "normal": f"1 + abs(ln(((1 + {NOISE}) / 2) / (1 - (1 + {NOISE}) / 2)) / 1.702::DOUBLE)", "zipf": f"floor(1 / (1 - {NOISE}))"}


def range_gen(kind):
    @query(f"range_gen_{kind}", with_(B, Q, spread_sql(40)) + f"SELECT qid, i, round(CAST(CAST(({NOISES[kind]}) * s AS FLOAT) AS DOUBLE), 5) AS v FROM q JOIN sp USING (i)")
    def run(spark, sf):
        return long(W.with_widths(queries(spark, sf), base(spark, sf), 40, kind, D), F.col("rg"), "qid", 5)


for _kind in NOISES:
    range_gen(_kind)


@query("sparse_dims", with_(B, Q, f"r AS (SELECT qid, i, row_number() OVER (PARTITION BY qid ORDER BY {NOISE}, i) AS r FROM q)") + "SELECT qid, i FROM r WHERE r <= 6")
def sparse_dims(spark, sf):
    rows = W.active_dims(queries(spark, sf), 6, D)
    return rows.select("qid", F.explode("dims").alias("i")).select("qid", F.col("i").cast("long").alias("i"))


SCALE = """s AS (SELECT qid, vec_id, max(abs(CAST(x AS DOUBLE) - q) / rg) AS s FROM b JOIN q USING (i) GROUP BY qid, vec_id),
o AS (SELECT qid, s, row_number() OVER (PARTITION BY qid ORDER BY s, vec_id) AS r FROM s),
f AS (SELECT qid, s AS scale FROM o WHERE r = 10)"""


@query("find_scale", with_(B, Q, SCALE) + "SELECT f.qid, round(scale, 6) AS scale, count(*) AS n FROM f JOIN o ON o.qid = f.qid AND o.s <= scale AND r <= 21 GROUP BY f.qid, scale")
def find_scale(spark, sf):
    out = W.find_scale(base(spark, sf), queries(spark, sf), 10, 20, D)
    return out.select("qid", F.round("scale", 6).alias("scale"), "n")


@query("range_gen_scaled", with_(B, Q, SCALE) + "SELECT qid, i, round(rg * scale, 6) AS v FROM q JOIN f USING (qid)")
def range_gen_scaled(spark, sf):
    q = queries(spark, sf)
    scale = W.find_scale(base(spark, sf), q, 10, 20, D).select("qid", "scale")
    return long(q.join(scale, "qid").withColumn("rg", F.transform("rg", lambda v: v * F.col("scale"))), F.col("rg"), "qid")


@query(
    "range_by_percent",
    with_(B) + "SELECT q.vec_id AS qid, round(quantile_cont(abs(CAST(b.x AS DOUBLE) - q.x), 0.3), 6) AS width FROM b JOIN b q ON b.i = 0 AND q.i = 0 AND q.vec_id % 100 = 0 GROUP BY q.vec_id",
)
def range_by_percent(spark, sf):
    values = base(spark, sf).select("vec_id", F.col("x")[0].cast("double").alias("x"))
    q = queries(spark, sf).select("qid", F.col("q")[0].cast("double").alias("q"), F.lit(0.3).alias("share"))
    return W.range_by_percent(values, q).select("qid", F.round("width", 6).alias("width"))


#: Value at a share of ordered values, between neighbours by straight line.
PLACE = "(v[CAST(floor(({at}) * n) AS INTEGER) + 1] + (v[CAST(ceil(({at}) * n) AS INTEGER) + 1] - v[CAST(floor(({at}) * n) AS INTEGER) + 1]) * (({at}) * n - floor(({at}) * n)))"
#: Bisection by recursion: a row per step with the interval after it; percentiles are read from ordered values.
BISECTION = f"""ordered AS (SELECT i, list_sort(list(CAST(x AS DOUBLE))) AS v, count(*) - 1 AS n FROM b GROUP BY i),
noise AS (SELECT qid, i, q, {NOISES['uniform']} AS u FROM q),
step AS (
  SELECT 0 AS k, 0.0::DOUBLE AS low, 100.0::DOUBLE AS high, 0.0::DOUBLE AS percent, 0.0::DOUBLE AS size, false AS reached, 100.0::DOUBLE AS was
  UNION ALL
  SELECT k + 1, CASE WHEN size < 20 THEN mid ELSE low END, CASE WHEN size < 20 THEN high ELSE mid END, mid, size, abs(size - 20) <= 1, high - low
  FROM (
    SELECT k, low, high, mid, sum(hit) / (SELECT count(DISTINCT qid) FROM q)::DOUBLE AS size
    FROM (
      SELECT k, low, high, mid, qid, vec_id, CASE WHEN bool_and(abs(x - q) <= CAST(u * s AS FLOAT)) THEN 1 ELSE 0 END AS hit
      FROM (
        SELECT k, low, high, mid, i, {PLACE.format(at='0.5 + mid / 200')} - {PLACE.format(at='0.5 - mid / 200')} AS s
        FROM (SELECT *, (low + high) / 2 AS mid FROM step WHERE NOT reached AND was >= 1e-4 AND k < 64), ordered) AS spread
      JOIN noise USING (i) JOIN b USING (i)
      GROUP BY k, low, high, mid, qid, vec_id) AS pairs
    GROUP BY k, low, high, mid) AS sized)"""


@query(
    "find_percent",
    with_(B, Q, BISECTION).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT 'uniform' AS kind, 20::INTEGER AS target, size, percent, reached FROM step WHERE k = (SELECT max(k) FROM step)",
)
def find_percent(spark, sf):
    b, q = base(spark, sf), queries(spark, sf)
    n = q.count()

    def mean_size(percent):
        return J.interval_search(b, W.with_widths(q, b, percent, "uniform", D), D).count() / n

    percent, size, reached = W.find_percent(mean_size, 20.0)
    return spark.createDataFrame([("uniform", 20, size, percent, reached)], "kind string, target int, size double, percent double, reached boolean")


def sweep_sql(kind, percent):
    """Mean result size of a workload, of widths noise times spread."""
    spread = spread_sql(percent).replace("sp AS", f"sp{percent} AS")
    return spread, f"SELECT 'embeddings' AS dataset, '{kind}' AS kind, 0 AS target, round(count(hit) / count(DISTINCT qid)::DOUBLE, 6) AS size, {percent}.0::DOUBLE AS percent FROM (SELECT qid, NULL AS hit FROM q WHERE i = 0 UNION ALL SELECT qid, vec_id FROM b JOIN (SELECT qid, i, q, CAST(({NOISES[kind]}) * s AS FLOAT) AS w FROM q JOIN sp{percent} USING (i)) USING (i) GROUP BY qid, vec_id HAVING bool_and(abs(x - q) <= w))"


SWEEP = [(kind, percent) for percent in (40, 70) for kind in NOISES]


@query("workload_sweep", with_(B, Q, *dict.fromkeys(sweep_sql(k, p)[0] for k, p in SWEEP)) + "\nUNION ALL ".join(sweep_sql(k, p)[1] for k, p in SWEEP))
def workload_sweep(spark, sf):
    """Mean result sizes over kinds and selectivities of ranges, written as workload records and read back."""
    b, q, path = base(spark, sf), queries(spark, sf), shared_path(spark, "records")
    n, rows = q.count(), []
    for kind, percent in SWEEP:
        found = J.interval_search(b, W.with_widths(q, b, percent, kind, D), D).agg(F.round(F.count("*") / n, 6).alias("size"))
        rows.append(found.select(F.lit("embeddings").alias("dataset"), F.lit(kind).alias("kind"), F.lit(0).alias("target"), "size", F.lit(float(percent)).alias("percent")))
    MO.write_records(reduce(DataFrame.unionByName, rows), path)
    return MO.read_records(spark, path)


@query(
    "ip_transform_stored",
    with_(B, Q, "bw AS (SELECT vec_id, i, x, CAST((30 + (vec_id * 5 + i) % 13) / 100.0 AS FLOAT) AS w FROM b)")
    + """SELECT 'x' AS side, vec_id AS id, k * 64 + i AS i, round(c * pow(CAST(x AS DOUBLE), 2 - k) / pow(CAST(w AS DOUBLE), 2), 5) + 0.0::DOUBLE AS v FROM bw, (VALUES (0, -1.0), (1, 2.0), (2, -1.0)) AS t(k, c)
UNION ALL SELECT 'q', qid, k * 64 + i, round(pow(CAST(q AS DOUBLE), k), 5) + 0.0::DOUBLE FROM q, (VALUES (0), (1), (2)) AS t(k)""",
)
def ip_transform_stored(spark, sf):
    """The inner-product form where stored vectors bring the widths."""
    x, _ = V.inner_product_sides(F.col("x"), F.col("x"), F.col("rg"), 2, stored_widths=True)
    _, q = V.inner_product_sides(F.col("q"), F.col("q"), F.col("rg"), 2, stored_widths=True)
    left = long(boxes(spark, sf), x, digits=5).select(F.lit("x").alias("side"), F.col("vec_id").alias("id"), "i", "v")
    return left.unionByName(long(queries(spark, sf), q, "qid", 5).select(F.lit("q").alias("side"), F.col("qid").alias("id"), "i", "v"))


@query("hold_out", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) SELECT vec_id, CASE WHEN r <= 50 THEN 'query' ELSE 'base' END AS part FROM r")
def hold_out(spark, sf):
    chosen, rest = W.hold_out(base(spark, sf), 50, "vec_id")
    return chosen.select("vec_id", F.lit("query").alias("part")).unionByName(rest.select("vec_id", F.lit("base").alias("part")))


@query("squared_norms", with_(B) + "SELECT vec_id, round(sum(CAST(x AS DOUBLE) * x), 6) AS v FROM b GROUP BY vec_id")
def squared_norms(spark, sf):
    zero = V.literal(np.zeros(D), "array<double>")
    return base(spark, sf).select("vec_id", F.round(squared(F.col("x"), zero), 6).alias("v"))
