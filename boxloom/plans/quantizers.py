"""Queries of quantizers, the multi-index and product-quantization boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import distance as DI
from ..functions.vectors import normalized, split_dims
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import multiindex as I
from ..operators import quantize as Z
from ..operators import stats as ST
from ..sources import models as MO
from ..sources import vecs as VS
from ..sources.shared import shared_path, stored
from . import fixtures as X
from .hashing import RECALL, measured
from .fixtures import ACTIVE_SQL, ADC, BOUNDS, CB, CELL_CB, CELL_CODES, CELLS, CODES, DECODED, HITS, PQ_PASS, RANKED, REACH, B, D, Q, base, book, cell_book, queries, query, with_

PQ = (B, Q, CB, CODES)
IMI = (B, Q, CELL_CB, CELL_CODES, CELLS)


def codes(spark, sf):
    return I.build(base(spark, sf), book(spark, sf))


def cell_codes(spark, sf):
    """Base rows with their cell, and the code of the finer product quantizer."""
    rows = I.build(base(spark, sf), cell_book(spark, sf)).drop("code")
    return rows.withColumn("code", book(spark, sf).encode(F.col("x")))


def reach(spark, sf):
    b = book(spark, sf)
    return I.reachable(queries(spark, sf), I.boxes(I.bucket_bounds(codes(spark, sf), b)), b)


def rounded(rows, *names, digits=6):
    return rows.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in rows.columns])


def longs(rows, *names):
    return rows.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in rows.columns])


@query("pq_encode", with_(B, CB, CODES) + "SELECT vec_id, m, k FROM codes")
def pq_encode(spark, sf):
    return longs(codes(spark, sf).select("vec_id", F.posexplode("code").alias("m", "k")), "m", "k")


@query("pq_decode", with_(B, CB, CODES, DECODED) + "SELECT vec_id, i, round(v, 6) AS v FROM decoded")
def pq_decode(spark, sf):
    b = book(spark, sf)
    rows = codes(spark, sf).select("vec_id", F.posexplode(b.decode(F.col("code"))).alias("i", "v"))
    return rounded(longs(rows, "i"), "v")


@query("pq_compress", with_(B, CB, CODES, DECODED) + "SELECT vec_id, round(sum((x - v) * (x - v)), 6) AS error FROM decoded JOIN b USING (vec_id, i) GROUP BY vec_id")
def pq_compress(spark, sf):
    b = book(spark, sf)
    return rounded(base(spark, sf).select("vec_id", DI.squared(F.col("x"), b.compress(F.col("x"))).alias("error")), "error")


@query("pq_l2", with_(*PQ, DECODED) + "SELECT qid, vec_id, round(sqrt(sum((q - v) * (q - v))), 6) AS dist FROM decoded JOIN q USING (i) GROUP BY qid, vec_id")
def pq_l2(spark, sf):
    b = book(spark, sf)
    rows = base(spark, sf).select("vec_id", b.compress(F.col("x")).alias("x"))
    return J.theta_join(rows, queries(spark, sf), lambda: F.lit(True)).select("qid", "vec_id", F.round(DI.l2(F.col("x"), F.col("q")), 6).alias("dist"))


@query("pq_weighted_dist", with_(*PQ, DECODED) + "SELECT qid, vec_id, round(sum(pow(abs(v - q) / rg, 2)), 6) AS dist FROM decoded JOIN q USING (i) GROUP BY qid, vec_id")
def pq_weighted_dist(spark, sf):
    b = book(spark, sf)
    rows = base(spark, sf).select("vec_id", b.compress(F.col("x")).alias("x"))
    dist = F.round(DI.weighted_dense(F.col("x"), F.col("q"), F.col("rg"), 2, D), 6)
    return J.theta_join(rows, queries(spark, sf), lambda: F.lit(True)).select("qid", "vec_id", dist.alias("dist"))


@query("adc_table", with_(B, Q, CB, ADC) + "SELECT qid, m, k, round(dist, 6) AS dist FROM adct")
def adc_table(spark, sf):
    rows = queries(spark, sf).select("qid", F.posexplode(book(spark, sf).adc_table(F.col("q"), F.col("rg"))).alias("m", "t"))
    return rounded(longs(rows.select("qid", "m", F.posexplode("t").alias("k", "dist")), "m", "k"), "dist")


@query("adc_distance", with_(*PQ, ADC) + "SELECT qid, vec_id, round(sum(dist), 6) AS dist FROM codes JOIN adct USING (m, k) GROUP BY qid, vec_id")
def adc_distance(spark, sf):
    b = book(spark, sf)
    q = queries(spark, sf).select("qid", b.adc_table(F.col("q"), F.col("rg")).alias("t"))
    return J.theta_join(codes(spark, sf), q, lambda: F.lit(True)).select("qid", "vec_id", F.round(Z.adc(F.col("t"), F.col("code"), X.PARTS), 6).alias("dist"))


@query("bucket_bounds", with_(B, CB, CODES, BOUNDS) + "SELECT m, k, i % 16 AS i, round(lo, 6) AS lo, round(hi, 6) AS hi FROM bounds")
def bucket_bounds(spark, sf):
    return rounded(longs(I.bucket_bounds(codes(spark, sf), book(spark, sf)), "m", "k", "i"), "lo", "hi")


@query("bucket_overlap", with_(*PQ, BOUNDS, REACH) + "SELECT qid, m, k FROM reach")
def bucket_overlap(spark, sf):
    return longs(reach(spark, sf), "m", "k")


@query(
    "sparse_overlap",
    with_(*PQ, BOUNDS)
    + f"SELECT qid, m, k FROM bounds JOIN q USING (i) GROUP BY qid, m, k HAVING bool_and(NOT ({ACTIVE_SQL}) OR (lo - q <= rg AND q - hi <= rg))",
)
def sparse_overlap(spark, sf):
    b = book(spark, sf)
    return longs(I.sparse_reachable(X.with_dims(queries(spark, sf)), I.boxes(I.bucket_bounds(codes(spark, sf), b)), b), "m", "k")


@query(
    "pq_exact",
    with_(*PQ, BOUNDS, REACH, PQ_PASS, HITS) + "SELECT hits.qid, vec_id, probed FROM hits JOIN (SELECT qid, count(*) AS probed FROM pq_pass GROUP BY qid) p ON p.qid = hits.qid",
)
def pq_exact(spark, sf):
    passed = stored(I.pq_filtered(codes(spark, sf), queries(spark, sf), reach(spark, sf), X.PARTS).select("qid", "vec_id", "x"), "pq-passed")
    return I.hits(passed, queries(spark, sf), D).join(passed.groupBy("qid").agg(F.count("*").alias("probed")), "qid")


CELL_BOUNDS = BOUNDS.replace("bounds AS", "cbounds AS").replace("FROM cb ", "FROM ccb ").replace("codes USING (vec_id) WHERE codes.m = b.i // 16", "clong USING (vec_id) WHERE clong.m = b.i // 32")
CELL_REACH = REACH.replace("reach AS", "creach AS").replace("FROM bounds", "FROM cbounds")
CELL_LONG = "clong AS (SELECT vec_id, CAST(0 AS INTEGER) AS m, k0 AS k FROM ccodes UNION ALL SELECT vec_id, 1, k1 FROM ccodes)"
MET = "met AS (SELECT r0.qid, k0, k1, n FROM cells JOIN creach r0 ON r0.m = 0 AND r0.k = k0 JOIN creach r1 ON r1.m = 1 AND r1.k = k1 AND r1.qid = r0.qid)"
EXACT = (*IMI, CELL_LONG, CELL_BOUNDS, CELL_REACH, MET, HITS)
PROBED = "p AS (SELECT qid, sum(n) AS probed FROM met GROUP BY qid)"


def met_cells(spark, sf):
    """Non-empty cells that each query's box meets."""
    b = cell_book(spark, sf)
    rows = I.build(base(spark, sf), b)
    return I.reachable_cells(rows, I.reachable(queries(spark, sf), I.boxes(I.bucket_bounds(rows, b)), b))


@query("imi_exact", with_(*EXACT, PROBED) + "SELECT hits.qid, vec_id, CAST(probed AS BIGINT) AS probed FROM hits JOIN p ON p.qid = hits.qid")
def imi_exact(spark, sf):
    met = met_cells(spark, sf)
    found = I.hits(I.members(met, cell_codes(spark, sf)), queries(spark, sf), D)
    return found.join(met.groupBy("qid").agg(F.sum("n").alias("probed")), "qid")


@query("imi_pq_exact", with_(*EXACT, PROBED) + "SELECT hits.qid, vec_id, CAST(probed AS BIGINT) AS probed FROM hits JOIN p ON p.qid = hits.qid")
def imi_pq_exact(spark, sf):
    met = met_cells(spark, sf)
    may = I.possible(reach(spark, sf), X.PARTS)
    candidates = I.members(met, cell_codes(spark, sf)).join(may, "qid").where(I.code_possible(F.col("code"), F.col("may"), X.PARTS))
    return I.hits(candidates, queries(spark, sf), D).join(met.groupBy("qid").agg(F.sum("n").alias("probed")), "qid")


@query(
    "exact_summary",
    with_(*EXACT, PROBED, "s AS (SELECT qid, count(*) AS n FROM hits GROUP BY qid)") + "SELECT 1.0::DOUBLE AS recall, round(avg(probed), 6) AS mean_probed FROM s JOIN p USING (qid)",
)
def exact_summary(spark, sf):
    q = queries(spark, sf)
    met = met_cells(spark, sf)
    found = I.hits(I.members(met, cell_codes(spark, sf)), q, D)
    out = M.recall_precision(q, J.interval_search(base(spark, sf), q, D), found, met.groupBy("qid").agg(F.sum("n").alias("probed")))
    return rounded(out.select("recall", "mean_probed"), "recall", "mean_probed")


@query("imi_build", with_(B, CELL_CB, CELL_CODES) + "SELECT vec_id, k0, k1 FROM ccodes")
def imi_build(spark, sf):
    return longs(I.build(base(spark, sf), cell_book(spark, sf)).select("vec_id", "k0", "k1"), "k0", "k1")


@query("bucket_stats", with_(B, CELL_CB, CELL_CODES, CELLS) + "SELECT max(n) AS largest, min(n) AS smallest, count(*) AS nonempty, CAST(floor(sum(n) / count(*)) AS BIGINT) AS mean FROM cells")
def bucket_stats(spark, sf):
    return I.cell_stats(I.build(base(spark, sf), cell_book(spark, sf)))


def ranked(spark, sf):
    b = cell_book(spark, sf)
    return I.ranked_cells(I.build(base(spark, sf), b), queries(spark, sf), b)


@query("imi_sequence", with_(*IMI, RANKED) + "SELECT qid, k0, k1, n, round(dist, 6) AS dist, place FROM ranked")
def imi_sequence(spark, sf):
    return rounded(longs(ranked(spark, sf), "k0", "k1", "place"), "dist")


BEFORE = "r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)"
TOP = "taken AS (SELECT qid, k0, k1 FROM r WHERE before < 60)"
TAKEN = "SELECT t.qid, c.vec_id, h.vec_id IS NOT NULL AS hit FROM taken t JOIN ccodes c USING (k0, k1) LEFT JOIN hits h ON h.qid = t.qid AND h.vec_id = c.vec_id"


def probed_rows(spark, sf, probed):
    """(qid, vec_id, hit) of the rows in probed cells."""
    rows = I.members(probed, cell_codes(spark, sf))
    hits = I.hits(rows, queries(spark, sf), D).withColumn("hit", F.lit(True))
    return rows.select("qid", "vec_id").join(hits, ["qid", "vec_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("imi_probe_topk", with_(*IMI, RANKED, HITS, BEFORE, TOP) + TAKEN)
def imi_probe_topk(spark, sf):
    return probed_rows(spark, sf, I.probed_top_k(ranked(spark, sf), 60))


@query("imi_probe_threshold", with_(*IMI, RANKED, HITS, "taken AS (SELECT qid, k0, k1 FROM ranked WHERE dist <= 18)") + TAKEN)
def imi_probe_threshold(spark, sf):
    return probed_rows(spark, sf, I.probed_threshold(ranked(spark, sf), 18.0))


PRECISION = """ch AS (SELECT h.qid, k0, k1, count(*) AS hits FROM hits h JOIN ccodes USING (vec_id) GROUP BY h.qid, k0, k1),
r AS (SELECT ranked.*, coalesce(sum(n) OVER w, 0) AS pb, coalesce(sum(coalesce(hits, 0)) OVER w, 0) AS hb FROM ranked LEFT JOIN ch USING (qid, k0, k1)
  WINDOW w AS (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stops AS (SELECT qid, min(place) AS stop FROM r WHERE pb > 100 AND hb / pb < 0.05 GROUP BY qid),
taken AS (SELECT ranked.qid, k0, k1 FROM ranked LEFT JOIN stops USING (qid) WHERE stop IS NULL OR place < stop)"""


@query("imi_probe_precision", with_(*IMI, RANKED, HITS, PRECISION) + TAKEN)
def imi_probe_precision(spark, sf):
    rows = cell_codes(spark, sf)
    hits = J.interval_search(base(spark, sf), queries(spark, sf), D).join(rows.select("vec_id", "k0", "k1"), "vec_id")
    by_cell = hits.groupBy("qid", "k0", "k1").agg(F.count("*").alias("hits"))
    return probed_rows(spark, sf, I.probed_precision(ranked(spark, sf), by_cell, 0.05))


@query("imi_pq_probe", with_(*IMI, CB, CODES, BOUNDS, REACH, PQ_PASS, RANKED, HITS, BEFORE, TOP) + "SELECT t.qid, c.vec_id FROM taken t JOIN ccodes c USING (k0, k1) JOIN pq_pass p ON p.qid = t.qid AND p.vec_id = c.vec_id JOIN hits h ON h.qid = t.qid AND h.vec_id = c.vec_id")
def imi_pq_probe(spark, sf):
    rows = I.members(I.probed_top_k(ranked(spark, sf), 60), cell_codes(spark, sf))
    rows = rows.join(I.possible(reach(spark, sf), X.PARTS), "qid").where(I.code_possible(F.col("code"), F.col("may"), X.PARTS))
    return I.hits(rows, queries(spark, sf), D)


@query(
    "imi_pqrank_probe",
    with_(*IMI, CB, CODES, ADC, RANKED, HITS, BEFORE, TOP, "adcd AS (SELECT qid, vec_id, round(sum(dist), 9) AS adc FROM codes JOIN adct USING (m, k) GROUP BY qid, vec_id)")
    + """SELECT qid, vec_id, place, hit FROM (SELECT t.qid, c.vec_id, row_number() OVER (PARTITION BY t.qid ORDER BY adc, c.vec_id) AS place, h.vec_id IS NOT NULL AS hit
  FROM taken t JOIN ccodes c USING (k0, k1) JOIN adcd a ON a.qid = t.qid AND a.vec_id = c.vec_id LEFT JOIN hits h ON h.qid = t.qid AND h.vec_id = c.vec_id) WHERE place <= 10""",
)
def imi_pqrank_probe(spark, sf):
    rows = I.members(I.probed_top_k(ranked(spark, sf), 60), cell_codes(spark, sf))
    best = I.ranked_candidates(rows, queries(spark, sf), book(spark, sf), 10)
    hits = I.hits(best, queries(spark, sf), D).withColumn("hit", F.lit(True))
    return longs(best.select("qid", "vec_id", "place").join(hits, ["qid", "vec_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "place")


LLOYD = "SELECT m, k, cb.i % 16 AS i, round(coalesce(avg(CASE WHEN codes.vec_id IS NOT NULL THEN CAST(x AS DOUBLE) END), any_value(c)), 6) AS v FROM cb LEFT JOIN codes USING (m, k) LEFT JOIN b ON b.vec_id = codes.vec_id AND b.i = cb.i GROUP BY m, k, cb.i"


def book_rows(spark, b):
    rows = [(m, k, i, round(float(v), 6)) for m, part in enumerate(b.centroids) for k, c in enumerate(part) for i, v in enumerate(c)]
    return spark.createDataFrame(rows, "m long, k long, i long, v double")


@query("lloyd_step", with_(B, CB, CODES) + LLOYD)
def lloyd_step(spark, sf):
    return book_rows(spark, Z.lloyd(base(spark, sf), book(spark, sf)))


NEXT = "cb{n} AS (SELECT cb.m, cb.k, cb.i, coalesce(avg(CASE WHEN codes.vec_id IS NOT NULL THEN CAST(x AS DOUBLE) END), any_value(c)) AS c FROM cb LEFT JOIN codes USING (m, k) LEFT JOIN b ON b.vec_id = codes.vec_id AND b.i = cb.i GROUP BY cb.m, cb.k, cb.i)"


@query(
    "pq_codebook",
    with_(B, CB, CODES, NEXT.format(n=1), CODES.replace("codes AS", "codes1 AS").replace("JOIN cb ", "JOIN cb1 ").replace("cb.", "cb1."))
    + LLOYD.replace("FROM cb ", "FROM cb1 ").replace("codes", "codes1").replace("cb.i", "cb1.i"),
)
def pq_codebook(spark, sf):
    return book_rows(spark, Z.PQ(X.PARTS, X.KS).fit(base(spark, sf), D, 2).book)


P4 = "round(sum(pow(abs(x - c), 4)), 9)"
CODES4 = CODES.replace("round(sum((x - c) * (x - c)), 9)", P4)


@query(
    "vq_lp",
    with_(B, "cb AS (SELECT vec_id AS k, i, CAST(x AS DOUBLE) AS c FROM b WHERE vec_id < 16)", f"d AS (SELECT b.vec_id, cb.k, {P4} AS dist FROM b JOIN cb USING (i) GROUP BY b.vec_id, cb.k)")
    + "SELECT vec_id, k, round(pow(dist, 0.25), 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) AS r FROM d) WHERE r = 1",
)
def vq_lp(spark, sf):
    b = Z.first_rows(base(spark, sf), X.KS, [(0, D)], 4)
    rows = base(spark, sf).select("vec_id", b.nearest(F.col("x"), 0).alias("n"))
    return rows.select("vec_id", F.col("n.k").cast("long").alias("k"), F.round(F.pow("n.dist", F.lit(0.25)), 6).alias("dist"))


@query(
    "lp_newton_step",
    with_(B, CB, CODES4)
    + "SELECT m, k, cb.i % 16 AS i, round(c - sum((c - x) * pow(abs(c - x), 2)) / nullif(sum(3 * pow(abs(c - x), 2)), 0), 6) AS v FROM cb JOIN codes USING (m, k) JOIN b ON b.vec_id = codes.vec_id AND b.i = cb.i GROUP BY m, k, cb.i, c HAVING sum(3 * pow(abs(c - x), 2)) > 0 UNION ALL SELECT m, k, cb.i % 16, round(c, 6) FROM cb JOIN codes USING (m, k) JOIN b ON b.vec_id = codes.vec_id AND b.i = cb.i GROUP BY m, k, cb.i, c HAVING sum(3 * pow(abs(c - x), 2)) = 0",
)
def lp_newton_step(spark, sf):
    b = book(spark, sf)
    return book_rows(spark, Z.newton(base(spark, sf), Z.Codebook(b.parts, b.centroids, 4), 1))


def second_book(spark, sf):
    """A fixed model for a second layer: half of the rows 16 to 31."""
    rows = np.array([r["x"] for r in base(spark, sf).orderBy("vec_id").limit(2 * X.KS).select("x").collect()], float)[X.KS :] / 2
    parts = split_dims(D, X.PARTS)
    return Z.Codebook(parts, [rows[:, f : f + n] for f, n in parts])


@query(
    "rq_encode",
    with_(B, CB, CODES, DECODED, "rest AS (SELECT vec_id, i, x - v AS x FROM b JOIN decoded USING (vec_id, i))", "cb2 AS (SELECT CAST(i // 16 AS INTEGER) AS m, vec_id - 16 AS k, i, CAST(x AS DOUBLE) / 2 AS c FROM b WHERE vec_id BETWEEN 16 AND 31)", CODES.replace("codes AS", "codes2 AS").replace("FROM b JOIN cb ", "FROM rest b JOIN cb2 ").replace("cb.", "cb2."))
    + "SELECT vec_id, 0 AS layer, m, k FROM codes UNION ALL SELECT vec_id, 1, m, k FROM codes2",
)
def rq_encode(spark, sf):
    rq = Z.RQ([Z.PQ(X.PARTS, X.KS, book=book(spark, sf)), Z.PQ(X.PARTS, X.KS, book=second_book(spark, sf))])
    rows = base(spark, sf).select("vec_id", F.posexplode(rq.encode(F.col("x"))).alias("layer", "code"))
    return longs(rows.select("vec_id", "layer", F.posexplode("code").alias("m", "k")), "layer", "m", "k")


@query(
    "model_files",
    with_(B, CB, CODES, "sc AS (SELECT i, quantile_cont(abs(CAST(x AS DOUBLE)), 0.75) AS s FROM b GROUP BY i)")
    + """SELECT 'centroid' AS kind, m * 16 + k AS id, i - 16 * m AS i, round(c, 6) AS v FROM cb UNION ALL SELECT 'code', vec_id, m, k FROM codes UNION ALL SELECT 'scale', 0, i, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 6) FROM sc
UNION ALL SELECT 'scaled', m * 16 + k, i - 16 * m, round(c * CAST(s AS FLOAT), 5) FROM cb JOIN sc USING (i)""",
)
def model_files(spark, sf):
    """Codebook, codes and scale written and read back, and the centroids in the data's own units."""
    b, rows, paths = book(spark, sf), base(spark, sf), {k: shared_path(spark, k) for k in ("centroids", "codes", "scale")}
    scale = np.array([r["value"] for r in ST.percentiles(rows, 0.75, absolute=True).orderBy("i").collect()])  # a row per dimension
    MO.write_centroids(spark, b.centroids, paths["centroids"])
    MO.write_codes(codes(spark, sf), paths["codes"])
    MO.write_scale(spark, scale, paths["scale"])
    centroids = VS.read_centroids(spark, paths["centroids"], X.PARTS, X.KS, D)
    known = MO.read_codes(spark, paths["codes"], rows.count(), X.PARTS)
    scale = MO.read_scale(spark, paths["scale"], D)

    def long(kind, key, column, digits=6):
        return lambda df: df.select(F.lit(kind).alias("kind"), key.cast("long").alias("id"), F.posexplode(column).alias("i", "v")).select("kind", "id", F.col("i").cast("long").alias("i"), F.round(F.col("v").cast("double"), digits).alias("v"))

    number = F.col("m") * X.KS + F.col("k")
    out = long("centroid", number, "centroid")(centroids).unionByName(long("code", F.col("vec_id"), "code")(known))
    out = out.unionByName(long("scale", F.lit(0), "x")(spark.createDataFrame([([float(v) for v in scale],)], "x array<float>")))
    return out.unionByName(long("scaled", number, "centroid", 5)(MO.scaled_centroids(centroids, scale, b.parts)))


@query("imi_recall", with_(*IMI, RANKED, HITS, BEFORE, TOP, "found AS (SELECT t.qid, c.vec_id FROM taken t JOIN ccodes c USING (k0, k1))") + RECALL)
def imi_recall(spark, sf):
    return measured(spark, sf, imi_probe_topk(spark, sf).select("qid", "vec_id"))


@query("opq_rotate", with_(B, "s AS (SELECT vec_id, sum(CAST(x AS DOUBLE)) / 32 AS s FROM b GROUP BY vec_id)") + "SELECT vec_id, i, round(x - s, 6) AS v FROM b JOIN s USING (vec_id)")
def opq_rotate(spark, sf):
    mirror = np.eye(D) - 2 * np.full((D, D), 1 / D)  # a fixed orthogonal matrix
    rows = base(spark, sf).select("vec_id", F.posexplode(Z.rotated(F.col("x"), mirror)).alias("i", "v"))
    return rounded(longs(rows, "i"), "v")


@query("opq_fit")
def opq_fit(spark, sf):
    """Codes and error of a trained rotation and quantizer."""
    opq = Z.OPQ(X.PARTS, X.KS).fit(base(spark, sf), D, rotations=2, steps=2)
    rows = base(spark, sf).select("vec_id", "x", opq.encode(F.col("x")).alias("codes"))
    return rounded(rows.select("vec_id", F.flatten("codes").alias("code"), DI.squared(F.col("x"), opq.decode(F.col("codes"))).alias("error")), "error")


NEQ = (B, "n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM b GROUP BY vec_id)", "u AS (SELECT vec_id, i, x / n AS x FROM b JOIN n USING (vec_id))", CB.replace("FROM b ", "FROM u "), CODES.replace("FROM b ", "FROM u b "), DECODED, "dn AS (SELECT vec_id, sqrt(sum(v * v)) AS dn FROM decoded GROUP BY vec_id)", "cn AS (SELECT vec_id, round(n / dn, 9) AS cn FROM n JOIN dn USING (vec_id))")
LEVELS = "lv AS (SELECT unnest(range(0, 9)) AS j, unnest(quantile_cont(cn, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])) AS level FROM cn)"
BINS = "bins AS (SELECT vec_id, cn, (SELECT count(*) FROM lv WHERE j BETWEEN 1 AND 7 AND level <= cn) AS k FROM cn)"


def neq(spark, sf):
    unit = base(spark, sf).withColumn("x", normalized(F.col("x")))
    fixed = Z.PQ(X.PARTS, X.KS)
    fixed.fit(unit, D, 0)
    model = Z.NEQ(8, fixed, "percentile")
    norms = base(spark, sf).select(F.round(model.corrected(F.col("x")), 9).alias("n"))
    model.levels = Z.quantile_values(norms, [k / 8 for k in range(9)])
    return model


@query("neq_norm_levels", with_(*NEQ, LEVELS) + "SELECT j, round(level, 6) AS level FROM lv")
def neq_norm_levels(spark, sf):
    return spark.createDataFrame([(j, round(v, 6)) for j, v in enumerate(neq(spark, sf).levels)], "j long, level double")


@query("neq_encode", with_(*NEQ, LEVELS, BINS) + "SELECT vec_id, k FROM bins")
def neq_encode(spark, sf):
    model = neq(spark, sf)
    return base(spark, sf).select("vec_id", model.encode_norm(F.round(model.corrected(F.col("x")), 9)).cast("long").alias("k"))


@query("neq_compress", with_(*NEQ, LEVELS, BINS) + "SELECT vec_id, i, round(v * (a.level + b.level) / 2, 6) AS v FROM decoded JOIN bins USING (vec_id) JOIN lv a ON a.j = k JOIN lv b ON b.j = k + 1")
def neq_compress(spark, sf):
    rows = base(spark, sf).select("vec_id", F.posexplode(neq(spark, sf).compress(F.col("x"))).alias("i", "v"))
    return rounded(longs(rows, "i"), "v")
