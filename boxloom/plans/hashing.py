"""Queries of locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import distance as DI
from ..functions import vectors as V
from ..functions.hashing import E2Lsh, SignHash
from ..functions.predicates import in_box
from ..operators import joins as J
from ..operators import lsh as L
from ..operators import metrics as M
from ..operators import stats as ST
from .fixtures import B, HITS, Q, Q_HALF, D, base, queries, query, with_
from .search import PREFIX

LSH = E2Lsh(D, functions=2, r=0.75, tables=3)
SIGNS = SignHash(D, bits=8, tables=2)
LONG_SIGNS = SignHash(D, bits=256)
TRIG_SIGNS = SignHash(2 * D, bits=6)


def values(name: str, array: np.ndarray) -> str:
    rows = ", ".join(f"({', '.join(map(str, at))}, {v})" for at, v in np.ndenumerate(array))
    return f"{name} AS (VALUES {rows})"


PROJ = values("proj(t, j, i, a)", LSH.projections) + ",\n" + values("offs(t, j, s)", LSH.offsets)
POS = "{out} AS (SELECT {id} AS id, t, j, round((sum(a * {v}) + any_value(s)) / 0.75::DOUBLE, 9) AS v FROM {table} JOIN proj USING (i) JOIN offs USING (t, j) GROUP BY 1, t, j)"
XPOS, QPOS = POS.format(out="xpos", id="vec_id", v="x", table="b"), POS.format(out="qpos", id="qid", v="q", table="q")
KEYS = "{out} AS (SELECT id, t, list(CAST(ceil(v) AS INTEGER) ORDER BY j) AS h FROM {pos} GROUP BY id, t)"
XKEY, QKEY = KEYS.format(out="xkey", pos="xpos"), KEYS.format(out="qkey", pos="qpos")
FOUND = "found AS (SELECT DISTINCT qkey.id AS qid, xkey.id AS vec_id FROM qkey JOIN xkey ON qkey.t = xkey.t AND qkey.h = xkey.h)"
HASHED = (B, Q, PROJ, XPOS, QPOS, XKEY, QKEY)


def long_hash(rows, key="vec_id"):
    out = rows.select(key, "table_id", F.posexplode("hash").alias("j", "h"))
    return out.select(key, F.col("table_id").cast("long").alias("table_id"), F.col("j").cast("long").alias("j"), F.col("h").cast("long").alias("h"))


@query("e2lsh_hash", with_(B, PROJ, XPOS) + "SELECT id AS vec_id, t AS table_id, j, CAST(ceil(v) AS BIGINT) AS h FROM xpos")
def e2lsh_hash(spark, sf):
    return long_hash(L.build(base(spark, sf), LSH))


TRUNC = "{out} AS (SELECT {id} AS id, t, list(CAST(trunc(round((p + s) / 0.75::DOUBLE, 9)) AS INTEGER) ORDER BY j) AS h FROM (SELECT {id}, t, j, sum(a * {v}) AS p FROM {table} JOIN proj USING (i) GROUP BY 1, t, j) JOIN (SELECT t, s FROM offs WHERE j = 0) USING (t) GROUP BY 1, t)"
XTRUNC, QTRUNC = TRUNC.format(out="xkey", id="vec_id", v="x", table="b"), TRUNC.format(out="qkey", id="qid", v="q", table="q")


@query("e2lsh_hash_trunc", with_(B, PROJ, XTRUNC) + "SELECT id AS vec_id, unnest([0, 1]) AS j, CAST(unnest(h) AS BIGINT) AS h FROM xkey WHERE t = 0")
def e2lsh_hash_trunc(spark, sf):
    rows = base(spark, sf).select("vec_id", F.posexplode(LSH.hash_truncated(F.col("x"))).alias("j", "h"))
    return rows.select("vec_id", F.col("j").cast("long").alias("j"), F.col("h").cast("long").alias("h"))


@query("e2lsh_lookup", with_(*HASHED, FOUND) + "SELECT * FROM found")
def e2lsh_lookup(spark, sf):
    return L.lookup(L.build(base(spark, sf), LSH), L.home_keys(queries(spark, sf), LSH))


@query("candidate_union", with_(*HASHED, FOUND, PREFIX) + "SELECT * FROM found UNION SELECT * FROM prefix")
def candidate_union(spark, sf):
    return e2lsh_lookup(spark, sf).union(J.prefix_search(base(spark, sf), queries(spark, sf), 8)).distinct()


@query("candidate_intersect", with_(*HASHED, FOUND, HITS) + "SELECT * FROM found INTERSECT SELECT * FROM hits")
def candidate_intersect(spark, sf):
    return e2lsh_lookup(spark, sf).intersect(J.interval_search(base(spark, sf), queries(spark, sf), D))


#: Boxes a hundredth as wide, so that only some boundaries are crossed.
NARROW = Q_HALF.replace("CAST(0.5 AS FLOAT)", "CAST(0.01 AS FLOAT)")
REACHES = "reaches AS (SELECT qid AS id, t, j, sum(abs(a) * rg) / 0.75::DOUBLE AS s FROM q JOIN proj USING (i) GROUP BY qid, t, j)"
OPTIONS = """opts AS (SELECT id, t, j, unnest(list_filter([ceil(v), CASE WHEN ceil(round(v - s, 9)) < ceil(v) THEN ceil(v) - 1 END, CASE WHEN ceil(round(v + s, 9)) > ceil(v) THEN ceil(v) + 1 END], lambda k: k IS NOT NULL)) AS k FROM qpos JOIN reaches USING (id, t, j)),
qkey AS (SELECT o.id, o.t, [CAST(o.k AS INTEGER), CAST(p.k AS INTEGER)] AS h FROM opts o JOIN opts p ON o.id = p.id AND o.t = p.t AND o.j = 0 AND p.j = 1)"""


@query("e2lsh_multiprobe", with_(B, NARROW, PROJ, XPOS, QPOS, XKEY, REACHES, OPTIONS, FOUND) + "SELECT * FROM found")
def e2lsh_multiprobe(spark, sf):
    return L.lookup(L.build(base(spark, sf), LSH), L.probe_keys(queries(spark, sf, 0.01), LSH))


#: Boxes whose widest dimension is three times as wide as the next.
SPLIT_Q = "q AS (SELECT vec_id AS qid, i, x AS q, CAST(CASE WHEN i = 0 THEN 1.2 ELSE 0.4 END AS DOUBLE) AS rg FROM b WHERE vec_id % 100 = 0)"
CENTRES = "centres AS (SELECT qid * 10 + part AS id, qid, i, CASE WHEN i = 0 THEN q - 1.2::DOUBLE + (2 * part - 1) * 1.2::DOUBLE / 3 ELSE CAST(q AS DOUBLE) END AS c FROM q, (VALUES (1), (2), (3)) AS p(part))"


@query(
    "e2lsh_split",
    with_(B, SPLIT_Q, CENTRES, PROJ, XPOS, POS.format(out="qpos", id="id", v="c", table="centres"), XKEY, QKEY, HITS)
    + "SELECT DISTINCT c.qid, xkey.id AS vec_id FROM qkey JOIN xkey ON qkey.t = xkey.t AND qkey.h = xkey.h JOIN (SELECT DISTINCT id, qid FROM centres) c ON c.id = qkey.id JOIN hits ON hits.qid = c.qid AND hits.vec_id = xkey.id",
)
def e2lsh_split(spark, sf):
    rg = F.transform(V.dims(D), lambda i: F.when(i == 0, F.lit(1.2)).otherwise(F.lit(0.4)))
    q = queries(spark, sf).withColumn("rg", rg)
    found = L.lookup(L.build(base(spark, sf), LSH), L.home_keys(L.split_range(q, 1, D), LSH))
    return J.refine(found, base(spark, sf), q, D)


@query("lsh_stats", with_(B, PROJ, XPOS, XKEY, "n AS (SELECT t AS table_id, count(DISTINCT h) AS buckets FROM xkey GROUP BY t)") + "SELECT table_id, buckets, round((SELECT avg(buckets) FROM n), 6) AS mean_buckets FROM n")
def lsh_stats(spark, sf):
    out = L.table_stats(L.build(base(spark, sf), LSH))
    return out.select(F.col("table_id").cast("long").alias("table_id"), "buckets", F.round("mean_buckets", 6).alias("mean_buckets"))


@query("lsh_multitable", with_(B, Q, PROJ, XTRUNC, QTRUNC, FOUND) + "SELECT * FROM found")
def lsh_multitable(spark, sf):
    index = L.hash_rows(base(spark, sf), lambda t: LSH.hash_truncated(F.col("x"), t), LSH.tables, "vec_id")
    return L.lookup(index, L.hash_rows(queries(spark, sf), lambda t: LSH.hash_truncated(F.col("q"), t), LSH.tables, "qid"))


@query(
    "lsh_ranked_probe",
    with_(
        B,
        Q,
        PROJ,
        XTRUNC,
        QTRUNC,
        "bk AS (SELECT h, count(*) AS n FROM xkey WHERE t = 0 GROUP BY h)",
        "d AS (SELECT qkey.id AS qid, bk.h, n, abs(bk.h[1] - qkey.h[1]) + abs(bk.h[2] - qkey.h[2]) AS dist FROM bk, qkey WHERE qkey.t = 0)",
        "r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY dist, h[1], h[2] ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)",
    )
    + "SELECT qid, xkey.id AS vec_id FROM r JOIN xkey ON xkey.t = 0 AND xkey.h = r.h WHERE before < 50",
)
def lsh_ranked_probe(spark, sf):
    return L.ranked_probe(base(spark, sf), queries(spark, sf), LSH, 50)


SPROJ = values("sproj(t, j, i, a)", SIGNS.projections)
SKEY = "{out} AS (SELECT id, t, CAST(sum(CASE WHEN p > 0 THEN 1 << (7 - j) ELSE 0 END) AS BIGINT) AS h FROM (SELECT {id} AS id, t, CAST(j AS INTEGER) AS j, round(sum(a * {v}), 9) AS p FROM {table} JOIN sproj USING (i) GROUP BY 1, t, j) GROUP BY id, t)"
XS, QS = SKEY.format(out="xkey", id="vec_id", v="x", table="b"), SKEY.format(out="qkey", id="qid", v="q", table="q")


@query("srp_hash", with_(B, SPROJ, XS) + "SELECT id AS vec_id, t AS table_id, h FROM xkey")
def srp_hash(spark, sf):
    out = L.build_signs(base(spark, sf), SIGNS)
    return out.select("vec_id", F.col("table_id").cast("long").alias("table_id"), F.col("hash").alias("h"))


@query("srp_sign", with_(B, SPROJ) + "SELECT vec_id, j, CAST(sign(round(sum(a * x), 9)) AS BIGINT) AS s FROM b JOIN sproj USING (i) WHERE t = 0 GROUP BY vec_id, j")
def srp_sign(spark, sf):
    rows = base(spark, sf).select("vec_id", F.posexplode(SIGNS.signs(F.col("x"))).alias("j", "s"))
    return rows.select("vec_id", F.col("j").cast("long").alias("j"), F.col("s").cast("long").alias("s"))


@query("srp_lookup", with_(B, Q, SPROJ, XS, QS, FOUND) + "SELECT * FROM found")
def srp_lookup(spark, sf):
    keys = L.hash_rows(queries(spark, sf), lambda t: SIGNS.key(F.col("q"), t), SIGNS.tables, "qid")
    return L.lookup(L.build_signs(base(spark, sf), SIGNS), keys)


@query(
    "srp_hamming",
    with_(B, Q, values("lproj(t, j, i, a)", LONG_SIGNS.projections), "xs AS (SELECT vec_id, j, sign(round(sum(a * x), 9)) AS s FROM b JOIN lproj USING (i) GROUP BY vec_id, j)", "qs AS (SELECT qid, j, sign(round(sum(a * q), 9)) AS s FROM q JOIN lproj USING (i) GROUP BY qid, j)")
    + "SELECT qid, vec_id, round(avg(CASE WHEN xs.s <> qs.s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS dist FROM xs JOIN qs USING (j) GROUP BY qid, vec_id",
)
def srp_hamming(spark, sf):
    b = base(spark, sf).select("vec_id", LONG_SIGNS.signs(F.col("x")).alias("x"))
    q = queries(spark, sf).select("qid", LONG_SIGNS.signs(F.col("q")).alias("q"))
    return J.theta_join(b, q, lambda: F.lit(True)).select("qid", "vec_id", F.round(DI.hamming(F.col("x"), F.col("q")), 6).alias("dist"))


WSRP = (
    B,
    Q,
    values("tproj(t, j, i, a)", TRIG_SIGNS.projections),
    "mean AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM b GROUP BY i)",
    "top AS (SELECT i, max(abs(x - m)) AS s FROM b JOIN mean USING (i) GROUP BY i)",
    "xm AS (SELECT vec_id, i, (x - m) / s AS v FROM b JOIN mean USING (i) JOIN top USING (i))",
    "qm AS (SELECT qid, i, (q - m) / s AS v, rg FROM q JOIN mean USING (i) JOIN top USING (i))",
    "xt AS (SELECT vec_id, i, cos(v) AS v FROM xm UNION ALL SELECT vec_id, i + 64, sin(v) FROM xm)",
    "qt AS (SELECT qid, i, rg * cos(v) AS v FROM qm UNION ALL SELECT qid, i + 64, rg * sin(v) FROM qm)",
    "xkey AS (SELECT vec_id, list(p > 0 ORDER BY j) AS h FROM (SELECT vec_id, j, round(sum(a * v), 9) AS p FROM xt JOIN tproj USING (i) GROUP BY vec_id, j) GROUP BY vec_id)",
    "qkey AS (SELECT qid, list(p > 0 ORDER BY j) AS h FROM (SELECT qid, j, round(sum(a * v), 9) AS p FROM qt JOIN tproj USING (i) GROUP BY qid, j) GROUP BY qid)",
    HITS,
)


@query("wsrp_lookup", with_(*WSRP) + "SELECT qkey.qid, xkey.vec_id, hits.vec_id IS NOT NULL AS hit FROM qkey JOIN xkey USING (h) LEFT JOIN hits ON hits.qid = qkey.qid AND hits.vec_id = xkey.vec_id")
def wsrp_lookup(spark, sf):
    """Weighted sign hashes of base and queries, both moved by the base's mean and scale; hits by the original coordinates."""
    b, q = base(spark, sf), queries(spark, sf)
    mean = ST.means(b, D)
    scale = ST.largest(b.withColumn("x", ST.shifted(F.col("x"), mean)), D)
    moved = lambda c: ST.divided(ST.shifted(F.col(c), mean), scale)
    index = L.build_signs(b.select("vec_id", V.trig(moved("x")).alias("x")), TRIG_SIGNS)
    keys = L.hash_rows(q.select("qid", V.trig_weighted(moved("q"), F.col("rg")).alias("q")), lambda t: TRIG_SIGNS.key(F.col("q"), t), 1, "qid")
    found = L.lookup(index, keys)
    rows = found.join(b, "vec_id").join(q, "qid")
    return rows.select("qid", "vec_id", in_box(F.col("x"), F.col("q"), F.col("rg"), D).alias("hit"))


RECALL = """SELECT round(avg(h / n), 9) AS recall, round(avg(CASE WHEN p > 0 THEN h / p END), 9) AS precision, round(sum(h) / sum(n), 9) AS overall_recall, round(avg(p), 9) AS mean_probed FROM (
  SELECT t.qid, CAST(count(*) AS DOUBLE) AS n, CAST(count(f.vec_id) AS DOUBLE) AS h, any_value(coalesce(pr.p, 0)) AS p
  FROM hits t LEFT JOIN found f ON f.qid = t.qid AND f.vec_id = t.vec_id LEFT JOIN (SELECT qid, CAST(count(*) AS DOUBLE) AS p FROM found GROUP BY qid) pr ON pr.qid = t.qid GROUP BY t.qid)"""


def measured(spark, sf, found):
    """Recall and precision of candidates (qid, vec_id) against the exact box search."""
    q = queries(spark, sf)
    truth = J.interval_search(base(spark, sf), q, D)
    probed = found.groupBy("qid").agg(F.count("*").alias("probed"))
    out = M.recall_precision(q, truth, found.join(truth, ["qid", "vec_id"]), probed)
    return out.select(*[F.round(c, 9).alias(c) for c in ("recall", "precision", "overall_recall", "mean_probed")])


@query("e2lsh_recall", with_(*HASHED, FOUND, HITS) + RECALL)
def e2lsh_recall(spark, sf):
    return measured(spark, sf, e2lsh_lookup(spark, sf).distinct())


@query("srp_recall", with_(B, Q, SPROJ, XS, QS, FOUND, HITS) + RECALL)
def srp_recall(spark, sf):
    return measured(spark, sf, srp_lookup(spark, sf).distinct())
