"""Operators against NumPy brute force, and the edge cases that the tables do not hold."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxloom.functions import distance as D
from boxloom.functions import vectors as V
from boxloom.functions.hashing import E2Lsh
from boxloom.functions.predicates import in_box
from boxloom.operators import joins as J
from boxloom.operators import lsh as L
from boxloom.operators import maintenance as MT
from boxloom.operators import metrics as M
from boxloom.operators import multiindex as I
from boxloom.operators import pairs as X
from boxloom.operators import quantize as Z
from boxloom.operators import ranking as R
from boxloom.operators import workload as W
from boxloom.sources import text as TX
from boxloom.sources import vecs as VS
from boxloom.sources.shared import shared_path

DIM = 6


def vectors(spark, x, name="x", key="vec_id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{key} long, {name} array<float>")


def query_frame(spark, q, rg):
    return spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(q, rg, strict=True))], "qid long, q array<float>, rg array<float>")


@pytest.fixture(scope="module")
def sample(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(120, DIM)).astype("f4")
    q, rg = x[:7] + np.float32(0.1), r.uniform(0.4, 2.0, size=(7, DIM)).astype("f4")
    return x, q, rg, vectors(spark, x).cache(), query_frame(spark, q, rg).cache()


def brute(x, q, rg):
    return {(i, j) for i in range(len(q)) for j in range(len(x)) if (np.abs(x[j] - q[i]) <= rg[i]).all()}


def pairs(df):
    return {tuple(r) for r in df.select("qid", "vec_id").collect()}


def test_access_paths_agree(sample):
    x, q, rg, base, queries = sample
    truth = brute(x, q, rg)
    assert truth
    assert pairs(J.interval_search(base, queries, DIM)) == truth
    assert pairs(J.theta_join(base, queries, lambda: ~F.exists(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.abs(F.col("x")[i] - F.col("q")[i]) > F.col("rg")[i]), limit=2)) == truth
    for axes, cell in (([0], 0.5), ([1, 4], 2.0), ([0, 1, 2], 0.3)):
        found = J.grid_search(base, queries, axes, cell, DIM)
        assert pairs(found) == truth and found.count() == len(truth)
    for most in (1, 7, 40):
        found = J.grid_search(base, queries, [0, 1], 0.3, DIM, most)
        assert pairs(found) == truth and found.count() == len(truth)
    assert pairs(J.prefix_filter_refine(base, queries, 2, DIM)) == truth
    assert pairs(J.prefix_search(base, queries, 2)) >= truth
    dims = queries.withColumn("dims", V.dims(DIM))
    assert pairs(J.sparse_search(base, dims)) == truth


def test_grid_search_in_a_fresh_session(sf_dir):
    """As a session's first query, whose columns have the smallest ids."""
    code = f"""
from pyspark.sql import SparkSession
from boxloom.plans.registry import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows:", QUERIES["grid_search"](spark, {sf_dir!r}).count())
"""
    root = Path(__file__).resolve().parent.parent
    own = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=own | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=300)
    assert "rows: 83" in done.stdout, done.stderr[-2000:]


def test_boundary_zero_negative_and_empty(spark):
    base = vectors(spark, [[1.5, 0], [1.0, 0], [3.0, 0]])
    queries = query_frame(spark, [[1, 0]] * 4, [[0.5, 0], [0, 0], [-1, 0], [0.4, 0]])
    assert pairs(J.interval_search(base, queries, 2)) == {(0, 0), (0, 1), (1, 1), (3, 1)}
    none = J.interval_search(base.limit(0), queries, 2)
    assert none.count() == 0 and J.interval_search(base, queries.limit(0), 2).count() == 0
    sizes = {r["qid"]: r["n"] for r in M.sizes(queries, J.interval_search(base, queries, 2), "n").collect()}
    assert sizes == {0: 2, 1: 1, 2: 0, 3: 1}


def test_ingest_rule(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, None]), (2, [1.0, float("nan")]), (3, [1.0]), (4, None)], "vec_id long, x array<float>")
    assert [r[0] for r in rows.where(V.valid(F.col("x"), 2)).collect()] == [0]


def test_zero_width_distance(spark):
    row = spark.createDataFrame([([1.0, 2.0], [1.0, 3.0], [0.0, 0.5], [1.0, 0.0])], "x array<float>, q array<float>, w array<float>, z array<float>")
    got = row.select(D.weighted_dense(F.col("x"), F.col("q"), F.col("w"), 2, 2), D.weighted_dense(F.col("x"), F.col("q"), F.col("z"), 2, 2)).first()
    assert got[0] == 4.0 and got[1] == float("inf")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_inner_product_equals_distance(spark, seed):
    r = np.random.default_rng(seed)
    x, q, w = r.normal(size=(3, 4))
    w = np.abs(w) + 0.3
    row = spark.createDataFrame([(x.tolist(), q.tolist(), w.tolist())], "x array<double>, q array<double>, w array<double>")
    left, right = V.inner_product_sides(F.col("x"), F.col("q"), F.col("w"), 4)
    got = row.select(V.dot(left, right)).first()[0]
    assert -got == pytest.approx((np.abs((x - q) / w) ** 4).sum(), rel=1e-6, abs=1e-6)


def test_split_dims():
    assert [n for _, n in V.split_dims(64, 5)] == [13, 13, 13, 13, 12]
    assert V.split_dims(6, 2) == [(0, 3), (3, 3)]


def test_rank_all_and_top_k(spark):
    rows = spark.createDataFrame([(q, v, float((v * 7) % 5)) for q in range(3) for v in range(40)], "qid long, vec_id long, s double")
    got = {(r["qid"], r["vec_id"]): r["rank"] for r in R.rank_all(rows, "s", buckets_per_unit=0.4).collect()}
    for q in range(3):
        order = sorted(range(40), key=lambda v: ((v * 7) % 5, v))
        assert [got[q, v] for v in order] == list(range(1, 41))
    assert R.top_k(rows, "s", 4).count() == 12


def test_scored_pairs_and_their_recall(spark, monkeypatch):
    """Tiles equal the column expressions; recall from buckets equals recall from the whole ranking, with ties, copies,
    widths of zero and below, queries in blocks, a query without hits and one with nearly all rows."""
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(400, DIM)), 1).astype("f4")
    x[100:180] = x[3]
    rg = r.uniform(0.8, 2.5, size=(9, DIM)).astype("f4")
    rg[1, 2], rg[2, 0], rg[3] = 0, -1, 9
    base, queries = vectors(spark, x).coalesce(1).cache(), query_frame(spark, x[:9], rg).cache()
    c, values = F.col, ("qid", "vec_id", "dist", "hit")
    plain = base.crossJoin(queries).select("qid", "vec_id", F.round(D.weighted_dense(c("x"), c("q"), c("rg"), 2, DIM), 9).alias("dist"), in_box(c("x"), c("q"), c("rg"), DIM).alias("hit")).cache()
    truth = plain.where("hit")
    wanted = {r["t"]: (r["recall"], r["precision"]) for r in R.recall_at(R.rank_all(plain, "dist"), truth, 400).collect()}
    monkeypatch.setattr(X, "TASK_PAIRS", 1_000)
    monkeypatch.setattr(X, "TILE_ROWS", 100)
    for limit in (20_000, 4):
        monkeypatch.setattr(J, "BROADCAST_QUERIES", limit)
        scored = X.scored(base, queries, DIM)
        assert scored.rdd.getNumPartitions() > 1
        assert sorted(scored.select(*values).collect()) == sorted(plain.select(*values).collect())
        for width in (0.01, 0.5, 16.0):
            found = R.recall_of_scored(scored, 400, buckets_per_unit=width).collect()
            assert len(found) == len(wanted) == 10
            assert all((row["recall"], row["precision"]) == pytest.approx(wanted[row["t"]], abs=1e-12) for row in found)


def test_pq_paths(sample):
    x, q, rg, base, queries = sample
    pq = Z.PQ(2, 8).fit(base, DIM, steps=2)
    truth = brute(x, q, rg)
    codes = I.build(base, pq.book)
    got = np.array([r["code"] for r in codes.orderBy("vec_id").collect()])
    expect = np.stack([((x[:, None, f : f + n] - c[None]) ** 2).sum(-1).round(9).argmin(1) for (f, n), c in zip(pq.book.parts, pq.book.centroids, strict=True)], 1)
    assert (got == expect).all()
    again = base.withColumn("x", pq.compress(F.col("x"))).withColumn("c", pq.encode(F.col("x"))).join(codes.select("vec_id", "code"), "vec_id")
    assert again.where("c <> code").count() == 0  # decode then encode gives the same code
    reach = I.reachable(queries, I.boxes(I.bucket_bounds(codes, pq.book)), pq.book)
    passed = I.pq_filtered(codes, queries, reach, 2)
    assert pairs(passed) >= truth and pairs(I.hits(passed.select("qid", "vec_id", "x"), queries, DIM)) == truth
    met = I.reachable_cells(codes, reach)
    assert pairs(I.hits(I.members(met, codes), queries, DIM)) == truth


def test_probe_stop_rules(sample):
    x, q, rg, base, queries = sample
    book = Z.first_rows(base, 6, V.split_dims(DIM, 2))
    codes = I.build(base, book)
    ranked = I.ranked_cells(codes, queries, book)
    cells = {}
    for r in ranked.orderBy("qid", "place").collect():
        cells.setdefault(r["qid"], []).append(r)
    hits = {(r["qid"], r["k0"], r["k1"]): r["hits"] for r in J.interval_search(base, queries, DIM).join(codes, "vec_id").groupBy("qid", "k0", "k1").agg(F.count("*").alias("hits")).collect()}
    by_cell = J.interval_search(base, queries, DIM).join(codes, "vec_id").groupBy("qid", "k0", "k1").agg(F.count("*").alias("hits"))
    for t in (1, 10, 50, 10_000):
        want = set()
        for qid, row in cells.items():
            probed = 0
            for r in row:
                if probed >= t:
                    break
                probed += r["n"]
                want.add((qid, r["k0"], r["k1"]))
        assert {(r["qid"], r["k0"], r["k1"]) for r in I.probed_top_k(ranked, t).collect()} == want
    for least, precision in ((5, 0.2), (20, 0.9), (0, 0.0)):
        want = set()
        for qid, row in cells.items():
            probed = valid = 0
            for r in row:
                if probed > least and valid / probed < precision:
                    break
                probed += r["n"]
                valid += hits.get((qid, r["k0"], r["k1"]), 0)
                want.add((qid, r["k0"], r["k1"]))
        assert {(r["qid"], r["k0"], r["k1"]) for r in I.probed_precision(ranked, by_cell, precision, least).collect()} == want


def test_residual_rotated_and_norm_explicit(sample):
    x, _, _, base, _ = sample
    errors = []
    for layers in (1, 2):
        rq = Z.RQ([Z.PQ(2, 8) for _ in range(layers)]).fit(base, DIM, steps=2)
        errors.append(base.agg(F.avg(D.squared(F.col("x"), rq.compress(F.col("x"))))).first()[0])
    assert errors[1] < errors[0]
    opq = Z.OPQ(2, 8).fit(base, DIM, rotations=2, steps=2)
    assert np.allclose(opq.rotation @ opq.rotation.T, np.eye(DIM), atol=1e-6)
    assert base.agg(F.avg(D.squared(F.col("x"), opq.compress(F.col("x"))))).first()[0] < np.var(x, 0).sum()
    for method in ("kmeans", "kmeans_partial", "percentile", "uniform", "exponential"):
        neq = Z.NEQ(8, Z.PQ(2, 8), method).fit(base, DIM, steps=2)
        k = [r[0] for r in base.select(neq.encode_norm(F.round(neq.corrected(F.col("x")), 9))).collect()]
        assert 0 <= min(k) and max(k) == 7
        assert base.agg(F.avg(D.squared(F.col("x"), neq.compress(F.col("x"))))).first()[0] < 2 * np.var(x, 0).sum()


def test_weighted_means_and_empty_cluster(spark):
    base = vectors(spark, [[0.0], [1.0], [10.0]])
    book = Z.Codebook([(0, 1)], [np.array([[0.4], [9.0], [500.0]])])
    plain, radius = Z.lloyd(base, book), Z.lloyd(base, book, "cluster_radius")
    assert plain.centroids[0].ravel().tolist() == [0.5, 10.0, 500.0]
    assert radius.centroids[0].ravel().tolist() == pytest.approx([(0 * 0.4 + 1 * 0.6) / 1.0, 10.0, 500.0])
    assert Z.newton(base, Z.Codebook(book.parts, book.centroids, 1)).centroids[0].tolist() == book.centroids[0].tolist()
    with pytest.raises(ValueError):
        Z.newton(base, Z.Codebook(book.parts, book.centroids, 5))


def test_lsh_multiprobe_is_between(sample):
    _, _, _, base, queries = sample
    lsh = E2Lsh(DIM, functions=2, r=1.0, tables=2)
    index = L.build(base, lsh)
    home, probes = pairs(L.lookup(index, L.home_keys(queries, lsh))), pairs(L.lookup(index, L.probe_keys(queries, lsh)))
    assert home <= probes
    refined = pairs(J.refine(L.lookup(index, L.probe_keys(queries, lsh)), base, queries, DIM))
    assert refined <= pairs(J.interval_search(base, queries, DIM))


def test_trained_rotation_equals_numpy(spark, sf_dir):
    """The query opq_fit by its definition: k-means steps, Procrustes rotation, k-means steps."""
    from boxloom.plans import fixtures as X
    from boxloom.plans.registry import QUERIES

    table = sorted(X.base(spark, sf_dir).collect())
    x = np.array([r["x"] for r in table], float)
    parts = V.split_dims(X.D, X.PARTS)

    def codes(y, books):
        far = [np.round(((y[:, None, f : f + n] - b) ** 2).sum(2), Z.DIGITS) for (f, n), b in zip(parts, books, strict=True)]
        return np.stack([d.argmin(1) for d in far], 1)

    def decoded(code, books):
        return np.hstack([b[code[:, m]] for m, b in enumerate(books)])

    def trained(y, steps):
        books = [y[: X.KS, f : f + n].copy() for f, n in parts]
        for _ in range(steps):
            code = codes(y, books)
            for m, (f, n) in enumerate(parts):
                for k in set(code[:, m]):
                    books[m][k] = y[code[:, m] == k, f : f + n].mean(0)
        return books

    books = trained(x, 1)
    moments = x.T @ decoded(codes(x, books), books)
    turn = Z.procrustes(moments, np.eye(X.D))
    fit = (turn * moments).sum()
    assert np.allclose(turn @ turn.T, np.eye(X.D)) and np.isclose(fit, np.linalg.svd(moments)[1].sum(), atol=1e-3)
    noise = np.random.default_rng(1).normal(size=moments.shape) * 1e-15
    assert np.allclose(Z.procrustes(moments + noise, np.eye(X.D)), turn, atol=1e-6)
    books = trained(x @ turn, 2)
    code = codes(x @ turn, books)
    error = ((x - decoded(code, books) @ turn.T) ** 2).sum(1)
    got = {r["vec_id"]: r for r in QUERIES["opq_fit"](spark, sf_dir).collect()}
    assert [got[r["vec_id"]]["code"] for r in table] == code.tolist()
    assert np.allclose([got[r["vec_id"]]["error"] for r in table], error, atol=1e-5)


def test_find_scale_counts(sample):
    x, q, rg, base, queries = sample
    for r in W.find_scale(base, queries, 5, 9, DIM).collect():
        count = (np.abs(x.astype(float) - q[r["qid"]]) <= r["scale"] * rg[r["qid"]].astype(float) * (1 + 1e-9)).all(1).sum()
        assert 5 <= r["n"] <= 10 and count == r["n"]


def test_find_percent():
    percent, size, reached = W.find_percent(lambda p: p * p / 10, 40.0)
    assert reached
    assert abs(size - 40) <= 2 and abs(percent - 20) < 1


def test_maintenance(spark):
    base = vectors(spark, [[1.0, 5.0], [0.5, 5.0], [0.5, 6.0]])
    assert MT.delete(base, base.where("vec_id = 1")).count() == 2
    assert MT.insert(base, base).count() == 6
    assert [(r["i"], r["vec_id"], r["v"]) for r in MT.find_min(base, 2).orderBy("i").collect()] == [(0, 1, 0.5), (1, 0, 5.0)]


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "bvecs"])
def test_vector_files(spark, tmp_path, kind):
    values = np.arange(12).reshape(4, 3)
    dtype = {"fvecs": "<f4", "ivecs": "<i4", "bvecs": "u1"}[kind]
    file = tmp_path / f"a.{kind}"
    file.write_bytes(b"".join(np.int32(3).tobytes() + row.astype(dtype).tobytes() for row in values))
    got = VS.read(spark, f"file://{file}", kind, 3, 4).orderBy("vec_id").collect()
    assert [list(r["x"]) for r in got] == values.tolist() and [r["vec_id"] for r in got] == [0, 1, 2, 3]
    file.write_bytes(file.read_bytes() + b"\0")
    with pytest.raises(Exception, match="whole number"):
        VS.read(spark, f"file://{file}", kind).count()
    with pytest.raises(ValueError):
        VS.read(spark, f"file://{file}", kind, 5)
    with pytest.raises(FileNotFoundError):
        VS.read(spark, f"file://{tmp_path}/none.{kind}", kind, 3)
    assert VS.exists(f"file://{file}") and not VS.exists(f"file://{tmp_path}/none")


def test_id_lists_and_logs(spark, tmp_path):
    lists = spark.createDataFrame([(0, [3, 1]), (1, [])], "qid long, ids array<long>")
    path = shared_path(spark, "lists")
    TX.write_id_lists(lists, path)
    assert {r["qid"]: list(r["ids"]) for r in TX.read_id_lists(spark, path).collect()} == {0: [3, 1], 1: []}
    (tmp_path / "plain.txt").write_text("1 2\n\n7\n")
    assert {r["qid"]: list(r["ids"]) for r in TX.read_plain_id_lists(spark, f"file://{tmp_path}/plain.txt").collect()} == {0: [1, 2], 1: [], 2: [7]}
    (tmp_path / "log.txt").write_text("# start\ntime\trecall\n1.5\t0.5\n2\t1\n")
    got = TX.read_metric_rows(spark, f"file://{tmp_path}/log.txt").orderBy("line", "name").collect()
    assert [(r["name"], r["value"]) for r in got] == [("recall", 0.5), ("time", 1.5), ("recall", 1.0), ("time", 2.0)]
    (tmp_path / "t.txt").write_text("1 2.5\n3 4\n")
    rows = TX.vectors_of(TX.read_table(spark, f"file://{tmp_path}/t.txt", ["id", "v"], " "), "id", ["v"])
    assert sorted(tuple(r["x"]) for r in rows.collect()) == [(2.5,), (4.0,)]
    one = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, time double")
    other = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "k string, time double")
    assert [r["k"] for r in TX.faster_than(one, other, ["k"]).collect()] == ["a"]


def test_queries_beyond_a_broadcast(spark, sf_dir, monkeypatch, tmp_path):
    """Blocks of queries give what one broadcast gives, in a batch and over a stream."""
    from boxloom.operators import joins as J
    from boxloom.plans.fixtures import D, base, queries
    from boxloom.streaming import search as S

    b, q = base(spark, sf_dir), base(spark, sf_dir).where("vec_id % 7 = 0").selectExpr("vec_id AS qid", "x AS q", "transform(x, v -> 0.36F) AS rg")
    want = sorted(map(tuple, J.interval_search(b, q, D).collect()))
    cut = J.theta_join(b, q, lambda: J.P.in_box(J.F.col("x"), J.F.col("q"), J.F.col("rg"), D), limit=20).select("qid", "vec_id")
    assert sorted(map(tuple, cut.collect())) == want and len(want) > 100
    q = queries(spark, sf_dir)
    whole = J.theta_join
    monkeypatch.setattr(S, "theta_join", lambda stream, rows, condition: whole(stream, rows, condition, limit=2))
    found = S.run_to_end(S.stream_interval_search(S.vectors(spark, sf_dir), q, D), f"file://{tmp_path}/found")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, J.interval_search(b, q, D).collect()))


def test_shapes_are_checked(spark, sf_dir):
    from boxloom.functions.vectors import checked
    from boxloom.plans.fixtures import D, base

    good = base(spark, sf_dir)
    assert checked(good, D).count() == good.count()
    bad = good.limit(3).unionByName(spark.createDataFrame([(1, [1.0]), (2, None), (3, [float("nan")] * D)], good.schema))
    with pytest.raises(ValueError, match="3 vectors"):
        checked(bad, D)


def test_bisection_says_whether_it_reached_its_target():
    from boxloom.operators import workload as W

    percent, size, reached = W.find_percent(lambda p: p * 2, 50.0)
    assert reached and abs(size - 50) <= 2.5 and size == 2 * percent
    assert W.find_percent(lambda p: 0.0 if p < 30 else 100.0, 50.0)[2] is False


def test_blocks_are_pruned(spark):
    """Clustered rows: a small box reaches one block of many."""
    from boxloom.operators import blocks as BL

    rows = spark.createDataFrame([(i, [float(i % 16), float(i // 16)]) for i in range(256)], "vec_id long, x array<float>")
    placed = BL.laid_out(rows, BL.kd_tree(rows, 4, 2))
    boxes = BL.bounds(placed, 2)
    assert boxes.count() == 16 and sum(r["n"] for r in boxes.collect()) == 256
    q = spark.createDataFrame([(7, [1.0, 1.0], [1.0, 1.0]), (8, [99.0, 0.0], [1.0, 1.0])], "qid long, q array<float>, rg array<float>")
    assert BL.reached(boxes, q, 2).count() == 1
    assert sorted(r["vec_id"] for r in BL.block_search(placed, boxes, q, 2).collect()) == [0, 1, 2, 16, 17, 18, 32, 33, 34]


def test_cuts_are_exact_medians_of_many_rows(spark):
    """More rows than a sketch of quantiles holds: both medians along each axis, level by level."""
    from boxloom.operators import blocks as BL

    n = 250_000
    parts = F.xxhash64("id") / 2**40, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(700)) / 7
    rows = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*parts).alias("x")).cache()
    x = np.array([r["x"] for r in rows.select("x").collect()])
    cuts, node = BL.kd_tree(rows, 4, 2).cuts, np.ones(n, int)
    for level in range(4):
        v = x[:, level % 2]
        for k in np.unique(node):
            assert cuts[k] == np.sort(v[node == k])[((node == k).sum() - 1) // 2]
        node = 2 * node + (v >= cuts[node])


def test_model_files_are_checked(spark, tmp_path):
    import numpy as np

    from boxloom.sources import models as MO

    MO.write_scale(spark, np.arange(1, 5), f"file://{tmp_path}/scale")
    assert MO.read_scale(spark, f"file://{tmp_path}/scale", 4).tolist() == [1, 2, 3, 4]
    for wrong in (lambda: MO.read_scale(spark, f"file://{tmp_path}/scale", 5), lambda: MO.read_codes(spark, f"file://{tmp_path}/scale", 2, 4)):
        with pytest.raises(Exception):
            wrong()
    centroids = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [3.0, 0.0])], "m int, k int, centroid array<float>")
    out = MO.scaled_centroids(centroids, np.array([2.0, 3.0, 4.0]), [(0, 2), (2, 1)])
    assert sorted(map(tuple, out.collect())) == [(0, 0, [2.0, 6.0]), (1, 0, [12.0, 0.0])]
