"""Every query of the vector engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from boxloom.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if v is None or isinstance(v, (str, bool)):
        return v
    return None if math.isnan(float(v)) else float(v)


def rows(columns, data, fractions):
    """Rows as (values of columns without fractions, fractions), columns in order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in data:
        values = [(columns[i], plain(r[i])) for i in order]
        out.append(([str(v) for c, v in values if c not in fractions], [v for c, v in values if c in fractions]))
    return out


def same(a, b):
    """Whether rows agree one by one: other values exactly, fractions as far as engines agree.  Rows with equal other
    values are put in order of their fractions."""
    if len(a) != len(b):
        return False
    key = lambda x: (x[0], [(v is None, v or 0.0) for v in x[1]])
    close = lambda u, v: (u is None) == (v is None) and (u is None or abs(u - v) <= 2e-4 * max(1.0, abs(u)))
    return all(x[0] == y[0] and all(map(close, x[1], y[1])) for x, y in zip(sorted(a, key=key), sorted(b, key=key), strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    fractions = {c for c, kind in df.dtypes if kind in ("double", "float")}
    assert same(rows(df.columns, df.collect(), fractions), rows(list(found.columns), found.df().astype(object).values.tolist(), fractions))


@pytest.fixture(scope="module")
def many_vectors(spark, tmp_path_factory):
    """A folder with more embeddings than a sketch of quantiles tells apart."""
    folder = str(tmp_path_factory.mktemp("many"))
    x = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.xxhash64("id", i) / 2.0**64).cast("float"))
    spark.range(220_000).select(F.col("id").alias("vec_id"), x.alias("embedding")).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["kd_traverse", "rtree_insert"])
def test_boxes_of_many_rows_equal_sql(spark, many_vectors, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{many_vectors}/embeddings.parquet/*.parquet'")
    found = con.sql(SQL[name])
    order = [F.col(c) for c in found.columns]
    expected = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in QUERIES[name](spark, many_vectors).select(*order).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
