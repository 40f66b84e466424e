"""The queries of the subpackage against their SQL, and what the contract fixes of the others, on the smallest tables."""

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxloom.llm import html_extraction as HX
from boxloom.llm import language_id as LI
from boxloom.llm import sentencepiece_codec as SP
from boxloom.llm import token_files
from boxloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    found = con.sql(SQL[name])
    names = list(found.columns)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, (float, np.integer)) else v
    want = sorted(str([plain(v) for v in row]) for row in found.df().astype(object).values.tolist())
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([plain(v) for v in row]) for row in df.select(*names).collect()) == want


def test_every_operator_has_a_query(spark, sf_dir):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    for name, query in QUERIES.items():
        if name not in SQL:
            rows = query(spark, sf_dir)
            assert rows.count() == (pages if "page_id" in rows.columns else docs).count()


def test_token_query(spark, sf_dir):
    code, at = Tokenizer.from_file(token_files.default_tokenizer()), 0
    got = {r["doc_id"]: r for r in QUERIES["op6_token_files"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect():
        ids = code.encode(r["text"], add_special_tokens=False).ids + [2]
        x = got[r["doc_id"]]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)


def test_quality_query_follows_the_contract(spark, sf_dir):
    got = QUERIES["op10_quality_rules"](spark, sf_dir).toPandas()
    failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
    assert (failed == got["base_failed"]).all() and not (failed & got["kept"]).any()


def test_sentencepiece_query_equals_the_library(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SP.default_model())
    got = {r["doc_id"]: r for r in QUERIES["op1_sentencepiece"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        ids = library.encode(text)
        assert (got[key]["n_ids"], got[key]["ids_crc32"]) == (len(ids), zlib.crc32(" ".join(map(str, ids)).encode()))
        assert got[key]["round_trip"] == (library.decode(ids) == text), text[:80]


def test_language_query_equals_its_model_on_each_text(spark, sf_dir):
    """The split by its definition; every text scored alone, by a model that never saw the held-out documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    model = LI.train(spark.createDataFrame([r for r in rows if not held[r["doc_id"]]], docs.schema))
    got = {r["doc_id"]: r for r in QUERIES["op8_language_id"](spark, sf_dir).collect()}
    assert {k: r["held_out"] for k, r in got.items()} == held
    for r in rows:
        names, scores = model.predict([r["text"] or ""])
        want = (names[0], float(scores[0])) if r["text"] and LI.has_letter(r["text"]) else ("und", 0.0)
        assert got[r["doc_id"]]["lang_pred"] == want[0] and abs(got[r["doc_id"]]["score"] - want[1]) < 1e-5
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if held[r["doc_id"]] and r["lang"] and r["text"] and LI.has_letter(r["text"])]
    assert np.mean(right) > 0.95


def test_extraction_query_equals_each_page_alone(spark, sf_dir):
    got = {r["page_id"]: r for r in QUERIES["op9_html_extraction"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        text = HX.extract([r["html"]], *HX.model())[0]
        x = got[r["page_id"]]
        assert (x["url"], x["text"], x["n_chars"]) == (r["url"], text, len(text))
        assert not any(mark in text for mark in ("<p", "<div", "<script", "\t", "  "))
