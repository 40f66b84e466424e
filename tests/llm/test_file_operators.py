"""SentencePiece coding, token files, WARC archives, HTML extraction and the pipeline: library results, round trips and
edge cases."""

import functools
import io
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from boxloom.llm import html_extraction as HX
from boxloom.llm import html_training as HT
from boxloom.llm import sentencepiece_codec as SP
from boxloom.llm import token_files as TF
from boxloom.llm import warc as WA
from boxloom.llm.common import fresh_path

ODD = [None, "", " ", "  a  ", "a\n\nb", "\ttab", "▁▁x", "😀漢字", "é" * 300, "x" * 900, "a b " * 400, "don't 12 ² ß × \x1c\x85\u00a0_|", "<s> </s> <unk> <|endoftext|>"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    parts = ["a", "b", "ing", " the", " ", "  ", "\n", ".", "é", "漢", "😀", "12", "***", "'s", "▁", "word", "Tion"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(n)]


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=SP.default_model())


def test_ids_equal_the_library(library):
    code = SP.encoder(SP.default_model())
    for text in [*filter(None, ODD), *random_texts(400), *(" " * n for n in range(40))]:
        assert np.frombuffer(code.whole(text), np.int32).tolist() == library.encode(text), text[:60]


@pytest.mark.parametrize("size", [32, 50, 200])
def test_chunks_equal_the_library(library, size):
    code = SP.encoder(SP.default_model())
    for text in [*filter(None, ODD), *filter(None, random_texts(150, 2)), "http://www.example.com/antidisestablishment" * 12]:
        chunks = list(SP.split(text, code.v.longest, size))
        matrices = [code.matrix(*c[1:]) for c in chunks]
        states = SP.best_states(matrices)
        assert (SP.START, SP.END) in functools.reduce(SP.product, matrices)
        got = b"".join(code.chunk(*c[1:], a, b) for c, (a, b) in zip(chunks, states, strict=True))
        assert np.frombuffer(got, np.int32).tolist() == library.encode(text)


def test_unigram_scores_by_brute_force():
    pieces = [("<unk>", 0.0, "unknown"), *((p, s, "normal") for p, s in [("▁", -3.0), ("a", -2.5), ("b", -2.7), ("▁a", -3.1), ("ab", -3.3), ("ba", -3.45), ("aba", -5.2), ("▁ab", -4.05), ("bb", -4.9)])]
    code = SP.Encoder(SP.Vocabulary(pieces, bpe=False))
    scores = {p: s for p, s, _ in pieces[1:]}

    def best(s):
        cuts = (c for n in range(len(s)) for c in itertools.combinations(range(1, len(s)), n))
        ways = ([s[i:j] for i, j in zip((0, *c), (*c, len(s)), strict=True)] for c in cuts)
        return max(sum(scores[p] for p in w) for w in ways if all(p in scores for p in w))

    r = random.Random(8)
    for _ in range(60):
        text = "".join(r.choice("ab") for _ in range(r.randint(1, 11)))
        ids = np.frombuffer(code.whole(text), np.int32)
        assert sum(pieces[i][1] for i in ids) == pytest.approx(best("▁" + text))
        for size in (6, 7):
            chunks = list(SP.split(text, code.v.longest, size))
            states = SP.best_states([code.matrix(*c[1:]) for c in chunks])
            got = np.frombuffer(b"".join(code.chunk(*c[1:], a, b) for c, (a, b) in zip(chunks, states, strict=True)), np.int32)
            assert sum(pieces[i][1] for i in got) == pytest.approx(best("▁" + text))


def test_products_are_associative():
    r = random.Random(3)
    ms = [{(a, b): r.random() for a in range(3) for b in range(3) if r.random() < 0.7} for _ in range(3)]
    left, right = SP.product(SP.product(ms[0], ms[1]), ms[2]), SP.product(ms[0], SP.product(ms[1], ms[2]))
    assert left.keys() == right.keys() and all(left[k] == pytest.approx(right[k]) for k in left)


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_tree_of_products_gives_the_states_of_the_fold(spark, library, monkeypatch, fan):
    monkeypatch.setattr(SP, "FAN", fan)
    code, texts = SP.encoder(SP.default_model()), [*random_texts(6, 9), "x" * 700, "http://www.example.com/antidisestablishment" * 9, "a"]
    matrices = [[code.matrix(*c[1:]) for c in SP.split(t, code.v.longest, 40)] for t in texts]
    rows = [(i, k, [a for a, _ in m], [b for _, b in m], list(m.values())) for i, ms in enumerate(matrices) for k, m in enumerate(ms)]
    frame = spark.createDataFrame(rows, "__row long, place long, entries array<long>, exits array<long>, weights array<double>").repartition(5)
    got = sorted(tuple(r[c] for c in ("__row", "place", "entry", "leaving")) for r in SP.path_states(frame).collect())
    assert got == [(i, k, a, b) for i, ms in enumerate(matrices) for k, (a, b) in enumerate(SP.best_states(ms))]
    assert max(map(len, matrices)) > 9


def test_spark_round_trip(spark, library):
    texts = [*ODD, *random_texts(30), "long text " * 3000, "long text " * 3000, "x" * 2000]
    rows = spark.createDataFrame([(i % 5, t, "old", i, i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, __row long, __chunk long")
    coded = SP.sentencepiece_encode(rows, SP.default_model(), chunk=256)
    got = SP.sentencepiece_decode(coded, SP.default_model()).collect()
    want = sorted((i % 5, t or "", library.encode(t) if t else []) for i, t in enumerate(texts))
    assert sorted((r["doc_id"], r["text"] or "", list(r["ids"])) for r in got) == want
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in got)
    assert SP.sentencepiece_encode(rows.limit(0), SP.default_model()).count() == 0
    with pytest.raises(ValueError):
        SP.sentencepiece_encode(rows, SP.default_model(), chunk=8)


# --- token files


def test_token_files(spark):
    texts = [*ODD, *random_texts(200, 5), "words and words " * 5000, "a <|endoftext|> b", "<|endoftext|>" * 3, " <|endoftext", "x\n\n<|endoftext|>  y "]
    rows = spark.createDataFrame([(None if i == 3 else 1000 - i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    code = Tokenizer.from_file(TF.default_tokenizer())
    folder = fresh_path(spark, "tokens")
    manifest = TF.write_token_files(rows, TF.default_tokenizer(), folder, length=64)
    got = sorted(TF.read_token_files(manifest).collect(), key=lambda r: r["start"])
    order = sorted(((None if i == 3 else 1000 - i, t) for i, t in enumerate(texts)), key=lambda r: (r[0] is not None, r[0] or 0))
    at, stream = 0, []
    for r, (key, text) in zip(got, order, strict=True):
        ids = code.encode(text or "", add_special_tokens=False).ids + [TF.END_ID]
        assert (r["key"], r["start"], r["n_ids"], r["ids_crc32"]) == (key, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
        stream += ids
    back = []
    for one in manifest.orderBy("start").collect():
        for n in range(-(-one["n_ids"] // 64)):
            ids, mask = TF.sequence(one["seq"], n)
            assert len(ids) == len(mask) == 64
            back += ids[mask].tolist()
    assert back == stream
    empty = TF.write_token_files(rows.limit(0), TF.default_tokenizer(), fresh_path(spark, "tokens"))
    assert TF.read_token_files(empty).count() == 0


def test_pieces_equal_the_library(monkeypatch):
    """Texts cut at spaces, with odd white space, signs, foreign letters and a special token, also while caches are
    cleared; of pieces seen before nothing is cut again."""
    code, r = TF.TextEncoder(TF.default_tokenizer()), random.Random(5)
    monkeypatch.setattr(TF, "CACHE_PIECES", 50)
    signs = [*" " * 8, *"abXY'éñд本19.,!?-_\n\t\r\x0b\x1c\x1f\x85\xa0\u3000\u200b²́😀", "'s", "word", " the", "<|endoftext|>", "\n\n", " \n", "  "]
    for text in ["", " ", "a ", " a", "a  b", "a \nb", "a\n b", "a\t \tb", "word. word? word\nword", *("".join(r.choices(signs, k=r.randint(1, 24))) for _ in range(5_000))]:
        ids = np.frombuffer(code.text(text), code.dtype).tolist()
        assert ids == code.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    code.text("one two three. four")
    cut, units = [], code.units
    code.units = type("Cuts", (), {"findall": staticmethod(lambda text: cut.append(text) or units.findall(text))})
    code.text("one four three. two two")
    assert cut == ["one"]


def test_token_files_of_a_hot_key(spark):
    """Most rows under one key or without one: they are dealt to several files, in ascending order all the same."""
    texts = [f"some text {i % 7}" for i in range(400)]
    rows = spark.createDataFrame([(None if i % 3 == 0 else 5 if i % 3 == 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins files as small as these
    try:
        manifest = TF.write_token_files(rows, TF.default_tokenizer(), fresh_path(spark, "tokens"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(TF.read_token_files(manifest).collect(), key=lambda r: r["start"])
    keys = [r["key"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(got) == 400
    assert [r["start"] for r in got] == list(np.cumsum([0, *[r["n_ids"] for r in got]])[:-1])
    assert manifest.where("n_docs > 200").count() == 0


# --- WARC


def test_warc_round_trip(spark):
    long = "<p>" + "x y z " * 60_000
    htmls = ["<p>a</p>", None, "", "<p>a</p>", long, "<p>é</p>", long, "<p>a</p>"]
    rows = [(i * 3 % 8, f"http://h/{i}\r\nX: y" if i == 2 else None if i == 5 else f"http://h/{i}", h) for i, h in enumerate(htmls)] + [(None, "u", "<p>a</p>"), (None, "u", "only")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    got = WA.read_warc(WA.write_warc(frame, fresh_path(spark, "warc"))).collect()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    want = []
    for page, url, html in rows:
        body = (html or "").encode()
        shared = sum((h or "") == (html or "") for _, _, h in rows) > 1
        refers = first.get(html or "") if shared and page != first.get(html or "") else None
        want.append((page, url and url.replace("\r", "%0D").replace("\n", "%0A"), "response" if refers is None else "revisit", len(body), WA.digest(body), refers, body if refers is None else None))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] is not None else None)) for r in got)
    large = WA.read_warc(WA.write_warc(frame, fresh_path(spark, "warc"), least=100)).where("record_type = 'revisit'").collect()
    assert len(large) == 1
    assert WA.read_warc(WA.write_warc(frame.limit(0), fresh_path(spark, "warc"))).count() == 0


def archive(records):
    out = io.BytesIO()
    WA.dump(iter(records), out)
    return out.getvalue()


def test_warc_dictionary_and_faults():
    records = [WA.record(i, f"http://h/{i}", f"page number {i} of the same site ".encode() * 20) for i in range(300)]
    data = archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(WA.load(io.BytesIO(data))) == records
    assert list(WA.load(io.BytesIO(archive(records[:1])))) == records[:1]  # too little for a dictionary
    assert list(WA.load(io.BytesIO(b""))) == []
    with pytest.raises(WA.WarcError):
        list(WA.load(io.BytesIO(data[:-5])))
    with pytest.raises(WA.WarcError):
        list(WA.load(io.BytesIO(data[:20])))
    good = records[0]
    for bad in (good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Date", b"WARC-Dote"), good[:-1], good.replace(b"page number 0", b"page number 9", 1), good + b"x", good.replace(b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises(WA.WarcError):
            WA.parse(bad)


def foreign(kind, block, *lines, version="1.0"):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Length: {len(block)}", *lines]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_archives_of_others():
    """Records that other writers make: all types, chunked bodies, other digests, folded lines, cut records."""
    import base64
    import hashlib

    http = "Content-Type: application/http; msgtype=response"
    body = b"<p>some text</p>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX: a\r\n b\r\n\r\n5;x=y\r\n<p>so\r\nb\r\nme text</p>\r\n0\r\n\r\n"
    plain = b"HTTP/1.1 200 OK\r\n\r\n" + body
    sha256 = "sha256:" + hashlib.sha256(body).hexdigest()
    md5 = "md5:" + base64.b32encode(hashlib.md5(body).digest()).decode()
    cases = [
        (foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), "warcinfo", b"software: x\r\n"),
        (foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://h/"), "request", b""),
        (foreign("metadata", b"a: b"), "metadata", b"a: b"),
        (foreign("resource", b"\x00\xff", version="1.1"), "resource", b"\x00\xff"),
        (foreign("response", chunked, http), "response", body),
        (foreign("response", chunked, http, "WARC-Payload-Digest: " + sha256), "response", body),
        (foreign("response", plain, http, "WARC-Payload-Digest: " + md5), "response", body),
        (foreign("response", plain, http, "WARC-Payload-Digest: blake9:zz"), "response", body),
        (foreign("response", plain.replace(b"OK", b"OK\r\nContent-Length: 99"), http, "WARC-Truncated: length"), "response", body),
        (foreign("response", b"dns data", "Content-Type: text/dns"), "response", b"dns data"),
        (foreign("revisit", b"", http, "WARC-Refers-To: <urn:uuid:2>"), "revisit", None),
    ]
    for data, kind, payload in cases:
        got = WA.parse(data)
        assert (got["record_type"], got["payload"]) == (kind, payload), data
        assert kind == "revisit" or (got["payload_bytes"] == len(payload) and got["payload_digest"])
    records = list(WA.load(io.BytesIO(archive([c[0] for c in cases]))))
    assert [WA.parse(x)["record_type"] for x in records] == [c[1] for c in cases]
    faults = [
        foreign("response", plain.replace(b"OK", b"OK\r\nContent-Length: many"), http),
        foreign("response", plain.replace(b"OK", b"OK\r\nContent-Length: 99"), http),
        foreign("response", chunked[:-9], http), foreign("response", b"no header", http), foreign("response", plain.replace(b"OK", b"OK\r\nno colon"), http),
        foreign("response", plain, http, "WARC-Payload-Digest: " + sha256[:-1]), foreign("metadata", b"x", "Page-ID: x1"), foreign("metadata", b"x", "Page-ID: " + "9" * 30),
        foreign("metadata", b"x").replace(b"Content-Length: 1", b"Content-Length: -1"), foreign("revisit", b"", http), b"", b"WARC/1.0\r\n\r\n", bytes(range(256)),
    ]
    for data in faults:
        with pytest.raises(WA.WarcError):
            WA.parse(data)
    r = random.Random(2)
    whole = archive([c[0] for c in cases] * 40)
    for _ in range(300):  # damage of any kind raises WarcError alone
        bad = bytearray(whole if r.random() < 0.5 else r.choice(cases)[0])
        for _ in range(r.randint(1, 4)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        try:
            for x in WA.load(io.BytesIO(bytes(bad))) if bad[:1] != b"W" else [bytes(bad)]:
                WA.parse(x)
        except WA.WarcError:
            pass


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_warc_of_hot_payloads(spark, monkeypatch, rows):
    """Most pages hold one payload; also where the shared payloads are too many for a broadcast."""
    from boxloom.llm import common as CO

    monkeypatch.setattr(WA, "is_small", lambda df: CO.is_small(df, rows))
    monkeypatch.setattr(CO, "HOT_ROWS", 10)
    htmls = ["same" if i % 3 else f"page {i % 4}" for i in range(90)]
    frame = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    got = {x["page_id"]: x for x in WA.read_warc(WA.write_warc(frame, fresh_path(spark, "warc"))).collect()}
    for i, h in enumerate(htmls):
        first = htmls.index(h)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if first == i else ("revisit", first))


# --- HTML extraction

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><article><h1>Head &amp; line</h1><p>First&nbsp;para
 graph <b>bold<br>text <p>Second &lt;one&gt; &copy; &#233;<script>var a = "</p>";</script> end<!-- <p>no</p> --></p>
<aside class="related"><a href=y>Other story</a></aside><ul><li>One<li>Two</ul>tail</article>
<section class="comments"><p>Nice post!</p></section><form><p>Name <input></p></form><div class="ad">Buy now</div><footer>&copy; me</footer></body></html>"""


def test_extraction_of_a_page():
    got = HX.extract([PAGE, None, "", "<p>"], *HX.model())
    assert got[0] == "Head & line\n\nFirst para graph bold text\n\nSecond <one> © é end\n\nOne\n\nTwo\n\ntail"
    assert got[1:] == ["", "", ""]


def test_held_out_pages():
    pages = [HX.Page(h, labelled=True) for h in HT.labelled_pages(150, seed=77)]
    forest = HX.Forest(pages)
    weights, tables = HX.model()
    marginal, _ = HX.sum_product(forest, forest.unary(weights), tables)
    right = [(marginal[s + i] >= 0.5) == p.labels[i] for p, s in zip(pages, forest.starts, strict=False) for i, _, _ in p.blocks]
    assert np.mean(right) > 0.99


def test_messages_equal_enumeration():
    page = HX.Page("<div><p>a</p><nav>b<p>c</p></nav></div>")
    forest = HX.Forest([page])
    r = np.random.default_rng(1)
    unary, tables = r.normal(size=forest.n), r.normal(size=(len(HX.TAGS), 2, 2))
    marginal, _ = HX.sum_product(forest, unary, tables)
    weight = {}
    for y in itertools.product((0, 1), repeat=forest.n):
        weight[y] = np.exp(sum(unary[i] * y[i] for i in range(forest.n)) + sum(tables[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(1, forest.n)))
    for i in range(forest.n):
        assert marginal[i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / sum(weight.values()))


def test_broken_html_is_read():
    for html in ("<", "<a", "</p></div>", "<p class='x", "<!-- open", "<script>never closed", "<div>" * 3000 + "deep", "a < b > c & d", "<p>" + "word " * 200_000, "<![CDATA[x]]>", "<p title='>'>t"):
        HX.extract([html], *HX.model())
    blocks = [t for _, t, _ in HX.Page("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl>").blocks]
    assert blocks == ["a", "b", "c", "d", "e"]


def test_extraction_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = HX.extract_text(rows).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got] and got[0]["text"] == got[2]["text"] and got[1]["text"] == ""
    assert HX.extract_text(rows, keep_html=True).columns == ["page_id", "url", "html", "text", "n_chars"]
    assert HX.extract_text(rows.limit(0)).count() == 0


# --- pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "jaccard_join", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns, name
        path = fresh_path(spark, "stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.join(before, docs.columns, "left_anti").count() == 0
    last = corpus_pipeline.encoded(spark, docs, sf_dir).toPandas()
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert sorted(last["doc_id"]) == sorted(whole["doc_id"]) and whole["round_trip"].all()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    kept = labels["doc_id"].isin(whole["doc_id"])
    assert kept[labels["quality"] == 1].mean() > 0.7 and kept[labels["quality"] == 0].mean() < 0.3


def test_pipeline_stages_take_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 60, None, None, 1)], docs.schema)).withColumn("ids", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf_dir).collect()


def test_near_duplicates_leave_one_row_of_each_group(spark, sf_dir):
    r = random.Random(8)
    text = [" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(8)]
    near = [x + " end" for x in text]
    groups = [
        [(1, text[0]), (None, near[0]), (None, near[0])],  # a copy without an id
        [(None, text[1])],  # unique, without an id
        [(2, text[2]), (3, near[2])],
        [(3, text[3])],  # another text under the id of a copy
        [(4, text[4]), (4, near[4]), (4, near[4]), (5, text[4])],  # several rows with the smallest id
        [(None, text[5]), (None, text[5]), (None, near[5])],  # no row has an id
        [(6, text[6]), (6, text[6])],
        [(None, None)], [(None, "")], [(7, None)], [(7, " ")], [(7, None)],  # no words, no group
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", None) for g in groups for i, t in g], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, frame, sf_dir)
    assert kept.columns == frame.columns
    left = [(x["doc_id"], x["text"]) for x in kept.collect()]
    assert len(left) == len(groups)
    for g in groups[:7]:
        found = [x for x in left if x[1] in {t for _, t in g}]
        assert len(found) == 1 and found[0][0] == min((i for i, _ in g if i is not None), default=None)
    assert sorted(map(str, (x for x in left if not (x[1] or "").strip()))) == sorted(map(str, (x for g in groups[7:] for x in g)))
