"""URL filters, sharding, decontamination, Jaccard join, language identification and quality rules: brute force and
edge cases (nulls, empty and long texts, ties, repeated rows, empty tables, other columns)."""

import collections
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.llm import common as CO
from boxloom.llm import decontamination as DC
from boxloom.llm import jaccard_join as JJ
from boxloom.llm import language_id as LI
from boxloom.llm import quality_rules as QR
from boxloom.llm import sharding as SH
from boxloom.llm import url_filters as UF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    out = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    if extra:  # names that operators use inside
        out = out.withColumns({c: F.lit(7) for c in ("key", "shard", "block", "place", "stratum", "d2", "n_words", "score", "lang_pred", "tokens", "set", "best", "z0")})
    return out


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# --- URL filters

URLS = [None, "", "no scheme/en/", "http://COM/en/", "https://a.example.com/en/7?x#y", "https://example.com/en/81", "ftp://notexample.com/en/71", "x://net#f", "http://www.example.net/de/85.html", "http://org", "http://a.org/es/", "a://b://c.com/en/", "http://example.com?u=/en/7", "http://example.com/en/7" + "x" * 100_000]


def expected_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in UF.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_trie_and_join(spark):
    rows = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, best string, rule string")
    got = UF.filter_urls(rows, UF.RULES)
    joined = UF.filter_by_join(UF.with_host_and_path(rows.drop("rule")), UF.RULES)
    for frame in (got, joined):
        found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in frame.collect()}
        assert found == {i: expected_verdict(u) for i, u in enumerate([*URLS, *URLS])}
        assert {r["best"] for r in frame.collect()} == {"kept"}
    assert UF.filter_urls(rows.limit(0), UF.RULES).count() == 0
    assert UF.UrlTrie([("a.b", "allow"), ("a.b", "block")]).find("x.a.b", "/")[1] == "block"
    assert UF.UrlTrie([]).find("a", "") is None


def test_url_ties_and_hot_suffixes(spark, monkeypatch):
    """Trie and join agree where rules of equal length fit, whatever the host's case, and where a suffix is hot."""
    r = random.Random(3)
    labels, paths = ["a", "b", "com", "COM"], ["", "a", "ab", "abcd", "a/b", "a/", "b"]
    rules = [("com/abcd", "allow"), ("a.com/ab", "block"), ("com/a", "block"), ("com/b", "allow"), ("com/b", "block")]
    rules += [(".".join(r.choices(labels, k=r.randint(1, 3))) + "/" + r.choice(paths), r.choice(["allow", "block"])) for _ in range(60)]
    urls = ["http://a.com/abcd"] + ["x://" + ".".join(r.choices(labels, k=r.randint(1, 4))) + "/" + r.choice(paths) + r.choice(["", "x", "?q"]) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    trie = {x["page_id"]: (x["rule"], x["verdict"]) for x in UF.filter_urls(rows, rules).collect()}
    assert trie[0] == ("a.com/ab", "block")
    for hot in (10_000, 5):
        monkeypatch.setattr(CO, "HOT_ROWS", hot)
        joined = UF.filter_by_join(UF.with_host_and_path(rows), rules)
        assert {x["page_id"]: (x["rule"], x["verdict"]) for x in joined.collect()} == trie


# --- sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * SH.JUMP_MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.array([0, 1, -1, 2**63 - 1, -(2**63), *range(500)], np.int64)
    for n in (1, 2, 16, 17, 1000):
        assert SH.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_sharding(spark):
    rows = [(i, f"text {i}") for i in range(600)] + [(5, "text 5"), (None, None), (None, ""), (None, "x"), (9, "é" * 50_000)]
    got = SH.shard_documents(docs(spark, rows, True)).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert len(moved) and set(moved["grown_shard"]) == {SH.SHARDS}
    assert got[got["doc_id"] == 9]["size"].max() == 100_001
    nothing = got[got["size"] == 1]
    assert len(nothing) == 2 and set(nothing["text_crc32"]) == {0}
    assert SH.shard_documents(docs(spark, rows).limit(0)).count() == 0


def test_sharding_of_hot_keys(spark, monkeypatch):
    """Equal rows and rows of one key get slots of their own, in several tasks where they are many."""
    monkeypatch.setattr(SH, "RUN", 7)
    rows = [(5, "same")] * 100 + [(6, f"text {i}") for i in range(50)] + [(None, "none")] * 8 + [(i, "x") for i in range(20)]
    got = SH.shard_documents(docs(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got["text_crc32"] == zlib.crc32(b"same")).sum() == 100
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in got.groupby("shard"))
    for n, column in ((SH.SHARDS, "shard"), (SH.SHARDS + 1, "grown_shard")):
        by = got["doc_id"].fillna(got["text_crc32"]).astype("int64")
        assert got[column].tolist() == [jump(int(k), n) for k in by]


# --- decontamination


def tokens(text):
    text = re.sub("([\u3040-\u30ff\u4e00-\u9fff\u0e00-\u0e7f])", r" \1 ", (text or "").lower())
    return [x for x in re.split(r"[^\w\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]+|_+", text) if x]


def overlap(a, b):
    """Brute force of the definition."""
    n = min(DC.SPAN, len(b))
    need = DC.NEED if n == DC.SPAN else n - 1 if n >= DC.ONE_CHANGE else n
    if n < DC.SHORTEST:
        return n > 0 and a == b
    return any(sum(x == y for x, y in zip(a[i : i + n], b[j : j + n], strict=False)) >= need for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))


def test_masks_miss_nothing():
    for i in range(DC.SPAN):
        for j in range(DC.SPAN):
            classes = [not {i, j} & set(c) for c in DC.CLASSES]
            assert any(all(classes[c] for c in mask) for mask in DC.MASKS)
    for n in range(DC.ONE_CHANGE, DC.SPAN):
        classes, masks = DC.masked(n)
        assert sorted(k for c in classes for k in c) == list(range(n))
        assert all(any(i not in classes[c] for (c,) in masks) for i in range(n))


def test_ranges_hold_all_characters_of_unspaced_scripts():
    import regex

    scripts = regex.compile("[" + "".join(rf"\p{{Script={x}}}" for x in DC.UNSPACED) + "]")
    ranges = regex.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", DC.RANGES))
    for c in range(0x110000):
        if scripts.match(chr(c)) and regex.match(r"[\p{L}\p{M}\p{N}]", chr(c)):
            assert ranges.match(chr(c)), hex(c)


@pytest.mark.parametrize("seeds", [300_000, 10])
def test_decontamination_equals_brute_force(spark, monkeypatch, seeds):
    monkeypatch.setattr(DC, "BROADCAST_SEEDS", seeds)  # 10: blocks of hashes, then a join of the hits
    monkeypatch.setattr(DC, "BLOCK_SEEDS", 200)
    monkeypatch.setattr(CO, "HOT_ROWS", 20)
    r = random.Random(4)
    items = [(k, prose(100 + k, n)) for k, n in enumerate([3, 5, 9, 13, 20, 60])] + [(90, None), (91, ""), (92, prose(103, 13)), (93, "Yes"), (94, "一二三四五六七八九十百千万"), (95, prose(7, 4)), (96, prose(8, 12)), (97, prose(9, 8))]
    rows = [(None, items[4][1]), (0, None), (1, ""), (2, "  \n"), (3, "yes!"), (4, "yes yes"), (5, items[0][1].upper()), (6, items[0][1] + " more"), (7, "前一二三四五七七八九十百千万後"), (8, "一二三四五 六七八"), (9, items[11][1])]
    rows += [(600 + k, " ".join(["before"] * k + ["changed" if j == k else w for j, w in enumerate(items[12 + k % 2][1].split())] + ["after"])) for k in range(12)]
    for k in range(60):
        words = prose(k, 40).split()
        _, text = r.choice(items[1:6])
        inserted = text.split()
        for _ in range(r.randrange(4)):
            inserted[r.randrange(len(inserted))] = "changed"
        words[20:20] = [w.upper() + r.choice(["", ",", "!"]) for w in inserted]
        rows.append((10 + k, " ".join(words)))
    rows += [(11, rows[30][1]), (500, prose(7, 30_000) + " " + items[5][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(spark, rows, True)
    got = {(x["key"], x["item_id"]) for x in DC.overlaps(frame, benchmark).collect()}
    want = {(i, k) for i, t in rows for k, b in items if overlap(tokens(t), tokens(b))}
    assert got == want and len(want) > 20
    kept = DC.without_overlaps(frame, benchmark)
    assert kept.columns == frame.columns
    bad = {t for i, t in rows if any(overlap(tokens(t), tokens(b)) for _, b in items)}
    assert sorted(map(str, (x["doc_id"] for x in kept.collect()))) == sorted(str(i) for i, t in rows if t not in bad)
    assert DC.overlaps(frame.limit(0), benchmark).count() == 0
    assert DC.overlaps(frame, benchmark.limit(0)).count() == 0


# --- Jaccard join


def words_of(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingle_set(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def true_components(rows, k, t):
    sets = [shingle_set(x, k) for _, x in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common * t.denominator >= len(sets[i] | sets[j]) * t.numerator:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted((str(i), len(sets[n]), str(i if not sets[n] else least[find(n)])) for n, (i, _) in enumerate(rows))


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(40)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "t", "block"), [(4, Fraction(85, 100), 2048), (5, Fraction(4, 5), 2048), (4, Fraction(85, 100), 16)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, k, t, block):
    monkeypatch.setattr(JJ, "BLOCK_SETS", block)  # 16: several blocks, and hot signatures, leaders, shingles and nodes
    if block == 16:
        for module, name, value in ((JJ, "SAMPLED", 2), (JJ, "PART", 8), (JJ, "FEW_EDGES", 20)):
            monkeypatch.setattr(module, name, value)
        monkeypatch.setattr(JJ, "hot_keys", lambda sizes, key, rows=10: CO.hot_keys(sizes, key, rows))
    source, passage = prose(1, 150, 10**6), prose(2, 60, 10**6)
    rows = [(i, edited(source, i, 1 + i % 9)) for i in range(60)]  # copies on both sides of the threshold
    rows += [(100 + i, prose(i, 30) + " " + passage) for i in range(40)]  # one passage in unlike documents
    rows += [(200 + i, prose(i % 7, 3 + i % 7)) for i in range(40)] + [(300, source), (301, source.upper()), (302, source)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One"), (404, "one"), (None, "one two"), (None, "ONE two"), (405, None)]
    rows += [(500, prose(9, 20_000, 10**6)), (501, edited(prose(9, 20_000, 10**6), 1, 100)), (502, "word\x1cword " * 40), (503, "a b " * 500)]
    got = JJ.jaccard_components(docs(spark, rows, True), k, t).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == true_components(rows, k, t)


@pytest.mark.parametrize("block", [2048, 16])
def test_jaccard_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(JJ, "BLOCK_SETS", block)  # 16: several blocks
    k, t, source = 4, Fraction(85, 100), prose(1, 150, 10**6)
    rows = [(i, edited(source, i, 1 + i % 2)) for i in range(50)] + [(100, source), (101, source), (None, source), (102, prose(5, 40))]
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE")]
    sets = [shingle_set(x, k) for _, x in rows]
    linked = lambda a, b: bool(a & b) and len(a & b) * t.denominator >= len(a | b) * t.numerator
    got = JJ.link_counts(docs(spark, rows, True), k, t).collect()
    want = [(str(i), len(s), sum(linked(s, o) for m, o in enumerate(sets) if m != n)) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in got) == sorted(want)
    links, members = JJ.jaccard_links(docs(spark, rows), k, t)
    different = list({frozenset(s) for s in sets})
    pairs = sum(linked(a, b) for n, a in enumerate(different) for b in different[:n])
    assert links.count() == links.distinct().count() == pairs > 100 and members.count() == len(rows)
    assert JJ.link_counts(docs(spark, rows).limit(0), k, t).count() == 0


def test_jaccard_of_nothing(spark):
    assert JJ.jaccard_components(docs(spark, [(1, "x")]).limit(0)).count() == 0
    assert [tuple(r) for r in JJ.jaccard_components(docs(spark, [(1, None)])).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("t", [Fraction(85, 100), Fraction(4, 5), Fraction(1, 2)])
def test_similar_sets_share_a_signature(t):
    r = np.random.default_rng(5)
    ends = np.array(JJ.bands(t))
    band = lambda n: int(np.searchsorted(ends, n, "right")) - 1
    for trial in range(1500):
        n = int(r.integers(1, 120))
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        drop, add = int(r.integers(0, max(1, n // 5) + 1)), int(r.integers(0, max(1, n // 5) + 1))
        y = np.unique(np.concatenate([x[drop:], r.integers(0, 2**63, add, dtype=np.uint64)]))
        x = np.unique(x)
        common = len(np.intersect1d(x, y))
        if not len(y) or Fraction(common, len(x) + len(y) - common) < t:
            continue
        sets = 10 ** (trial % 10)
        out = []
        for s in (x, y):
            found = [JJ.signatures(s, band(len(s)), JJ.scheme(t, band(len(s)), sets))]
            if band(len(s)):
                found.append(JJ.signatures(s, band(len(s)) - 1, JJ.scheme(t, band(len(s)) - 1, sets)))
            out.append(np.concatenate(found))
        assert len(np.intersect1d(*out)), (len(x), len(y), common)


def test_block_links_skip_components():
    sets = [[1, 2, 3, 4], [1, 2, 3, 4, 5], [9, 8], [1, 2, 3, 4, 6]]
    rows = np.repeat(np.arange(4), [len(s) for s in sets])
    ids, size, whole = np.array([10, 11, 12, 13]), np.array([len(s) for s in sets]), np.ones(4, bool)
    flat = np.array([x for s in sets for x in s])
    a, b = JJ.block_links(ids, np.array([10, 11, 12, 13]), rows, flat, size, whole, whole, Fraction(4, 5))
    assert {tuple(sorted(x)) for x in zip(a, b, strict=True)} == {(10, 11), (10, 13)}
    a, b = JJ.block_links(ids, np.array([1, 1, 12, 13]), rows, flat, size, whole, whole, Fraction(4, 5))
    assert {tuple(sorted(x)) for x in zip(a, b, strict=True)} == {(10, 13)}
    assert not len(JJ.block_links(ids, np.full(4, 3), rows, flat, size, whole, whole, Fraction(4, 5))[0])


# --- language identification


def test_language_identification(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = LI.predict(table, LI.train(table.where(~LI.held_out()))).where(LI.held_out()).toPandas()
    assert len(got) > 20 and (got["lang"] == got["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("x", None)] * 5)], "doc_id long, text string, lang string")
    model = LI.train(train)
    rows = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "12 34 !", 0.1), (4, "the dog", 0.1), (4, "the dog", 0.1), (None, "le chien " * 100_000, 0.1)], "doc_id long, text string, score double")
    got = LI.predict(rows, model).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "en", "fr"]
    assert [r["score"] for r in got[:3]] == [0, 0, 0]
    nothing = LI.predict(rows, LI.train(train.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert LI.predict(rows.limit(0), model).count() == 0
    held = {r[0]: r[1] for r in train.select("doc_id", LI.held_out()).collect()}
    import zlib

    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in held}


def test_letters_are_those_of_category_l(spark):
    import unicodedata

    model = LI.train(spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr")], "doc_id long, text string, lang string"))
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    names, _ = model.predict([*chars, "½²①Ⅷ", "½²①Ⅷ x"])
    assert [n != "und" for n in names] == [unicodedata.category(c)[0] == "L" for c in chars] + [False, True]


def test_kernel_fit_equals_direct_computation(monkeypatch):
    """Kernel matrix, Nystroem map and ridge outputs from their definitions."""
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abcdefgh"[i % 3 :], k=4)) for _ in range(12)) for i in range(60)]
    names = ["xyz"[i % 3] for i in range(60)]
    monkeypatch.setattr(LI, "LANDMARKS", 8)
    monkeypatch.setattr(LI, "COLUMNS", 37)
    model = LI.KernelModel.fit([LI.ngrams(t) for t in texts], names)
    grams = [{t.encode()[i : i + n] for n in LI.ORDERS for i in range(len(t) - n + 1)} for t in texts]
    marks = [i for c in "xyz" for i in [j for j, n in enumerate(names) if n == c][:8]]
    known = set().union(*[grams[i] for i in marks])
    kernel = lambda a, b: len(a & b & known) / np.sqrt(len(a & known) * len(b & known))
    inner = np.array([[kernel(grams[i], grams[j]) for j in marks] for i in marks])
    value, vector = np.linalg.eigh(inner)
    good = value > 1e-6 * value[-1]
    cross = np.array([[kernel(g, grams[j]) for j in marks] for g in grams])
    features = cross @ (vector[:, good] / np.sqrt(value[good]))
    target = np.array([[1.0 if n == c else -1.0 for c in "xyz"] for n in names])
    ridge = np.linalg.solve(3 * features.T @ features + LI.RIDGE * 60 * np.eye(features.shape[1]), 3 * features.T @ target)
    want = features @ ridge
    got, score = model.predict(texts)
    assert got == ["xyz"[i] for i in want.argmax(1)]
    power = np.exp(LI.SHARPNESS * want)
    assert np.allclose(score, (power / power.sum(1, keepdims=True)).max(1), atol=1e-3)


def test_many_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(LI, "ALL_ROWS", 500)
    monkeypatch.setattr(LI, "ALL_LANDMARKS", 300)
    rows = [(3 * k + i, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} " * 9, f"l{k}") for k in range(250) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = LI.train(frame)
    assert len(model.languages) == 250
    assert model.predict([rows[3 * k][1] for k in range(250)])[0] == [f"l{k}" for k in range(250)]


def test_language_training_rows(spark, monkeypatch):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(20)] + [(i, f"le chat et le chien {i}", "fr") for i in range(20)]
    rows += [(None, f"le chien {i}", "en") for i in range(500)]  # without an id: never learned from
    rows += [(99, "the same row", "en")] * 500 + [(100, f"a text {i} of one id", "de") for i in range(30)]
    seen = []
    monkeypatch.setattr(LI.KernelModel, "fit", classmethod(lambda cls, sets, names: seen.append((sets, names))))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    LI.train(frame)
    LI.train(frame, rows=10)
    assert collections.Counter(seen[0][1]) == {"en": 21, "fr": 20, "de": 30}
    assert {x.tobytes() for x in seen[0][0]} == {LI.ngrams(t).astype(np.int32).tobytes() for i, t, _ in rows if i is not None}
    assert collections.Counter(seen[1][1]) == {"en": 10, "fr": 10, "de": 10}


def test_windows_keep_all_ngrams(monkeypatch):
    text = "abcdefghij" * 5
    whole = LI.ngrams(text).tolist()
    monkeypatch.setattr(LI, "WINDOW", 7)
    assert LI.ngrams(text).tolist() == whole


# --- quality rules


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i, k in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[k] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a a", "x\u00a0y # é", "l\nl\n \nl\n", "a\x1cb", "😀 $$ |", " ".join("ab" for _ in range(5000))]
    texts += [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (4, 5, 10, 40, 300, 2000)]
    texts += ["\n".join(prose(r.randrange(4), 6) for _ in range(12)) for _ in range(5)] + [prose(3, 200_000, 10**9)]
    got = QR.quality_rules(docs(spark, list(enumerate(texts)), True), ["doc_id", "stratum", "d2", "n_words"]).collect()
    assert {x["stratum"] for x in got} == {7}
    found = {x["doc_id"]: (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) for x in got}
    assert found == {i: counts(t) for i, t in enumerate(texts)}
    for x in got:
        n, *_, repeat = counts(texts[x["doc_id"]])
        assert x["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (x["base_failed"] and x["kept"])


def test_outliers_are_rejected(spark):
    rows = [(i, prose(i, 60 + i % 100)) for i in range(700)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(i, 120).split())) for i in range(40)]
    rows += [(2000 + i, "\n".join(["the same line stands here again and again"] * 5 + [prose(i, 150)])) for i in range(20)]
    out = QR.quality_rules(docs(spark, [*rows, rows[0]]), ["doc_id"]).toPandas()
    clean, junk = out[out["doc_id"] < 1000], out[out["doc_id"].between(1000, 1999)]
    assert clean["kept"].all() and not junk["kept"].any()
    assert QR.quality_rules(docs(spark, rows).limit(0), ["doc_id"]).count() == 0


def vector(text):
    """The transformed statistics as whole multiples of 1 / GRID, by their definitions."""
    n, chars, symbols, dups, repeats = counts(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    of = lambda signs: sum(c in signs for c in text)
    m, c = n + QR.PRIOR, chars + QR.PRIOR * QR.PRIOR_LENGTH
    x = [np.log(n + 1.0), np.log(c / m), np.sqrt(symbols / c), np.sqrt(dups / (lines + 5.0)), np.sqrt(repeats / m), np.sqrt(of(QR.CAPITALS) / c), np.sqrt(of(QR.PUNCTUATION) / c)]
    return np.floor(np.array(x) * QR.GRID + 0.5) / QR.GRID


def lower_median(x):
    return np.sort(x, axis=0)[(len(x) - 1) // 2]


def true_distances(languages, strata, x):
    """Squared distances under the regularized estimates of least determinant, each stratum for itself."""
    floors = np.diag(np.array(list(QR.FLOORS.values())) ** 2)
    spread = lambda y: (lower_median(np.abs(y - lower_median(y))) * QR.NORMAL) ** 2
    out = np.zeros(len(x))
    everything = (lower_median(x), spread(x))
    for s in sorted(set(strata)):
        rows = np.array([z == s for z in strata])
        mine, same = x[rows], x[np.array([z == s[0] for z in languages])]
        w = len(same) / (len(same) + QR.WEIGHT)
        centre, variance = lower_median(same), spread(same)
        target = w * centre + (1 - w) * everything[0]
        width = w * variance + (1 - w) * everything[1] + w * (1 - w) * (centre - everything[0]) ** 2
        w = len(mine) / (len(mine) + QR.WEIGHT)

        def mix(y, factor, w=w, target=target, width=width):
            m = y.mean(0)
            off = m - target
            return w * m + (1 - w) * target, w * factor * ((y - m).T @ (y - m) / len(y)) + w * (1 - w) * np.outer(off, off) + (1 - w) * np.diag(width) + floors

        def distance(fit, y):
            return np.einsum("ij,jk,ik->i", y - fit[0], np.linalg.inv(fit[1]), y - fit[0])

        def bins(fit, mine=mine):
            return np.floor(np.log2(distance(fit, mine) + 2.0**-10) * QR.BINS)

        def step(fit, mine=mine):
            b = bins(fit)
            order = np.sort(b)
            limit = order[int(np.ceil(QR.SHARE * len(b))) - 1]
            return mix(mine[b <= limit], QR.CONSISTENCY)

        det = lambda fit: np.linalg.slogdet(fit[1])[1]
        own = (w * lower_median(mine) + (1 - w) * target, np.diag(w * spread(mine) + (1 - w) * width) + floors)
        starts = [own, (target, np.diag(width) + floors), mix(mine, 1.0)]
        fit = min((step(step(f)) for f in starts), key=det)
        while det(new := step(fit)) < det(fit) - QR.LEAST_FALL:
            fit = new
        median = lower_median(bins(fit))
        out[rows] = distance(fit, mine) * min(1.0, QR.CHI_MEDIAN / 2 ** ((median + 1) / QR.BINS))
    return out


def test_distances_equal_direct_computation(spark):
    """Three languages and sources, one stratum with a fifth of junk, one of a single row."""
    r = random.Random(6)
    rows = []
    for i in range(420):
        lang, source = ("en", "s1") if i % 7 < 3 else ("en", "s2") if i % 7 < 5 else ("fr", "s1") if i % 7 < 6 else ("fr", None)
        text = prose(i, r.randint(55, 300))
        if i % 5 == 0:
            text = "\n".join([text, "Once More! The Same Line, Again", "Once More! The Same Line, Again"])
        if (lang, source) == ("en", "s2") and r.random() < 0.2:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text, lang, source, 0))
    rows.append((1000, prose(5, 80), None, "alone", 0))
    frame = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: x for x in QR.quality_rules(frame.repartition(3), ["doc_id"]).collect()}
    again = {x["doc_id"]: x for x in QR.quality_rules(frame.repartition(7, "text"), ["doc_id"]).collect()}
    assert got == again  # whatever the partitions
    assert not any(x["base_failed"] for x in got.values())
    name = lambda v: "null" if v is None else "=" + v
    want = true_distances([name(x[2]) for x in rows], [(name(x[2]), name(x[3])) for x in rows], np.array([vector(x[1]) for x in rows]))
    for x, d in zip(rows, want, strict=True):
        assert got[x[0]]["distance"] == pytest.approx(d, rel=1e-6) and got[x[0]]["kept"] == (d <= QR.CUTOFF)
    junk = [x[0] for x in rows if "***" in x[1]]
    assert len(junk) > 15 and not any(got[i]["kept"] for i in junk) and got[1000]["kept"]


def test_fit_takes_few_joins(spark, monkeypatch):
    """Each join, with its broadcast and its code, takes memory of the driver, which hardly gets any of it back."""
    plans, stored = [], QR.stored
    monkeypatch.setattr(QR, "stored", lambda df, tag: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df, tag))
    assert QR.quality_rules(docs(spark, [(i, prose(i, 60 + i % 100)) for i in range(200)]), ["doc_id"]).count() == 200
    joins, windows = ([x.count(node) for x in plans] for node in ("Join ", "Window "))
    assert max(joins) <= 3 and max(windows) <= 2  # 9 and 6 where the driver went over its memory


def test_strata_with_null_names(spark):
    frame = docs(spark, [(i, prose(i, 80)) for i in range(30)]).withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") % 2 == 0, "a")})
    assert QR.quality_rules(frame, frame.columns).where("kept").count() == 30
