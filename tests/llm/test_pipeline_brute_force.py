"""The pipeline's rows against the definitions of its stages, computed directly on a small corpus."""

import random
from fractions import Fraction

import numpy as np

import corpus_pipeline
from boxloom.llm import language_id as LI
from boxloom.llm import quality_rules as QR
from boxloom.llm import sentencepiece_codec as SP

from .test_text_operators import DOCS, counts, edited, overlap, prose, tokens, true_components, true_distances, vector


def corpus():
    r, rows = random.Random(12), []
    words = {"en": "the of and to in is that for it with as was on be at by this".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht".split()}

    def text(lang, n):
        return " ".join(r.choice(words[lang]) if r.random() < 0.4 else f"{r.choice(words[lang])}{r.randrange(10**5)}" for _ in range(n))

    items = [(k, prose(900 + k, n, 10**6)) for k, n in enumerate([6, 9, 20, 40])]
    for i in range(130):
        lang = "en" if i % 3 else "de"
        rows.append((i, text(lang, r.randint(52, 200)), lang, f"s{i % 2}", 0))
    for i in range(0, 40, 4):  # near and exact copies
        _, t, lang, source, _ = rows[i]
        rows.append((200 + i, t if i % 8 else edited(t, i, 1), lang, source, 0))
    for i in range(12):  # passages of the benchmark
        _, t, lang, source, _ = rows[60 + i]
        w, passage = t.split(), items[i % 4][1].split()
        if i >= 4:
            passage[len(passage) // 2] = "changed"
        rows.append((300 + i, " ".join([text(lang, 60), *passage, *w[:20]]), lang, source, 0))
    rows += [(400, "too short", "en", "s0", 0), (401, "a b c " * 40, "en", "s0", 0), (402, None, "en", "s0", 0), (403, " ".join(w + "***" for w in text("en", 90).split()), "en", "s0", 0), (404, " ".join(str(10**6 + k) for k in range(60)), None, "s1", 0)]
    return rows, items


def expected(rows, items):
    good = []
    for x in rows:
        n, *_, repeat = counts(x[1])
        if n >= 50 and 100 * repeat <= 50 * n:
            good.append(x)
    name = lambda v: "null" if v is None else "=" + v
    d = true_distances([name(x[2]) for x in good], [(name(x[2]), name(x[3])) for x in good], np.array([vector(x[1]) for x in good]))
    good = [x for x, v in zip(good, d, strict=True) if v <= QR.CUTOFF]
    # fewer rows than the bound of the sample: the model is fitted on all that are labelled
    taught = [x for x in good if x[2] is not None]
    model = LI.KernelModel.fit([LI.ngrams(x[1]) for x in taught], [x[2] for x in taught])
    names, score = model.predict([x[1] for x in good])
    good = [x for x, lang, s in zip(good, names, score, strict=True) if lang != "und" and s >= corpus_pipeline.LEAST_SCORE]
    least = {i: c for i, _, c in true_components([(x[0], x[1]) for x in good], 5, Fraction(4, 5))}
    good = [x for x in good if least[str(x[0])] == str(x[0])]
    return [x for x in good if not any(overlap(tokens(x[1]), tokens(t)) for _, t in items)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import sentencepiece

    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    want = expected(rows, items)
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == sorted(x[0] for x in want)
    library = sentencepiece.SentencePieceProcessor(model_file=SP.default_model())
    assert all(list(got[i]["ids"]) == library.encode(t) and got[i]["round_trip"] for i, t, *_ in want)
    gone = {x[0] for x in rows} - set(got)
    assert {400, 401, 402, 403, 404} <= gone and len(gone & set(range(200, 300))) == 10 and len(gone & set(range(300, 312))) >= 6 and len(got) > 100
