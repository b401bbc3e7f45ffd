import itertools
import math

import numpy as np
import public_tokenizers

from lociflow.llm import langid

PATH = public_tokenizers.path("word_bpe_49k.json")


def model():
    size = langid.vocabulary(PATH)[2]
    rng = np.random.default_rng(1)
    probs = rng.random((size, 2))
    return langid.Model(["a", "b"], np.log([0.5, 0.5]), np.vstack([probs / probs.sum(axis=0), [0, 0]]))


def brute(word, m):
    inner, final, none = langid.vocabulary(PATH)
    b = word.encode()
    total = np.zeros(2)
    for cuts in itertools.product([False, True], repeat=len(b) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(b)]
        p = np.ones(2)
        for i, j in itertools.pairwise(edges):
            p = p * m.probs[(final if j == len(b) else inner).get(b[i:j], none)]
        total += p
    return np.log(total)


def test_forward_sums_all_segmentations():
    m = model()
    scores = langid.WordScores(m, PATH)
    scores.learn({"the", "thing", "été", "straße"})
    for w in ("the", "thing", "été", "straße"):
        assert np.allclose(scores.of([w]), brute(w, m)) and np.allclose(scores.long(w), brute(w, m))
    assert np.isfinite(scores.of(["x" * 5000, "the", "the"])).all()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_accuracy_and_odd_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(d, PATH).select("lang", "_language.*").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()


def test_defined_results(spark):
    rows = [(i, "the cat sat on the mat", "en", "x") for i in range(30)] + [(i + 30, "le chat est sur la table", "fr", "x") for i in range(30)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "123 ... ²", "en", "x"), (103, "x" * 50_000, "en", "x"), (None, "the cat", None, None)]
    out = {r.doc_id: r for r in langid.identify(docs(spark, rows), PATH).collect()}
    assert all(out[i]._language.lang_pred == "und" and out[i]._language.score == 0 for i in (100, 101, 102))
    assert out[0]._language.lang_pred == "en" and out[40]._language.lang_pred == "fr" and out[None]._language.lang_pred == "en"
    assert out[103]._language.lang_pred in ("en", "fr") and out[0].score == "x"
    assert langid.identify(docs(spark, []), PATH).collect() == []
    nothing = langid.identify(docs(spark, [(1, "the cat", None, None)]), PATH).first()
    assert nothing._language.lang_pred == "und" and not math.isnan(nothing._language.score)
