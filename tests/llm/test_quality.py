import math
import random
import re

from pyspark.sql import functions as F

from lociflow.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_measures_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a a a a", "x y z x y z", "é # ü\n# \n#\n", "   x"]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", "dd ", "#", "\r\n", "\t", "é ", "a b c\n"], k=rng.randint(1, 120))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measure(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.02), (3, 400, 0.02), (15, 1000, 0.02), (7, 7, 0.02), (100, 9000, 0.02)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    got = {(r.k, r.n): r.p for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()}
    for k, n, p in cases:
        want = 1.0 if k >= n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        assert abs(got[k, n] - want) < 1e-9


def test_cutoffs_respect_the_holdout(spark):
    good = " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}###" for i in range(60))
    rows = [(i, good.replace("w", f"v{i}x"), "en") for i in range(1500)] + [(2000 + i, junk, "en") for i in range(40)] + [(3000, junk, "xx"), (3001, junk, None), (3002, None, "en")]
    labels = [(i, 1) for i in range(1500)] + [(2000 + i, 0) for i in range(40)] + [(5, None), (None, 1)]
    docs, labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id: (r.kept, r.rejected_by) for r in quality.judge(docs, labelled).collect()}
    assert all(kept[i][0] for i in range(1500)) and all(kept[2000 + i] == (False, "symbols") for i in range(40))
    assert kept[3000][0] and kept[3001][0] and kept[3002] == (False, "base")
    none = quality.judge(docs, labelled.limit(0))
    assert none.where("rejected_by <> 'base'").count() == 0 and quality.judge(docs.limit(0), labelled).count() == 0
