import random
import re
from pathlib import Path

import numpy as np

from lociflow.llm import common, jaccard


def brute(texts, k, percent):
    def grams(t):
        w = [x for x in __import__("re").split(r"[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    number = {}
    sets = [{number.setdefault(g, len(number)) for g in grams(t)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def texts_of(rng, n):
    out = [None, "", " \t\n", "one", "One", "one two", "ONE TWO", "É a b c", "é a b c"]
    vocab = [f"w{i}" for i in range(60)]
    while len(out) < n:
        base = rng.choices(vocab, k=rng.choice([5, 12, 20, 40, 90, 300]))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 30)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choices(vocab, k=rng.randint(0, 2))
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


def test_equals_brute_force(spark):
    for seed, k, percent in ((1, 3, 90), (2, 5, 80)):
        texts = texts_of(random.Random(seed), 350)
        docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n long")
        want = brute(texts, k, percent)
        assert len({c for _, _, c in want}) < 300
        if percent == 90:
            assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, k, percent).collect()) == want
        else:
            assert {r.doc_id for r in jaccard.keep_one(docs, k=k, percent=percent).collect()} == {c for _, _, c in want}


def test_segments_and_sketches_keep_every_link():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for _ in range(400):
            n = int(rng.integers(4, 900))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64))
            d = len(a) * (100 - percent) // percent
            drop = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - drop // 2]], rng.integers(0, 2**63, drop - drop // 2).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter < percent * (len(a) + len(b) - inter) or inter == len(a) == len(b):
                continue
            ca, cb = ({jaccard.size_class(len(x), percent), jaccard.size_class(len(x) * 100 // percent, percent)} for x in (a, b))
            common = ca & cb
            assert common
            cut = {c: [jaccard.segment_hashes(x, c, percent) for x in (a, b)] for c in common}
            assert any(np.intersect1d(x[0], y[0]).size for x, y in cut.values())
            for c in common:
                (x, least_a), (y, least_b) = cut[c]
                assert np.intersect1d(x, y).size >= max(least_a, least_b)
                assert inter >= max(len(z) - jaccard.most_differ(len(z), c, percent) for z in (a, b))
                hamming = sum(bin(int(x)).count("1") for x in (jaccard.sketch(a, c, percent) ^ jaccard.sketch(b, c, percent)).view(np.uint64))
                assert hamming <= len(a) + len(b) - 2 * inter


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.keep_one(empty).collect() == []
    docs = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, None), (None, "u v w x y z"), (None, "k l m n o p q"), (None, "k l m n o p q")], "doc_id long, text string")
    folder = common.shared_dir(spark)
    assert sorted(str(r.text) for r in jaccard.keep_one(docs, folder=folder).collect()) == ["None", "None", "a b c d e f", "k l m n o p q", "u v w x y z"]


def test_large_group_of_near_copies(spark):
    """Many near copies in a chain of families, among texts that share a long passage."""
    rng = random.Random(11)
    vocab, passage = [f"w{i}" for i in range(3000)], [f"p{i}" for i in range(46)]
    base, texts = rng.choices(vocab, k=60), []
    for i in range(1200):
        if i % 250 == 0:  # the next family
            for _ in range(2):
                base[rng.randrange(60)] = rng.choice(vocab)
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = rng.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(300):
        texts.append(" ".join(passage + rng.choices(vocab, k=rng.randint(5, 40))))
    texts += [" ".join(passage + ["x", "y", "z"][: i % 4]) for i in range(200)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = common.shared_dir(spark)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, 5, 80, folder).collect())
    assert got == brute(texts, 5, 80)
    path = lambda name: spark.read.parquet(f"{folder}/{name}").count()
    rounds = [path(x.name) for x in Path(folder.removeprefix("file://")).glob("pairs-*")]
    assert max(rounds) <= path("nodes")
    assert path("ends") + path("others") < 3 * path("nodes")


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_key int").selectExpr("*", "1 AS text_key", "2 AS id", "3 AS key", "4 AS root")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_pages_of_one_template_that_do_not_link_make_few_pairs(spark):
    """A passage and a little own text, just below the limit; no pair is counted twice."""
    rng = random.Random(13)
    passage, verified = [f"p{i}" for i in range(90)], {}
    for n, own in ((300, [12]), (900, [12]), (500, range(0, 25))):
        texts = [" ".join(passage + [f"o{rng.randrange(10**9)}" for _ in range(rng.choice(own))]) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        folder = common.shared_dir(spark)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, 5, 80, folder).collect())
        assert got == brute(texts, 5, 80)
        tables = [p.name for p in Path(folder.removeprefix("file://")).iterdir() if p.name in ("ends", "others") or re.fullmatch(r"pairs-\d+", p.name)]
        pairs = [tuple(r) for t in tables for r in spark.read.parquet(f"{folder}/{t}").collect()]
        assert len(pairs) == len(set(pairs))
        verified[n] = len(pairs)
    assert max(verified.values()) < 4 * 900


def test_pages_of_one_template_are_sought_by_their_rarest_shingles(spark, monkeypatch):
    """A passage in all of them, and sentences that some share: of a set no more shingles are taken than it may have beside a common one."""
    rng = random.Random(17)
    passage, sentences, rows, plain = [f"p{i}" for i in range(330)], [[f"s{i}w{j}" for j in range(20)] for i in range(40)], [], jaccard.without_frequent
    texts = [" ".join(passage + sum(rng.sample(sentences, 9), []) + [f"o{i}"]) for i in range(260)]
    texts += [f"{t} extra{i}" for i, t in enumerate(texts[:40])]
    docs, folder = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), common.shared_dir(spark)

    def counted(*args):
        found = plain(*args)
        rows.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "without_frequent", counted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, 5, 80, folder).collect())
    assert got == brute(texts, 5, 80)
    assert 0 < rows[0] <= spark.read.parquet(f"{folder}/hard").selectExpr("sum(n - least + 1)").first()[0]


def test_nodes_of_small_segments_meet_without_sketches_in_their_rows(spark, monkeypatch):
    """Families whose members share segments and link in part: the same classes both ways, and rows that carry a sketch only for larger segments."""
    rng = random.Random(21)
    texts = []
    for family in range(25):
        base = [f"f{family}w{i}" for i in range(90)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts, 5, 80)
    for narrow in (8, 2):
        monkeypatch.setattr(jaccard, "NARROW", narrow)
        folder = common.shared_dir(spark)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, 5, 80, folder).collect()) == want
        placed = spark.read.parquet(f"{folder}/placed")
        assert placed.count() and "sketch" not in placed.columns
        wide = spark.read.parquet(f"{folder}/wide").count()
        assert wide == 0 if narrow == 8 else 0 < wide < placed.count()
