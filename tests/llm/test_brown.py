import math
import zlib
from collections import Counter

import numpy as np

from lociflow.llm import brown, common


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, word string")


def test_base_score_and_probabilities(spark):
    import random

    rng = random.Random(1)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    texts = [" ".join(rng.choice(v) for _ in range(40)) for v in (a, b) for _ in range(60)] + [None, "", "Neu UNSEEN zzz", "a1 A1\n\x0ba1"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in brown.score(docs(spark, rows), words=60, endings=5, listed=70, classes=6, rounds=20).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in enumerate(texts) if not held(i) for w in brown.tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        ws = brown.tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert r.held_out == held(i) and r.n_tokens == len(ws) and r.n_known == sum(w in count for w in ws) and r.train_tokens == n
        assert abs(r.base_score - base) < 1e-6
    total = lambda c: sum(r[c] for i, r in got.items() if i < 120 and r.held_out)
    assert total("score") > total("base_score") + 20  # the two vocabularies are found as classes


def test_transitions_and_emissions_sum_to_one(spark):
    rows = [(i, "x y z x y w q" if i % 2 else "q w e r t", "x") for i in range(60)]
    model = brown.fit(docs(spark, rows), common.shared_dir(spark), words=3, endings=2, listed=4, classes=4, rounds=3)
    assert np.allclose((10**model.transitions).sum(axis=1), 1)
    mass = np.zeros(4)
    for r in model.counts.collect():
        k = model.unit_class[model.units.of(bytes(r.word))]
        mass[k] += 10 ** (math.log10(r.c + brown.EMISSION) - model.share[k])
    unknown = brown.EMISSION / 10**model.share
    assert np.allclose(mass + unknown, 1)


def test_best_class_equals_full_recount():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 9, (12, 12)).astype(float)
    cls = rng.integers(0, 4, 12)

    def likelihood(c):
        m = np.zeros((4, 4))
        np.add.at(m, (c[:, None].repeat(12, 1), c[None, :].repeat(12, 0)), n)
        return brown._xlogx(m).sum() - brown._xlogx(m.sum(0)).sum() - brown._xlogx(m.sum(1)).sum(), m

    for u in range(12):
        others = np.arange(12) != u
        right, left = np.bincount(cls[others], n[u, others], 4), np.bincount(cls[others], n[others, u], 4)
        found, gain = brown.best_class(int(cls[u]), left, right, n[u, u], likelihood(cls)[1])
        moved = [likelihood(np.where(np.arange(12) == u, k, cls))[0] for k in range(4)]
        assert abs(max(moved) - likelihood(cls)[0] - gain) < 1e-8 and abs(moved[found] - max(moved)) < 1e-8


def test_empty_table(spark):
    assert brown.score(docs(spark, [])).collect() == []


def test_best_classes_equals_best_class_of_each_word():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 9, (40, 40)).astype(float) * (rng.random((40, 40)) < 0.3)
    cls = rng.integers(0, 5, 40)
    between = np.zeros((5, 5))
    np.add.at(between, (cls[:, None].repeat(40, 1), cls[None, :].repeat(40, 0)), n)
    others = [np.arange(40) != u for u in range(40)]
    left = np.array([np.bincount(cls[o], n[o, u], 5) for u, o in enumerate(others)])
    right = np.array([np.bincount(cls[o], n[u, o], 5) for u, o in enumerate(others)])
    found = brown.best_classes(cls, left, right, np.diag(n), between)
    checked = 0
    for u in range(40):
        want, gain = brown.best_class(int(cls[u]), left[u], right[u], n[u, u], between)
        if want and gain > 1e-9:
            checked += 1
            assert found[u] == want
    assert checked > 10


def test_further_words_follow_their_neighbours_not_their_endings(spark, monkeypatch):
    import random

    rng = random.Random(2)
    a, b = [f"a{i}" for i in range(8)], [f"b{i}" for i in range(8)]
    texts = []
    for i in range(300):  # rare words of one ending stand among words of either kind
        of, rare = (a, "p") if i % 2 else (b, "q")
        texts.append(" ".join(rng.choice(of) if rng.random() < 0.8 else f"{rare}{rng.randrange(20)}xyz" for _ in range(30)))
    rows = docs(spark, [(i, t, "x") for i, t in enumerate(texts)])
    options = dict(words=16, endings=1, listed=18, classes=3, rounds=8)
    classes = {}
    for r in brown.learn(rows, common.shared_dir(spark), **options).counts.collect():
        classes.setdefault(bytes(r.word)[:1], set()).add(r.k)
    assert len(classes[b"p"]) == len(classes[b"q"]) == 1 and classes[b"p"] != classes[b"q"]
    count = Counter(w for t in texts for w in brown.tokens(t))
    monkeypatch.setattr(brown, "HELD", 3)
    again = brown.learn(rows, common.shared_dir(spark), **options)
    assert {bytes(r.word): r.c for r in again.counts.collect()} == count
    laid = {r.doc_id: r for r in brown.lay(rows, again, common.shared_dir(spark), "laid").collect()}
    k = {bytes(r.word): r.k for r in again.counts.collect()}
    assert all(list(laid[i].ks) == [k[w] for w in brown.tokens(t)] for i, t in enumerate(texts))


def test_neighbours_of_a_word_come_in_few_rows(spark):
    units = brown.Units([b"a", b"b"], [])
    rows = docs(spark, [(i, "a zz b zz zz\x0bA zz", "x") for i in range(50)]).coalesce(1)
    assert brown.tokens("A\x0bb\x1cc\x85 \xa0É") == [b"a", "b\x1cc\x85".encode(), "\xa0É".encode(), b""]
    got = brown.count_neighbours(rows, units, np.array([0, 1, 2, 2]), 3).collect()
    assert [bytes(r.word) for r in got] == [b"zz"]  # a row for each key before
    # after a, b, itself; before the end, a, b
    assert dict(zip(got[0].key, got[0].n)) == {1: 100, 2: 50, 3: 50, 4: 50, 5: 50, 6: 50}
    assert {(r.u, r.v): r.n for r in brown.count_pairs(rows, units).collect()} == {(0, 1): 50, (1, 3): 100, (3, 2): 50, (2, 3): 50, (3, 3): 50, (3, 1): 50, (3, 0): 50}
