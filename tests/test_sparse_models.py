import os
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lociflow.operators import sparse_models
from lociflow.sources.scratch import Scratch


def dense(texts, y, folds, k, n_folds, l2=1.0):
    """Weights and out-of-fold scores by Newton steps on the dense matrix of counts."""
    names = sorted({t[i : i + k] for t in texts for i in range(len(t) - k + 1)})
    at = {m: i for i, m in enumerate(names)}
    x = np.zeros((len(texts), len(names) + 1))
    x[:, -1] = 1
    for r, t in enumerate(texts):
        for i in range(len(t) - k + 1):
            x[r, at[t[i : i + k]]] += 1
    penalty = np.full(len(names) + 1, l2)
    penalty[-1] = 0
    y, folds, score, models = np.array(y, float), np.array(folds), np.full(len(y), np.nan), {}
    for f in range(n_folds):
        own = folds != f
        if len(set(y[own])) < 2:
            continue
        b = np.zeros(len(names) + 1)
        loss = lambda b: (np.logaddexp(0, x[own] @ b) - y[own] * (x[own] @ b)).sum() + (penalty * b * b).sum() / 2
        for _ in range(200):
            p = 1 / (1 + np.exp(-x[own] @ b))
            g = x[own].T @ (p - y[own]) + penalty * b
            step = np.linalg.solve(x[own].T @ (x[own] * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-12), g)
            t = 1.0
            while loss(b - t * step) > loss(b) and t > 1e-6:
                t /= 2
            b = b - t * step
            if np.abs(g).max() < 1e-10:
                break
        models[f] = dict(zip(names, b)) | {None: b[-1]}
        score[folds == f] = x[folds == f] @ b
    return models, score


def data(rng, n):
    texts = ["".join(rng.choices("ACGU", k=rng.choice([0, 2, 12, 30]))) for _ in range(n)]
    texts = [t[:5] + "GGA" + t[5:] if rng.random() < 0.3 else t for t in texts]
    y = [int(("GGA" in t) != (rng.random() < 0.2)) for t in texts]
    return texts, y, [rng.randrange(4) for _ in texts]


def test_all_sizes_and_folds_equal_dense_fits(spark):
    texts, y, folds = data(random.Random(1), 90)
    rows = [(i, t, a, f, "z") for i, (t, a, f) in enumerate(zip(texts, y, folds))]
    extra = [(1000, None, 1, 0, "z"), (1001, "ACGU", None, 0, "z"), (1002, "ACGU", 1, None, "z")]
    df = spark.createDataFrame(rows + extra, "id long, seq string, y int, f int, group string").repartition(5)
    weights, margins = sparse_models.kmer_models(df, "id", "seq", "y", "f", 4, [1, 2, 3], tolerance=1e-8)
    got = {(r.group, r.row): r.score for r in sparse_models.out_of_fold(margins).collect()}
    w = {(r.k, r.kmer): r.w for r in weights.collect()}
    assert len(got) == 3 * 91
    for k in (1, 2, 3):
        models, want = dense(texts + [""], y + [1], folds + [0], k, 4)
        assert max(abs(got[k, i] - want[i]) for i in range(len(texts))) < 1e-6 and abs(got[k, 1000] - want[-1]) < 1e-6
        assert all(abs(w[k, m][f] - b) < 1e-6 for f, model in models.items() for m, b in model.items())


def test_folds_without_two_classes_and_no_rows(spark):
    df = spark.createDataFrame([(1, "AC", 1, 0), (2, "CA", 0, 1), (3, "CC", 0, 1)], "id long, seq string, y int, f int")
    _, margins = sparse_models.kmer_models(df, "id", "seq", "y", "f", 2, [1])
    assert [r.score for r in sparse_models.out_of_fold(margins).collect()] == [None] * 3
    weights, margins = sparse_models.kmer_models(df.limit(0), "id", "seq", "y", "f", 2, [1])
    assert margins.collect() == [] and weights.collect() == []


def test_cross_fitted_scores_saw_neither_fold(spark):
    texts, y, folds = data(random.Random(2), 60)
    df = spark.createDataFrame(list(zip(range(60), texts, y, folds)), "id long, seq string, y int, f int")
    _, margins = sparse_models.kmer_models(df, "id", "seq", "y", "f", 4, [2], together=2, l2=4.0, tolerance=1e-8)
    got = {(r.outer, r.row): r.score for r in sparse_models.cross_fitted(margins, 4).collect()}
    assert len(got) == 4 * 60
    published = dense(texts, y, folds, 2, 4, 4.0)[1]
    for i in range(4):
        for j in range(4):
            # the rows of both folds are one fold, which is left out
            want = dense(texts, y, [9 if f in (i, j) else f for f in folds], 2, 10, 4.0)[1] if i != j else published
            assert all(abs(got[i, r] - want[r]) < 1e-6 for r in range(60) if folds[r] == j)


def test_deltas_equal_full_scoring(spark):
    rng = random.Random(3)
    texts, y, folds = data(rng, 40)
    df = spark.createDataFrame(list(zip(range(40), texts, y, folds)), "id long, seq string, y int, f int")
    weights, _ = sparse_models.kmer_models(df, "id", "seq", "y", "f", 4, [2, 3], tolerance=0.01)
    rows = []
    for i in range(60):
        ref = "".join(rng.choices("ACGU", k=rng.choice([0, 1, 9, 40])))
        at = rng.randrange(len(ref) + 1)
        alt = ref[:at] + "".join(rng.choices("ACGUN", k=rng.choice([0, 1, 1, 3]))) + ref[at + rng.choice([0, 1, 1, 2]) :]
        rows.append((i, ref, alt, rng.choice([0, 1, 2, 3, None, 9])))
    rows.append((99, None, "A", 1))
    variants = spark.createDataFrame(rows, "vid long, ref_seq string, alt_seq string, fold int")
    got = {(r.vid, r.k): r.delta for r in sparse_models.variant_delta(variants, weights).collect()}
    full = {}
    for side in ("ref_seq", "alt_seq"):
        cells = sparse_models.kmer_cells(variants, "vid", side, [2, 3]).withColumnRenamed("vid", "row")
        for r in sparse_models.scored(cells, variants.select(F.col("vid").alias("row"), "fold"), weights).collect():
            full[side, r.row, r.k] = r.score
    assert len(got) == 2 * len(rows)
    for vid, ref, alt, fold in rows:
        for k in (2, 3):
            if ref is None or fold not in (0, 1, 2, 3):
                assert got[vid, k] is None
            else:
                assert abs(got[vid, k] - (full["ref_seq", vid, k] - full["alt_seq", vid, k])) < 1e-9
    assert sparse_models.changed("AAAA", "AAA", 2) == ((2, 4), (2, 3))


def test_kmers_of_many_texts_equal_those_of_each():
    rng = random.Random(5)
    for _ in range(60):
        texts = ["".join(rng.choices("abä\x00z𝄞 ", k=rng.choice([0, 1, 2, 5, 40]))) for _ in range(rng.randint(0, 6))]
        for k in (1, 2, 5):
            which, names, n = sparse_models.count_kmers(texts, k)
            want = Counter((i, t[j : j + k]) for i, t in enumerate(texts) for j in range(len(t) - k + 1))
            assert Counter({(i, m): c for i, m, c in zip(which.tolist(), names.to_pylist(), n.tolist())}) == want and len(n) == len(want)
    assert len(sparse_models.count_kmers(["".join(map(chr, range(0x4E00, 0x9000)))] * 3, 5)[2]) == 3 * (0x9000 - 0x4E00 - 4)


def test_rows_that_hold_their_cells_fit_as_joined_ones_and_are_not_broadcast(spark, monkeypatch):
    texts, y, folds = data(random.Random(6), 60)
    df = spark.createDataFrame([(i, t, a, f) for i, (t, a, f) in enumerate(zip(texts, y, folds))], "id long, seq string, y int, f int")
    fit = lambda: {(r.group, r.row): r.z for r in sparse_models.kmer_models(df, "id", "seq", "y", "f", 4, [1, 2], per=101.0, tolerance=0.05)[1].collect()}
    gathered = sparse_models._fit_gathered
    used = []
    monkeypatch.setattr(sparse_models, "_fit_gathered", lambda *a: used.append(1) or gathered(*a))
    own = fit()
    assert used == [1]
    monkeypatch.setattr(sparse_models, "BROADCAST_BYTES", 0)
    joined = fit()
    assert used == [1] and len(own) == 120 and own.keys() == joined.keys()
    assert max(abs(a - b) for x in own for a, b in zip(own[x], joined[x])) < 1e-6


def test_disk_does_not_grow_with_the_steps(spark, monkeypatch):
    texts, y, folds = data(random.Random(7), 50)
    df = spark.createDataFrame(list(zip(range(50), texts, y, folds)), "id long, seq string, y int, f int")

    def tables():
        scratch = Scratch(spark)
        sparse_models.kmer_models(df, "id", "seq", "y", "f", 4, [1, 2], per=101.0, steps=4, scratch=scratch)
        return Counter(t.rsplit("-", 1)[0] for t in os.listdir(scratch.path.removeprefix("file://")))

    assert tables() == {"vocabulary": 1, "whole": 1, "margins": 1}  # no cells, and no weights of a step
    monkeypatch.setattr(sparse_models, "BROADCAST_BYTES", 0)
    joined = tables()
    assert joined["features"] == joined["margins"] == 1


def test_packed_rows_hold_all_cells(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abä\x00z𝄞 ", k=rng.choice([0, 1, 2, 5, 400]))) for _ in range(30)] + [None]
    df = spark.createDataFrame([(i, t, i % 3, 1.0) for i, t in enumerate(texts)], "row long, seq string, fold int, label double").repartition(3)
    names = {k: sparse_models.distinct_kmers([t or "" for t in texts], k) for k in (1, 3)}
    got = {}
    for batch in sparse_models.packed(df, [1, 3], spark.sparkContext.broadcast(names), 101.0).toArrow().combine_chunks().to_batches():
        for part in sparse_models._parts(batch):
            _, at, n, sizes = part
            owner = np.repeat(np.arange(len(sizes)) + part[0].start, sizes)
            rows, group = batch.column("row").to_pylist(), batch.column("group").to_pylist()
            got |= {(rows[o], names[group[o]][int(a)].as_py()): x for o, a, x in zip(owner, at, n)}
    want = {(r.row, r.kmer): r.n for r in sparse_models.kmer_cells(df, "row", "seq", [1, 3], 101.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - x) < 1e-12 * x for c, x in want.items())
    for numbers in ([], [0, 0], [1, 300, 0], [2**32 - 1, 5]):
        assert sparse_models._numbers_of([sparse_models._bytes_of(np.array(numbers, np.int64))], [len(numbers)]).tolist() == numbers
