import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from lociflow.operators import contribution, panels, windows


def newton(x, y, l2=0.0, steps=60):
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [l2] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
    return beta


def loglik(beta, x, y):
    p = 1 / (1 + np.exp(-(np.column_stack([np.ones(len(x)), x]) @ beta)))
    return float(np.sum(np.where(y == 1, np.log(p), np.log(1 - p))))


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)).round(2)
    y = (x[:, 0] + 0.7 * x[:, 1] + rng.normal(size=240) > 0).astype(int)
    rows = [(i, i % 3, int(y[i]), *map(float, x[i])) for i in range(240)]
    return spark.createDataFrame(rows, "id long, fold int, y int, a double, b double, c double"), x, y


def test_chi_square_tail():
    for df, x, p in ((1, 3.841458821, 0.05), (2, 5.991464547, 0.05), (3, 7.814727903, 0.05), (4, 9.487729037, 0.05), (5, 15.08627247, 0.01)):
        assert math.isclose(contribution.chi_square_tail(x, df), p, rel_tol=1e-6)
    assert contribution.chi_square_tail(0.0, 2) == contribution.chi_square_tail(-1.0, 1) == 1.0


def test_likelihood_ratio(drawn):
    df, x, y = drawn
    r = contribution.likelihood_ratio(df, ["a"], ["b", "c"], "y").first()
    one, two = loglik(newton(x[:, :1], y), x[:, :1], y), loglik(newton(x, y), x, y)
    assert math.isclose(r.loglik_base, one, rel_tol=1e-8) and math.isclose(r.loglik_full, two, rel_tol=1e-8)
    assert (r.n, r.df) == (240, 2) and math.isclose(r.ratio, 2 * (two - one), rel_tol=1e-6) and math.isclose(r.p, math.exp(-(two - one)), rel_tol=1e-6)
    alone = contribution.likelihood_ratio(df.where("y = 1"), ["a"], ["b"], "y").first()
    assert alone.ratio is None and alone.p is None


def test_nested_contribution(drawn):
    df, x, y = drawn
    r = contribution.nested_contribution(df, ["a"], ["b"], "y", "fold", 3).first()
    fold, z = np.arange(240) % 3, {1: np.zeros(240), 2: np.zeros(240)}
    for k in range(3):
        for d in (1, 2):
            beta = newton(x[fold != k][:, :d], y[fold != k], 1.0)
            z[d][fold == k] = np.column_stack([np.ones(80), x[fold == k][:, :d]]) @ beta
    auc = {d: np.mean([(p > n) + (p == n) / 2 for p in v[y == 1] for n in v[y == 0]]) for d, v in z.items()}
    assert math.isclose(r.auc_base, auc[1], rel_tol=1e-9) and math.isclose(r.auc_full, auc[2], rel_tol=1e-9) and math.isclose(r.gain, auc[2] - auc[1], abs_tol=1e-9)
    p = {d: 1 / (1 + np.exp(-v)) for d, v in z.items()}
    gap = {d: v[y == 1].mean() - v[y == 0].mean() for d, v in p.items()}
    assert math.isclose(r.discrimination, gap[2] - gap[1], abs_tol=1e-9)
    ll = {d: np.sum(np.where(y == 1, np.log(v), np.log(1 - v))) for d, v in p.items()}
    assert math.isclose(r.deviance_gain, 2 * (ll[2] - ll[1]), rel_tol=1e-8)


def test_all_pairs(drawn):
    df, x, y = drawn
    rows = {(r.one, r.two): r for r in contribution.all_pairs(df, ["a", "b", "c"], "y").collect()}
    assert set(rows) == {("a", "b"), ("a", "c"), ("b", "c")}
    ranked = sorted(rows.values(), key=lambda r: r.p)
    want, least = [], 1.0
    for i in (3, 2, 1):
        least = min(least, ranked[i - 1].p * 3 / i)
        want.append(least)
    assert np.allclose([r.q for r in ranked], want[::-1])


def test_accepted_relaxes_and_falls_back(spark):
    tries = [(1, 0, 0.5), (1, 1, 0.05), (1, 2, 0.01), (2, 0, 0.15), (2, 2, 0.15), (3, 0, 0.25), (3, 1, 0.22), (4, 0, 0.9), (5, None, None)]
    got = windows.accepted(spark.createDataFrame(tries, "k int, t int, g double"), "k", "t", "g", 0.1, 2)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0.05, False), (2, 2, 0.15, False), (3, 1, 0.22, True)]


def test_shuffle_keeps_letters_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "ACGUACGGU"), (2, ""), (3, None)], "k int, s string")
    got = {r.k: r.x for r in df.select("k", windows.letters_shuffled(df.s, df.k, "x").alias("x")).collect()}
    assert sorted(got[1]) == sorted("ACGUACGGU") and got[1] != "ACGUACGGU" and got[2] == ""
    empty = spark.createDataFrame([], "k int, fold int, g array<string>")
    assert panels.shared_across_folds(empty, "k", "fold", "g").count() == 0


def test_shuffle_sorts_places_by_their_hash_in_batches(spark):
    from hashlib import md5

    text = "AC😀é" * 500
    df = spark.createDataFrame([(7, text)], "k int, s string").select(windows.letters_shuffled(F.col("s"), F.col("k"), "x").alias("x"))
    want = "".join(text[i] for i in sorted(range(len(text)), key=lambda i: md5(f"x|7|{i}".encode()).hexdigest()))
    assert df.first().x == want
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()  # an interpreted comparison of structs took most of the time


def test_grams_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, 0, ["a", "b", None]), (2, 1, ["b", "b", "c"]), (3, 1, ["c", None]), (4, 0, None)], "k int, fold int, g array<string>")
    found = panels.shared_across_folds(df, "k", "fold", "g")
    assert {r.k: r.share for r in found.collect()} == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # rows of grams were made for a count and again for a join
