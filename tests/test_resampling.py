import random

import numpy as np

from lociflow.operators import resampling
from lociflow.operators.grouped_fits import draw_weights


def weighted_auc(s, y, w):
    p, n = (w * (y == 1)), (w * (y == 0))
    with np.errstate(invalid="ignore"):
        return sum(p[i] * (n[s < s[i]].sum() + n[s == s[i]].sum() / 2) for i in range(len(s))) / (p.sum() * n.sum())


def test_draws_of_tied_scores_over_many_partitions_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    for held, values in ((7, [0.0, 1.0, 2.0]), (8192, [i / 50 for i in range(60)]), (5, [3.0])):
        monkeypatch.setattr(resampling, "HELD", held)
        rows = [(rng.choice(["a", "a", None]), rng.choice(values) + (rng.random() if rng.random() < 0.1 else 0.0), rng.choice(values), int(rng.random() < 0.4), f"b{rng.randrange(25)}") for _ in range(400)]
        df = spark.createDataFrame(rows + [("a", None, 1.0, 1, "b"), ("a", 1.0, float("nan"), 1, "b"), ("a", 1.0, 1.0, None, "b")], "g string, s double, t double, y int, block string").repartition(6)
        hashes = {r.block: r.h for r in df.selectExpr("block", "xxhash64(block) AS h").distinct().collect()}
        out = {r.g: r for r in resampling.paired_bootstrap(df, "s", "t", "y", ["block"], ["g"], draws=30).collect()}
        for g in ("a", None):
            own = [r for r in rows if r[0] == g]
            s, t, y = (np.array([r[i] for r in own]) for i in (1, 2, 3))
            w = draw_weights(np.array([hashes[r[4]] for r in own]), np.arange(31))
            one, two = ([weighted_auc(x, y, w[:, b]) for b in range(31)] for x in (s, t))
            d = np.array(one[1:]) - np.array(two[1:])
            assert abs(out[g].auc1 - one[0]) < 1e-12 and abs(out[g].auc2 - two[0]) < 1e-12
            assert abs(out[g].sd - d.std(ddof=1)) < 1e-12
            assert np.allclose([out[g].low, out[g].high], np.percentile(d, [2.5, 97.5]), atol=1e-12)
            assert abs(out[g].p - max(1 / 30, min(1, 2 * min((d <= 1e-15).mean(), (d >= -1e-15).mean())))) < 1e-9
            assert out[g].se == 0 or abs(out[g].design_effect - out[g].sd / out[g].se) < 1e-12


def test_means_of_weighted_blocks(spark):
    rng = random.Random(2)
    rows = [(f"b{rng.randrange(30)}", rng.choice([None, rng.random()])) for _ in range(300)]
    df = spark.createDataFrame(rows, "block string, v double").repartition(5)
    hashes = {r.block: r.h for r in df.selectExpr("block", "xxhash64(block) AS h").distinct().collect()}
    out = {r.draw: r["mean"] for r in resampling.weighted_means(df, "v", ["block"], 40).collect()}
    own = [r for r in rows if r[1] is not None]
    w = draw_weights(np.array([hashes[r[0]] for r in own]), np.arange(41))
    v = np.array([r[1] for r in own])
    assert sorted(out) == list(range(41)) and all(abs(out[i] - (w[:, i] @ v) / w[:, i].sum()) < 1e-12 for i in out)
    assert {r["mean"] for r in resampling.weighted_means(df.limit(0), "v", ["block"], 3).collect()} <= {None}
