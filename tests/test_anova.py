import random

import numpy as np

from lociflow.operators import anova


def dense(rows, m):
    y = np.array([r[m] for r in rows])
    total = ((y - y.mean()) ** 2).sum()

    def rss(keys):
        columns = [np.ones(len(y))]
        for k in keys:
            levels = sorted({str(r[k]) for r in rows})
            columns += [np.array([float(str(r[k]) == v) for r in rows]) for v in levels]
        x = np.column_stack(columns)
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return e @ e

    full = rss(range(m))
    return [(rss([j for j in range(m) if j != i]) - full) / total for i in range(m)] + [full / total]


def test_shares_equal_dense_least_squares(spark):
    rng = random.Random(1)
    effect = [{i: rng.gauss(0, 1) for i in range(n)} for n in (40, 3, 25)]
    rows = []
    for _ in range(600):
        a = rng.randrange(40)
        levels = (a, rng.randrange(3), (a + rng.randrange(6)) % 25)  # the third goes with the first
        rows.append((*levels, sum(e[x] for e, x in zip(effect, levels)) + rng.gauss(0, 0.5) + 100))
    rows = [(None if a == 7 else a, b, c, y) for a, b, c, y in rows]
    df = spark.createDataFrame([*rows, (1, 1, 1, None), (1, 1, 1, float("nan"))], "a int, b int, c int, y double").repartition(4)
    out = {r.factor: r.share for r in anova.variance_shares(df, "y", ["a", "b", "c"]).collect()}
    assert np.allclose([out[f] for f in ("a", "b", "c", "residual")], dense(rows, 3), atol=1e-8)
    one = {r.factor: r.share for r in anova.variance_shares(df, "y", ["b"]).collect()}
    assert np.allclose([one["b"], one["residual"]], dense([(r[1], r[3]) for r in rows], 1), atol=1e-8)
    assert anova.variance_shares(df.limit(0), "y", ["a"]).collect() == []
    assert anova.variance_shares(df.selectExpr("a", "1.0 AS y"), "y", ["a"]).collect() == []
