import random

import numpy as np

from lociflow.operators import crossfit, sparse_models


def ridge(x, y, l2=1.0):
    x = np.column_stack([np.ones(len(y)), x])
    penalty = np.diag([0.0] + [l2] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
    return b


def auroc(s, y):
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def test_gains_equal_numpy(spark):
    """Given predictors of all models, the nested fits of every regime and outer fold are those of numpy."""
    rng, folds = random.Random(1), 3
    held = sparse_models.leave_out(folds, 2)
    rows, base = [], []
    for i in range(150):
        y, fold = int(rng.random() < 0.5), rng.randrange(folds)
        rows.append((i, 4, fold, float(y), [rng.gauss(0, 1) + y for _ in held]))
        base.append((i, rng.gauss(0, 1) + 0.5 * y, rng.random()))
    margins = spark.createDataFrame(rows, "row long, `group` int, fold int, label double, z array<double>")
    out = crossfit.contributions(margins, spark.createDataFrame(base, "row long, gc double, h double"), ["gc", "h"], folds).collect()
    y, fold = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    z = lambda v: (v - v.mean(axis=0)) / np.where(v.std(axis=0) > 0, v.std(axis=0), 1)
    found = {}
    for regime in ("base", "published", "crossfit"):
        oof = np.zeros(len(y))
        for outer in range(folds):
            place = lambda f: held.index((f,)) if regime == "published" or f == outer else held.index(tuple(sorted((f, outer))))
            score = np.array([0.0 if regime == "base" else r[4][place(r[2])] for r in rows])
            x = z(np.column_stack([[b[1] for b in base], [b[2] for b in base], score]))
            b = ridge(x[fold != outer], y[fold != outer])
            oof[fold == outer] = np.column_stack([np.ones((fold == outer).sum()), x[fold == outer]]) @ b
        found[regime] = auroc(oof, y)
    (r,) = out
    assert (r.group, r.n_pos + r.n_neg) == (4, 150) and abs(r.auroc_base - found["base"]) < 1e-9
    assert abs(r.gain_published - found["published"] + found["base"]) < 1e-9 and abs(r.gain_crossfit - found["crossfit"] + found["base"]) < 1e-9
