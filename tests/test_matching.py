import hashlib
import os
import random

import pytest

from lociflow.operators import matching, sampling
from lociflow.sources.scratch import Scratch


def brute(positives, pool, tolerance):
    """Positives in hash order, each with the nearest vector of its group that has an unused row."""
    free, out = {}, {}
    for g, k, v in pool:
        if v is not None and k is not None and None not in v:
            free.setdefault(g, {}).setdefault(tuple(v), []).append(k)
    first = {(g, v): min(ks) for g, vs in free.items() for v, ks in vs.items()}
    for g, k, v in sorted((p for p in positives if p[2] is not None and None not in p[2]), key=lambda p: (hashlib.sha256(f"match|{p[1]}".encode()).hexdigest(), p[1])):
        near = min(((sum(abs(a - b) for a, b in zip(v, w)), first[g, w], w) for w, ks in free.get(g, {}).items() if ks), default=None)
        if near and (tolerance is None or near[0] <= tolerance):
            ks = free[g][near[2]]
            out[k] = (min(ks), near[0])
            ks.remove(min(ks))
    return out


def tables(rng, n, m, width, spread):
    centres = [[rng.randint(0, 30) for _ in range(width)] for _ in range(4)]
    vector = lambda: [float(x + rng.randint(-spread, spread)) for x in rng.choice(centres)]
    groups = ["hot", "hot", "hot", "b", None]
    positives = [(rng.choice(groups), i, vector()) for i in range(n)] + [("lonely", n, vector()), ("hot", n + 1, None), ("hot", n + 2, [None] * width)]
    positives += [("hot", n + 10 + i, [5.0] * width) for i in range(n // 3)]  # copies
    pool = [(rng.choice(groups), 10_000 + i, vector()) for i in range(m)] + [("hot", 50_000 + i, [6.0] * width) for i in range(n // 6)] + [("hot", 9, None)]
    return positives, pool


@pytest.mark.parametrize("seed,n,m,width,spread,tolerance,k,cut", [(1, 50, 200, 16, 2, None, 16, 20_000), (2, 40, 30, 3, 4, None, 2, 7), (3, 90, 200, 1, 9, 3.0, 4, 50)])
def test_rounds_equal_serving_one_after_another(spark, monkeypatch, seed, n, m, width, spread, tolerance, k, cut):
    monkeypatch.setattr(matching, "SLICE", cut)
    monkeypatch.setattr(matching, "HELD", 500)
    positives, pool = tables(random.Random(seed), n, m, width, spread)
    make = lambda rows: spark.createDataFrame([(*r, 0) for r in rows], "g string, id long, x array<double>, cand int").repartition(4)
    out = matching.match_vectors(make(positives), make(pool), ["g"], "x", "id", tolerance, k).collect()
    assert {r.k: (r.match, r.gap) for r in out} == brute(positives, pool, tolerance) and len({r.match for r in out}) == len(out)


def test_no_slice_of_queries_makes_more_visits_than_a_task_holds(spark):
    queries, cells = spark.range(60_000).selectExpr("id % 2 AS gid", "id"), spark.range(3_000).selectExpr("0L AS gid", "id AS cell")
    slices = {r.gid: r.slices for r in matching.loads_of(queries, cells).select("gid", matching._slices("total").alias("slices")).collect()}
    assert 30_000 * 3_000 <= slices[0] * matching.VISITS and slices[1] == 2  # no cells: as many as before


def test_nothing_to_match(spark):
    df = spark.createDataFrame([("a", 1, [1.0])], "g string, id long, x array<double>")
    assert matching.match_vectors(df, df.limit(0), ["g"], "x", "id").collect() == []
    assert matching.match_vectors(df.limit(0), df, ["g"], "x", "id").collect() == []
    one = df.selectExpr("g", "id", "x[0] AS v")
    assert [(r.k, r.match, r.gap) for r in sampling.match_nearest(one, one, ["g"], "v", "id", 0.5).collect()] == [(1, 1, 0.0)]


def test_bounds_are_near_the_neighbours(spark):
    rng = random.Random(4)
    rows = [(0, i, [float(rng.randint(0, 100)) for _ in range(6)], i) for i in range(1_000)]
    make = lambda rows: spark.createDataFrame(rows, "gid long, id long, v array<double>, first long")
    scratch = Scratch(spark)
    placed, pivots = matching.cells_of(make(rows), scratch)
    asked = [(0, 5_000 + i, [float(rng.randint(0, 100)) for _ in range(6)], i) for i in range(40)]
    lists = matching.neighbours(make(asked), placed, matching.summary(placed, pivots, 4, scratch), 4, None, scratch)
    away = {q[1]: sorted((sum(abs(a - b) for a, b in zip(q[2], r[2])), r[1]) for r in rows)[:4] for q in asked}
    assert {r.id: [(x.gap, x["first"]) for x in r.list] for r in lists.collect()} == away
    folder = scratch.path.removeprefix("file://")
    last = max((f"{folder}/{t}" for t in os.listdir(folder) if t.startswith("visits-")), key=os.path.getmtime)
    bound = {r.id: r.bound for r in spark.read.parquet(last).collect()}
    assert sum(b / away[i][-1][0] for i, b in bound.items()) / len(bound) < 1.25
