import random

import pytest
from pyspark.sql import functions as F

from lociflow.operators import coverage, tracks


def test_windows_of_any_width_equal_brute_force(spark):
    rng = random.Random(1)
    genes = []
    for _ in range(150):
        a = rng.randint(-500, 5000)
        genes.append((rng.choice(["c1", "c1", "c2", None]), rng.choice("+-"), a, a + rng.choice([0, 5, 90, 900, 7000]), rng.choice([None, 1.5, rng.random() * 9])))
    genes += [("c1", "+", None, 5, 9.0), ("c1", "+", 50, 40, 99.0)]
    windows = []
    for i in range(300):
        a = rng.randint(-700, 6000)
        windows.append((i, rng.choice(["c1", "c2", None, "c3"]), rng.choice("+-"), a, a + rng.choice([0, 1, 100, 3000])))
    windows += [(900, "c1", "+", None, 3), (901, "c1", "+", 9, 3)]
    size = 10
    top = lambda w, strand: max((g[4] or 0.0 for g in genes if g[0] == w[1] and (not strand or g[1] == w[2]) and g[2] is not None and g[3] >= g[2] and g[2] // size <= w[4] // size and w[3] // size <= g[3] // size), default=0.0)
    g = spark.createDataFrame(genes, "chrom string, strand string, start long, end long, tpm double")
    w = spark.createDataFrame(windows, "id int, chrom string, strand string, start long, end long")
    for by, strand in ((["chrom", "strand"], True), (["chrom"], False)):
        got = {r.id: r.top for r in tracks.window_tops(w, g, by, "tpm", size).collect()}
        assert got == {x[0]: top(x, strand) if x[0] < 900 else None for x in windows}
    assert [r.top for r in tracks.window_tops(w.where("id < 2"), g.limit(0), ["chrom"], "tpm", size).collect()] == [0.0, 0.0]
    pairs = tracks.expressed_pairs(w.withColumn("pair", F.col("id") % 40), g, "chrom", "strand", "pair", F.col("id") % 2 == 0, "tpm", size, 2.0)
    want = {}
    for x in windows[:300]:
        if x[0] % 2 == 0 and top(x, True) >= 2:
            want[x[0] % 40] = max(want.get(x[0] % 40, 0), top(x, False))
    assert {r.pair: r.anywhere for r in pairs.collect()} == want


def test_blocks_and_pyramid_agree_and_shuffle_no_pyramid(spark, monkeypatch):
    rng = random.Random(4)
    row = lambda i: (i, rng.choice(["a", "b", None]), *(lambda a: (a, a + rng.choice([0, 7, 300])))(rng.randint(-9000, 9000)), rng.choice([None, -rng.random(), rng.random()]))
    g, w = (spark.createDataFrame([row(i) for i in range(n)], "id int, by string, start long, end long, v double") for n in (60, 300))
    monkeypatch.setattr(tracks, "BLOCK", 32)
    top = lambda: {r.id: r.top for r in tracks.window_tops(w.drop("v"), g, ["by"], "v", 10).collect()}
    plain = tracks.pyramid
    monkeypatch.setattr(tracks, "pyramid", None)
    blocks = top()
    monkeypatch.setattr(tracks, "pyramid", plain)
    monkeypatch.setattr(tracks, "CROWD", 0)
    assert blocks == top()
    wide = [(r.id, max((x.v or 0.0 for x in g.collect() if x.by == r.by and x.start // 10 <= r.end // 10 and r.start // 10 <= x.end // 10), default=0.0)) for r in w.collect()]
    assert blocks == dict(wide)


def test_coverage_is_counted_by_the_job_that_writes(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 200 != 0, F.col("id") * 1.0).alias("score"), F.when(F.col("id") == 7, float("nan")).otherwise(F.lit(1.0)).alias("other"))
    seen = coverage.Coverage(df, "score", {"odd": F.col("id") % 2 == 1, "none": F.lit(None)})
    assert seen.table.count() == 1000
    assert seen.check() == {"n": 1000, "missing": 5, "frac_missing": 0.005, "dropped_odd": 500, "dropped_none": 0}
    assert coverage.written(df, "other", str(tmp_path / "a")).count() == 1000
    with pytest.raises(coverage.CoverageError):
        coverage.written(df, "score", str(tmp_path / "b"), most=0.001)
    empty = coverage.Coverage(df.limit(0), "score")
    assert empty.table.count() == 0 and empty.check()["frac_missing"] == 0.0
