import random

from pyspark.sql import functions as F

from lociflow.operators import ordinals


def test_positions_and_running_totals_equal_a_loop_whatever_the_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randint(0, 40), rng.choice([None, 1, 2, 5]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x int, v int, i int").repartition(6)
    out = ordinals.cumulated(df, ["g"], [F.col("x").desc(), "i"], {"total": "v"}, {"least": "v"}).collect()
    want = {}
    for g in ("a", "b", None):
        total = least = None
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[3]))):
            if r[2] is not None:
                total, least = (total or 0) + r[2], r[2] if least is None else min(least, r[2])
            want[r[3]] = (n, total, least)
    assert {r.i: (r._ordinal, r.total, r.least) for r in out} == want
    alone = ordinals.numbered(df.select("x", "i"), [], ["x", "i"]).collect()
    assert [r.i for r in sorted(alone, key=lambda r: r.ordinal)] == [r[3] for r in sorted(rows, key=lambda r: (r[1], r[3]))]
    assert ordinals.numbered(df.limit(0), ["g"], ["x"]).collect() == []


def test_equal_rows_of_one_key_spread_over_tasks(spark):
    df = spark.range(40_000).select(F.lit("k").alias("g"), F.lit(7).alias("x"))
    out = ordinals.numbered(df, ["g"], ["x"])
    assert out.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first() == (40_000, 0, 39_999)
    dealt = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in dealt) < 40_000


def test_pairs_are_by_position(spark):
    a = spark.createDataFrame([("x", i) for i in (5, 1, 3)] + [("y", 1), (None, 9)], "g string, a int")
    b = spark.createDataFrame([("x", c) for c in "qpz"] + [("y", "s"), ("y", "t"), (None, "n"), ("w", "w")], "g string, b string")
    out = {(r.g, r.a, r.b) for r in ordinals.paired(a, b, ["g"], ["a"], ["b"]).collect()}
    assert out == {("x", 1, "p"), ("x", 3, "q"), ("x", 5, "z"), ("y", 1, "s"), (None, 9, "n")}


def test_midranks_and_corrected_p_values_equal_windows(spark):
    from lociflow.operators import rankstats

    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice("ab"), rng.choice([None, 0.01, 0.02, 0.5, rng.random()])) for i in range(400)], "i int, g string, p double")
    one = {r.i: round(r["rank"], 9) for r in ordinals.midranks(df, "p", ["g"]).collect()}
    assert one == {r.i: r.m for r in df.select("i", rankstats.midrank(F.col("p"), ["g"]).alias("m")).collect()}
    got = {r.i: r.q for r in ordinals.benjamini_hochberg(df, "p", ["g"]).collect()}
    want = {r.i: r.q for r in rankstats.benjamini_hochberg(df, "p", ["g"]).collect()}
    assert got.keys() == want.keys() and all(a == b or abs(a - b) < 1e-12 for a, b in ((got[i], want[i]) for i in got))


def test_percentiles_are_those_of_the_whole_group(spark):
    rows = [("a", float(i % 7)) for i in range(50)] + [("b", 1.0), ("b", None), (None, 2.0), (None, 3.5), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p, r.q, r.r) for r in ordinals.percentiles(df, "v", ["g"], {"p": 0.1, "q": 0.5, "r": 0.9}).collect()}
    want = {r.g: (r.p, r.q, r.r) for r in df.where("v IS NOT NULL").groupBy("g").agg(*[F.percentile("v", F.lit(s)).alias(n) for n, s in (("p", 0.1), ("q", 0.5), ("r", 0.9))]).collect()}
    assert got == want


def test_group_statistics_without_a_task_per_group(spark):
    """No aggregate that gathers all values of a group or of a column in one state."""
    from lociflow.operators import audit, panels

    df = spark.createDataFrame([("a", 1.0, 2.0, True), ("a", 4.0, None, False), (None, 3.0, 5.0, None)], "g string, w double, s double, p boolean")
    found = panels.peak_stats(df, "g", F.col("w"), 2, "s", F.col("p"))
    assert {r.g: tuple(r)[1:] for r in found.collect()} == {"a": (2, 2, 1, 3, 4, 0.5, 2.0, 2.0, 0.5), None: (1, 3, 3, 3, 3, 1.0, 5.0, 5.0, None)}
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    table = audit.profile(df)
    assert {r.column: tuple(r)[2:] for r in table.collect()} == {"g": (1, 1, "a", "a"), "w": (0, 3, "1.0", "4.0"), "s": (1, 2, "2.0", "5.0"), "p": (1, 2, "false", "true")}
    assert "Expand" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[2:] for r in audit.profile(df.where("false")).collect()] == [(0, 0, None, None)] * 4
