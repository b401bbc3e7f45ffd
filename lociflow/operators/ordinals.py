"""Positions and running totals of rows in one order, without a task that holds a whole group.

Rows are dealt over range partitions of (group, order), so that a group of any size spreads over many tasks. Each partition's
totals per group are a small table; their running sums are what a partition's rows start from.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.sources.scratch import Scratch, join_same

Order = Sequence[str | Column]


def cumulated(df: DataFrame, by: Sequence[str], order: Order, sums: Mapping[str, str] | None = None, mins: Mapping[str, str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with ``_ordinal``, the 0-based position in its group, and for each output name in ``sums`` and ``mins`` the sum or
    minimum of a column over the rows of the group up to and with this one.

    Nulls in ``by`` are a group. Rows equal in ``order`` take any order among themselves; they still spread over tasks, because a
    row number is the last of the sort keys.
    """
    scratch = scratch or Scratch(df.sparkSession)
    by, sums, mins = list(by), dict(sums or {}), dict(mins or {})
    if not by:  # one group
        return cumulated(df.withColumn("_all", F.lit(0)), ["_all"], order, sums, mins, scratch).drop("_all")
    keys = [F.col(c).asc() for c in by] + [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_salt")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    dealt = scratch.keep(dealt, "dealt")
    totals = {"_ordinal": F.count(F.lit(1)), **{o: F.sum(c) for o, c in sums.items()}, **{o: F.min(c) for o, c in mins.items()}}
    gathered = dealt.groupBy("_part", *by).agg(*[v.alias(f"_total_{o}") for o, v in totals.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [(F.min if o in mins else F.sum)(f"_total_{o}").over(before).alias(f"_before_{o}") for o in totals]
    starts = gathered.select("_part", *by, *carried)
    within = Window.partitionBy("_part", *by).orderBy(*keys[len(by) :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = dealt.withColumns({"_here__ordinal": F.count(F.lit(1)).over(within) - 1, **{f"_here_{o}": F.sum(c).over(within) for o, c in sums.items()}, **{f"_here_{o}": F.min(c).over(within) for o, c in mins.items()}})
    both = join_same(here, starts, ["_part", *by])
    add = lambda o: F.when(F.col(f"_before_{o}").isNull(), F.col(f"_here_{o}")).when(F.col(f"_here_{o}").isNull(), F.col(f"_before_{o}")).otherwise(F.col(f"_before_{o}") + F.col(f"_here_{o}"))
    return both.select(*df.columns, add("_ordinal").alias("_ordinal"), *[add(o).alias(o) for o in sums], *[F.least(f"_before_{o}", f"_here_{o}").alias(o) for o in mins])


def numbered(df: DataFrame, by: Sequence[str], order: Order, out: str = "ordinal", scratch: Scratch | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in its group."""
    return cumulated(df, by, order, scratch=scratch).withColumnRenamed("_ordinal", out)


def paired(left: DataFrame, right: DataFrame, by: Sequence[str], order_left: Order, order_right: Order, scratch: Scratch | None = None) -> DataFrame:
    """The rows of both sides that have the same position in their group: the n-th with the n-th. Further columns must differ in
    name; what one side has more of is left out."""
    scratch = scratch or Scratch(left.sparkSession)
    one, two = numbered(left, by, order_left, "_at", scratch), numbered(right, by, order_right, "_at", scratch)
    return join_same(one, two, [*by, "_at"]).drop("_at")


def midranks(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank", scratch: Scratch | None = None) -> DataFrame:
    """``df`` with the tie-averaged 1-based rank of ``value`` in its group: distinct values are counted first, so that only these
    are ordered. Null values are smallest and tie with one another."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = cumulated(counts, by, [F.col(value).asc_nulls_first()], {"_upto": "_n"}, scratch=scratch)
    ranks = placed.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(out))
    return join_same(df, ranks, [*by, value])


def percentiles(df: DataFrame, value: str, by: Sequence[str], shares: Mapping[str, float], scratch: Scratch | None = None) -> DataFrame:
    """by... and for each output name the exact interpolated percentile of ``value`` in the group: distinct values are counted and
    their counts summed in order, and only those that a share falls on reach the group's own row. Nulls are left out."""
    by, scratch = list(by), scratch or Scratch(df.sparkSession)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = scratch.keep(cumulated(counts, by, ["_v"], {"_upto": "_n"}, scratch=scratch), "placed")
    placed = join_same(placed, placed.groupBy(*by).agg(F.sum("_n").alias("_total")), by)
    at = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    held = lambda place: F.max(F.when((place >= F.col("_upto") - F.col("_n")) & (place < F.col("_upto")), F.col("_v")))
    ends = placed.groupBy(*by).agg(F.max("_total").alias("_total"), *[held(f(at(q))).alias(f"_{side}_{o}") for o, q in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda o, q: F.when(F.col(f"_lo_{o}") == F.col(f"_hi_{o}"), F.col(f"_lo_{o}")).otherwise((F.ceil(at(q)) - at(q)) * F.col(f"_lo_{o}") + (at(q) - F.floor(at(q))) * F.col(f"_hi_{o}"))
    return ends.select(*by, *[between(o, q).alias(o) for o, q in shares.items()])


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), scratch: Scratch | None = None) -> DataFrame:
    """``df`` with ``q``, step-up adjusted p-values in each group: equal p-values have one, so that distinct ones are counted,
    summed upwards and their smallest ratio carried downwards. NULL stays NULL and is no test."""
    by = list(by)
    scratch = scratch or Scratch(df.sparkSession)
    counts = scratch.keep(df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n")), "distinct")
    tests = counts.groupBy(*by).agg(F.sum("_n").alias("_m"))
    ranked = join_same(cumulated(counts, by, [p], {"_rank": "_n"}, scratch=scratch).drop("_ordinal"), tests, by)
    ratio = ranked.withColumn("_ratio", F.col(p) * F.col("_m") / F.col("_rank"))
    falling = cumulated(ratio, by, [F.col(p).desc()], mins={"_least": "_ratio"}, scratch=scratch)
    return join_same(df, falling.select(*by, p, F.least(F.lit(1.0), "_least").alias("q")), [*by, p], "left")
