"""Algebra of half-open intervals [start, end) in long columns, per group of keys, and joins on positions.

The sweeps partition by the keys; a key with very many intervals is a sorted, spilling window, not a task's memory. The
range joins turn a range predicate into an equality on bins of the coordinate, so that they hash and shuffle like any
other join and a hot bin can be split; the exact predicate follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def merge(df: DataFrame, by: Keys, gap: int = 0) -> DataFrame:
    """The union of the intervals of each group; touching ones, or those at most ``gap`` apart, become one."""
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    marked = df.select(*by, "start", "end", F.max("end").over(before).alias("_reach"))
    fresh = (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)).cast("long")
    island = marked.select(*by, "start", "end", fresh.alias("_fresh")).withColumn("_island", F.sum("_fresh").over(upto))
    return island.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def gaps(df: DataFrame, by: Keys) -> DataFrame:
    """What lies between the merged intervals of each group."""
    joined = merge(df, by)
    later = Window.partitionBy(*by).orderBy("start")
    return joined.select(*by, F.col("end").alias("start"), F.lead("start").over(later).alias("end")).where("end IS NOT NULL")


def subtract(df: DataFrame, minus: DataFrame, by: Keys) -> DataFrame:
    """The parts of the union of ``df`` that no interval of ``minus`` covers, by a sweep over both sides' ends."""

    def edges(x: DataFrame, a: int, b: int) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct(F.col("end").alias("at"), F.lit(-a).alias("a"), F.lit(-b).alias("b"))))
        return merge(x, by).select(*by, ends.alias("e")).select(*by, "e.*")

    steps = edges(df, 1, 0).unionByName(edges(minus, 0, 1)).groupBy(*by, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*by).orderBy("at")
    state = steps.select(*by, F.col("at").alias("start"), F.lead("at").over(later).alias("end"), F.sum("a").over(upto).alias("in_a"), F.sum("b").over(upto).alias("in_b"))
    return merge(state.where("in_a > 0 AND in_b = 0 AND end IS NOT NULL").select(*by, "start", "end"), by)


def exclusion_zones(df: DataFrame, by: Keys, margin: int) -> DataFrame:
    """The intervals widened by ``margin``, cut at 0, merged."""
    return merge(df.withColumns({"start": F.greatest(F.lit(0), F.col("start") - margin), "end": F.col("end") + margin}), by)


def available(regions: DataFrame, zones: DataFrame, by: Keys, size: int) -> DataFrame:
    """Room for windows of ``size``: regions without the zones, both sides of the subtraction at least that long."""
    roomy = F.col("end") - F.col("start") >= size
    return subtract(regions.where(roomy), zones, by).where(roomy)


def total_length(df: DataFrame, by: Keys) -> DataFrame:
    return merge(df, by).groupBy(*by).agg(F.count(F.lit(1)).alias("intervals"), F.sum(F.col("end") - F.col("start")).alias("bases"))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_join(left: DataFrame, right: DataFrame, by: Keys, width: int, closed: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of intervals that overlap; ``closed`` also takes a right interval that starts where the left one ends.

    ``right`` must have its columns named start2 and end2. Both sides are laid into bins of ``width``; a pair counts in
    the bin where its overlap starts alone, so that it comes once without a distinct. ``how`` is inner, or left_semi or
    left_anti, where a left interval can sit in many bins: those go by the key ``_left`` that the caller has unique.
    """
    touch = F.col("start2") <= F.col("end") if closed else F.col("start2") < F.col("end")
    a = left.withColumn("_bin", _bins(F.col("start"), F.col("end"), width))
    b = right.withColumn("_bin", _bins(F.col("start2"), F.col("end2"), width))
    first = F.floor(F.greatest("start", "start2") / width) == F.col("_bin")
    pairs = a.join(b, [*by, "_bin"]).where(touch & (F.col("end2") > F.col("start")) & first).drop("_bin")
    if how == "inner":
        return pairs
    return left.join(pairs.select("_left").distinct(), "_left", how)


def point_in_interval(points: DataFrame, intervals: DataFrame, by: Keys, width: int, position: str = "pos") -> DataFrame:
    """Points joined with every interval [start2, end2) that holds them."""
    a = points.withColumn("_bin", F.floor(F.col(position) / width))
    b = intervals.withColumn("_bin", _bins(F.col("start2"), F.col("end2") - 1, width))
    return a.join(b, [*by, "_bin"]).where((F.col("start2") <= F.col(position)) & (F.col(position) < F.col("end2"))).drop("_bin")


def smallest_containing(points: DataFrame, intervals: DataFrame, by: Keys, width: int, key: Keys, name: str, position: str = "pos") -> DataFrame:
    """For each point, key columns, the name of the shortest interval that holds it; ties go to the smaller name."""
    found = point_in_interval(points, intervals, by, width, position)
    return found.groupBy(*key).agg(F.min_by(name, F.struct(F.col("end2") - F.col("start2"), F.col(name))).alias(name))


def classify(points: DataFrame, regions: DataFrame, by: Keys, width: int, key: Keys, priority: Sequence[str], position: str = "pos") -> DataFrame:
    """The first region class by ``priority`` that holds each point, null for none."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("region"))
    found = point_in_interval(points, regions, by, width, position).where(rank > 0).groupBy(*key).agg(F.min(rank).alias("_rank"))
    named = F.coalesce(*[F.when(F.col("_rank") == i, F.lit(r)) for i, r in enumerate(priority, 1)])
    return points.join(found, list(key), "left").withColumn("region", named).drop("_rank")


def overlap_bases(windows: DataFrame, regions: DataFrame, by: Keys, width: int, key: Keys) -> DataFrame:
    """Bases of each region class under each window; ``regions`` are disjoint within a class."""
    found = overlap_join(windows, regions, by, width)
    return found.groupBy(*key, "region").agg(F.sum(F.least("end", "end2") - F.greatest("start", "start2")).alias("bases"))


def too_close(pool: DataFrame, targets: DataFrame, by: Keys, margin: int, width: int) -> DataFrame:
    """Rows of ``pool``, unique in ``_left``, within ``margin`` of a target [start2, end2]; inclusive at both sides."""
    padded = targets.withColumns({"start2": F.col("start2") - margin, "end2": F.col("end2") + margin + 1})
    return overlap_join(pool, padded, by, width, closed=True, how="left_semi")


def as_of(left: DataFrame, right: DataFrame, by: Keys, at: str, value: Keys, forward: bool = False) -> DataFrame:
    """Adds the ``value`` columns of the last right row at or before each left row's ``at``, the first at or after it if
    ``forward``. One sorted pass over the union of both sides; no row meets more than its neighbour."""
    packed = F.struct(*value)
    both = left.select("*", F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_right"), F.lit(1).alias("_side")).unionByName(
        right.select(*by, at, packed.alias("_right"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    order = [F.col(at).desc(), F.col("_side")] if forward else [F.col(at), F.col("_side")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in value])


def nearest(points: DataFrame, intervals: DataFrame, by: Keys, position: str = "pos") -> DataFrame:
    """Distance to and strand of the nearer of the two intervals that bracket a position by their starts.

    The distance is 0 inside; the earlier one wins ties. As in the sorted lookup that this stands for, intervals nested
    in others can hide a truly nearer one.
    """
    starts = intervals.select(*by, F.col("start2").alias(position), F.col("start2").alias("_s"), F.col("end2").alias("_e"), F.col("strand2").alias("_t"))
    last = starts.groupBy(*by, position).agg(F.max(F.struct("_e", "_t")).alias("_x")).select(*by, position, F.col(position).alias("_s"), "_x._e", "_x._t")
    before = as_of(points, last, by, position, ["_s", "_e", "_t"]).withColumnsRenamed({"_s": "_s1", "_e": "_e1", "_t": "_t1"})
    both = as_of(before, last, by, position, ["_s", "_e", "_t"], forward=True)
    gap = lambda s, e: F.when(F.col(s).isNotNull(), F.greatest(F.col(s) - F.col(position), F.col(position) - F.col(e) + 1, F.lit(0)))
    d1, d2 = gap("_s1", "_e1"), gap("_s", "_e")
    first = d1.isNotNull() & (d2.isNull() | (d1 <= d2))
    return both.select(*points.columns, F.when(first, d1).otherwise(d2).alias("distance"), F.when(first, F.col("_t1")).otherwise(F.col("_t")).alias("strand"))


def neighbours_within(df: DataFrame, by: Keys, at: str, reach: int, differs: str) -> Column:
    """Whether a row has another within ``reach`` of ``at``, inclusive, whose ``differs`` is not its own."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-reach, reach)
    own = Window.partitionBy(*by, differs).orderBy(at).rangeBetween(-reach, reach)
    return F.count(F.lit(1)).over(w) > F.count(F.lit(1)).over(own)
