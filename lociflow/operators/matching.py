"""Matched sets without reuse: every positive gets the nearest unused candidate of its group, in an order drawn by hash.

Serving positives one after another is a chain that no cluster shortens. The same matching is the one stable outcome of rounds in
which all unserved positives propose to their nearest candidate left and a candidate keeps the proposer that is first in the
order. Equal vectors are one type: candidates of a type are one party with that many places.

Nearest neighbours are exact: candidate types are dealt to the nearest of about sqrt(n) pivots; a positive's distances to the
pivots, with each cell's smallest radii, bound how far its neighbours can be. It is compared with the few cells of the nearest pivots first,
which makes that bound as near as neighbours are, and by the triangle inequality only cells within it are read. Cells and their visitors are cut into slices of bounded size, so that no group gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators.ordinals import numbered
from lociflow.operators.sampling import hash_order
from lociflow.sources.scratch import Scratch, bounded, join_same

#: Rows of one side that a task compares at a time.
SLICE = 20_000
#: Distances that a task holds at a time.
HELD = 1 << 20
#: Visits to cells that a slice of queries makes at most: each has a copy of its query's vector.
VISITS = 1 << 19
#: Cells that a query is compared with first.
HOMES = 4
#: What a bound is widened by, for rounded sums.
SLACK = 1e-9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """L1 between all rows of two matrices."""
    found = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        found += np.abs(x[:, j, None] - y[None, :, j])
    return found


def matrix(rows: pa.Table, column: str = "v") -> np.ndarray:
    return rows.column(column).combine_chunks().flatten().to_numpy().reshape(len(rows), -1)


def types_of(df: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """gid, v, id, m and first: the distinct vectors of each group, how many rows have them and their smallest key."""
    found = df.groupBy("gid", "v").agg(F.count(F.lit(1)).alias("m"), F.min(key).alias("first"))
    return scratch.keep(found.withColumn("id", F.monotonically_increasing_id()), name)


def _slices(n: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(n) / SLICE)).cast("long")


def _all_slices(n: str, out: str = "slice") -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), _slices(n) - 1)).alias(out)


def _sliced(df: DataFrame, n: str, out: str = "slice") -> DataFrame:
    """``df`` with one of the slices of ``n`` rows, by the row's id."""
    return df.withColumn(out, F.pmod(F.xxhash64("id"), _slices(n)))


def cells_of(types: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The candidate types with ``cell`` and ``r``, the distance to its pivot, and the pivots: gid, cell, pivot."""
    drawn = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30)
    sizes = scratch.keep(types.groupBy("gid").agg(F.count(F.lit(1)).alias("total"), F.min("id").alias("one")), "sizes")
    sized = types.join(bounded(sizes, 32), "gid")
    pivots = scratch.keep(sized.where((drawn < 1 / F.sqrt("total")) | (F.col("id") == F.col("one"))).select("gid", F.col("id").alias("cell"), F.col("v").alias("pivot"), "total"), "pivots")
    schema = pa.schema([("id", pa.int64()), ("cell", pa.int64()), ("r", pa.float64())])

    def nearest(rows: pa.Table, of: pa.Table) -> pa.Table:
        if not len(rows):
            return schema.empty_table()
        x, p = matrix(rows), matrix(of, "pivot")
        cell, r = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        step = max(1, HELD // len(p))
        for at in range(0, len(x), step):
            d = distances(x[at : at + step], p)
            best = d.argmin(axis=1)
            cell[at : at + step], r[at : at + step] = of.column("cell").to_numpy()[best], d[np.arange(len(best)), best]
        return pa.Table.from_arrays([rows.column("id"), pa.array(cell), pa.array(r)], schema=schema)

    sent = pivots.select("*", _all_slices("total"))
    placed = _sliced(sized, "total").groupBy("gid", "slice").cogroup(sent.groupBy("gid", "slice")).applyInArrow(nearest, "id long, cell long, r double")
    return scratch.keep(types.join(placed, "id"), "placed"), pivots.drop("total")


def summary(placed: DataFrame, pivots: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Per cell: gid, cell, pivot, n, near and far (its smallest and largest radius) and ``least``, its k smallest radii."""
    ranked = placed.select("gid", "cell", "r", F.row_number().over(Window.partitionBy("gid", "cell").orderBy("r")).alias("i")).where(F.col("i") <= k)
    least = ranked.groupBy("gid", "cell").agg(F.sort_array(F.collect_list("r")).alias("least"))  # k numbers a cell
    spans = placed.groupBy("gid", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("near"), F.max("r").alias("far"))
    return scratch.keep(spans.join(least, ["gid", "cell"]).join(pivots, ["gid", "cell"]), "cells")


def loads_of(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """gid and ``total``, the number of query types, or more where so many slices of them could visit more cells than ``VISITS``."""
    counted = queries.groupBy("gid").agg(F.count(F.lit(1)).alias("total"))
    there = cells.groupBy("gid").agg(F.count(F.lit(1)).alias("there"))
    share = F.least(F.lit(float(SLICE)), F.lit(float(VISITS)) / F.coalesce("there", F.lit(1)))
    return counted.join(there, "gid", "left").select("gid", F.ceil(F.col("total") * F.greatest(F.lit(1.0), SLICE / share)).alias("total"))


def neighbours(queries: DataFrame, placed: DataFrame, cells: DataFrame, k: int, tolerance: float | None, scratch: Scratch) -> DataFrame:
    """id, ``list``, the k nearest candidate types of each query type as (gap, first, cand), ties by their smallest key, and
    ``whole``, whether no further one is within the tolerance."""
    counted = scratch.keep(loads_of(queries, cells), "asked")
    sent = cells.join(bounded(counted, 16), "gid").select("gid", _all_slices("total"), "cell", "pivot", "near", "far", "least")
    most = float("inf") if tolerance is None else tolerance
    schema = pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("bound", pa.float64())])

    def route(rows: pa.Table, of: pa.Table) -> pa.Table:
        if not len(rows) or not len(of):
            return schema.empty_table()
        x, p, reach = matrix(rows), matrix(of, "pivot"), rows.column("reach").to_numpy()
        cell, near, far = (of.column(c).to_numpy() for c in ("cell", "near", "far"))
        least = of.column("least").combine_chunks()
        owner, radii = np.repeat(np.arange(len(of)), np.diff(least.offsets.to_numpy())), least.flatten().to_numpy()
        who, to, bound = [], [], []
        step = max(1, HELD // len(radii))
        for at in range(0, len(x), step):
            d = distances(x[at : at + step], p)
            # so many candidates are no farther than this
            limit = np.partition(d[:, owner] + radii[None, :], k - 1, axis=1)[:, k - 1] if len(radii) >= k else np.full(len(d), np.inf)
            limit = np.minimum(np.minimum(limit, most), reach[at : at + step]) + SLACK
            # no candidate of a cell is nearer than its radii allow, or than half of what its pivot is farther than the nearest
            least_ = np.maximum(np.maximum(d - far[None, :], near[None, :] - d), (d - d.min(axis=1)[:, None]) / 2)
            within = least_ <= limit[:, None]
            fresh = np.isinf(reach[at : at + step])
            if fresh.any() and d.shape[1] > HOMES:
                homes = np.zeros_like(within)
                np.put_along_axis(homes, np.argpartition(d, HOMES - 1, axis=1)[:, :HOMES], True, axis=1)
                within &= homes | ~fresh[:, None]
            some, there = np.nonzero(within)
            who.append(some + at)
            to.append(there)
            bound.append(limit[some])
        who, to = np.concatenate(who), np.concatenate(to)
        return pa.Table.from_arrays([pa.array(cell[to]), rows.column("id").take(pa.array(who)), rows.column("v").take(pa.array(who)), pa.array(np.concatenate(bound))], schema=schema)

    kind = dict(placed.dtypes)["first"]

    def meet(rows: pa.Table, of: pa.Table) -> pa.Table:
        who, to, gap = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(rows) and len(of):
            x, y, limit = matrix(rows), matrix(of), rows.column("bound").to_numpy()
            names = of.column("first").to_pylist()
            rank = np.zeros(len(of), np.int64)
            rank[sorted(range(len(of)), key=names.__getitem__)] = np.arange(len(of))
            step = max(1, HELD // len(y))
            for at in range(0, len(x), step):
                d = distances(x[at : at + step], y)
                some, there = np.nonzero(d <= limit[at : at + step, None])
                order = np.lexsort((rank[there], d[some, there], some))
                some, there = some[order], there[order]
                best = np.arange(len(some)) - np.searchsorted(some, some) < k
                who.append(some[best] + at)
                to.append(there[best])
                gap.append(d[some[best], there[best]])
        who, to = pa.array(np.concatenate(who)), pa.array(np.concatenate(to))
        return pa.Table.from_arrays([rows.column("id").take(who), pa.array(np.concatenate(gap)), of.column("first").take(to), of.column("id").take(to)], names=["id", "gap", "first", "cand"])

    def best(queries: DataFrame) -> DataFrame:
        """The k nearest candidates of each query in the cells that its ``reach`` leaves, in those of the nearest pivots where it has none."""
        dealt = _sliced(queries.join(bounded(counted, 16), "gid"), "total").select("gid", "slice", "id", "v", "reach").groupBy("gid", "slice").cogroup(sent.groupBy("gid", "slice"))
        visits = scratch.keep(dealt.applyInArrow(route, "cell long, id long, v array<double>, bound double"), "visits")
        # a cell and its visitors, both in slices: each slice of one meets each slice of the other
        loads = scratch.keep(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(cells.select("cell", "n"), "cell"), "loads")
        left = _sliced(visits.join(loads, "cell"), "asked", "x").select("cell", "x", _all_slices("n", "y"), "id", "v", "bound")
        right = _sliced(placed.join(loads, "cell"), "n", "y").select("cell", "y", _all_slices("asked", "x"), "id", "v", "first")
        found = left.groupBy("cell", "x", "y").cogroup(right.groupBy("cell", "x", "y")).applyInArrow(meet, f"id long, gap double, first {kind}, cand long")
        if tolerance is not None:
            found = found.where(F.col("gap") <= tolerance)
        return found.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("gap", "first", "cand"))).where(F.col("i") <= k)

    at_home = best(queries.withColumn("reach", F.lit(float("inf")))).groupBy("id").agg(F.max("gap").alias("reach"), F.count(F.lit(1)).alias("n"))
    # fewer than k there: any bound that is a number
    reach = scratch.keep(at_home.select("id", F.when(F.col("n") >= k, F.col("reach")).alias("reach")), "reach")
    top = best(queries.join(reach, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float(np.finfo(float).max)))))
    lists = top.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("gap", "first", "cand"))).alias("list"))  # k entries
    return scratch.keep(lists.withColumn("whole", F.size("list") < k), "lists")


def propose(members: DataFrame, lists: DataFrame, room: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rounds until no proposal is refused: the members with the place in their list that they are at, and who is held where.

    A refused member goes on to the first entry of its list that is not full of members before it in the order: as the held
    ones only ever come earlier, it would be refused there too.
    """
    while True:
        asking = members.join(lists, F.col("ask") == F.col("id")).where(F.col("at") < F.size("list"))
        asking = scratch.keep(asking.select("gid", "key", "ask", "h", "at", F.expr("list[at].cand").alias("cand"), F.expr("list[at].gap").alias("gap")), "asking")
        crowd = asking.groupBy("cand").count().agg(F.max("count")).first()[0] or 0
        if crowd > SLICE:
            placed = numbered(asking, ["cand"], ["h", "key"], "place", scratch)
        else:
            placed = asking.withColumn("place", F.row_number().over(Window.partitionBy("cand").orderBy("h", "key")).cast("long") - 1)
        placed = scratch.keep(placed.join(room, "cand"), "placed")
        held, lost = placed.where("place < m"), placed.where("place >= m")
        if not lost.limit(1).count():
            return members, held
        full = held.groupBy("cand").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("h", "key")).alias("last"), F.first("m").alias("m")).where("n = m").select("cand", "last")
        ahead = lost.select("gid", "key", "ask", "h", "at").join(lists, F.col("ask") == F.col("id"))
        rest = ahead.select("gid", "key", "ask", "h", "at", F.posexplode("list").alias("to", "entry")).where("to > at").select("gid", "key", "h", "to", "entry.cand")
        open_ = rest.join(full, "cand", "left").where(F.col("last").isNull() | (F.struct("h", "key") < F.col("last")))
        moved = ahead.select("gid", "key", "ask", "h", F.size("list").alias("end")).join(open_.groupBy("gid", "key").agg(F.min("to").alias("to")), ["gid", "key"], "left")
        moved = moved.select("gid", "key", "ask", "h", F.coalesce("to", "end").alias("at"))
        members = scratch.keep(members.join(lost.select("gid", "key"), ["gid", "key"], "left_anti").unionByName(moved), "members")


def match_vectors(positives: DataFrame, pool: DataFrame, by: Sequence[str], vector: str, key: str, tolerance: float | None = None, k: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """by..., k (the positive's key), match (the key of its pool row) and gap (their L1 distance): positives in hash order each get
    the nearest vector of their group that has an unused pool row, at most ``tolerance`` away, and of its rows that of smallest key.

    Equally near vectors go by their smallest key. Vectors are arrays of numbers of one length; rows with a null vector or key, or
    null numbers, take no part; nulls in ``by`` are a group. Positives without a match have no row. Where all of the ``k`` nearest
    are taken, four times as many are sought for those positives, so that k is no limit. Keys are unique on each side.
    """
    scratch = scratch or Scratch(pool.sparkSession)
    whole = F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    clean = lambda df: df.select(*by, F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("key").isNotNull() & whole)
    groups = scratch.keep(pool.select(*by).distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    grouped = lambda df: join_same(clean(df), bounded(groups, 64), by).select("gid", "key", "v")
    units, people = scratch.keep(grouped(pool), "units"), scratch.keep(grouped(positives), "people")
    kinds, asks = types_of(units, "key", scratch, "kinds"), types_of(people, "key", scratch, "asks")
    placed, pivots = cells_of(kinds, scratch)
    lists = neighbours(asks, placed, summary(placed, pivots, k, scratch), k, tolerance, scratch)
    members = people.join(asks.select("gid", "v", F.col("id").alias("ask")), ["gid", "v"]).select("gid", "key", "ask", hash_order("match", "key").alias("h"), F.lit(0).alias("at"))
    members, room = scratch.keep(members, "members"), kinds.select(F.col("id").alias("cand"), "m")
    while True:
        members, held = propose(members, lists, room, scratch)
        short = members.join(lists, F.col("ask") == F.col("id")).where((F.col("at") >= F.size("list")) & ~F.col("whole"))
        short = scratch.keep(short.select("id").distinct(), "short")
        if not short.limit(1).count():
            break
        k *= 4
        more = neighbours(asks.join(short, "id", "left_semi"), placed, summary(placed, pivots, k, scratch), k, tolerance, scratch)
        lists = scratch.keep(more.unionByName(lists.join(short, "id", "left_anti")), "longer")
    # who is held at a type gets its rows in the order of their keys
    taken = units.join(kinds.select("gid", "v", F.col("id").alias("cand")), ["gid", "v"]).join(held.select("cand").distinct(), "cand", "left_semi").select("cand", F.col("key").alias("match"))
    found = held.join(numbered(taken, ["cand"], ["match"], "place", scratch), ["cand", "place"])
    return found.join(bounded(groups, 64), "gid").select(*by, F.col("key").alias("k"), "match", "gap")
