"""Binned coverage tracks and the largest value under a window of any width.

A track has, for each bin, the largest value of the intervals that touch it. Level j of the pyramid has, for each bin, the largest
of 2^j bins from there on. Two entries of one level, at the window's first bin and ending at its last one, cover any window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.sources.scratch import Scratch, join_same

#: Bins of a block at least, widest windows and intervals in bins, and most rows of a group's block, where blocks are searched whole.
BLOCK, WIDEST, CROWD = 1024, 1 << 16, 200_000


def _bin(c: str, size: int) -> Column:
    return F.floor(F.col(c) / size)


def pyramid(intervals: DataFrame, by: Sequence[str], value: str, size: int, levels: int, scratch: Scratch | None = None) -> DataFrame:
    """by..., level, bin and top, for the levels 0 to ``levels`` - 1 and all bins with a value below.

    An interval from ``start`` to ``end`` touches the bins of both; null values count as 0. An interval of many bins is cut into
    pieces of powers of two, each an entry of its level, and is handed down from level to level, so that none becomes a row for
    each of its bins before these are merged with the others' of the level.
    """
    scratch = scratch or Scratch(intervals.sparkSession)
    by = list(by)
    first, last = _bin("start", size), _bin("end", size)
    length = last - first + 1
    # the largest power of two that fits, from either end: both entries together cover the interval
    level = F.floor(F.log2(length.cast("double") + 0.5)).cast("int")
    cut = intervals.where("start IS NOT NULL AND end >= start").select(*by, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("top"), level.alias("level"), F.explode(F.array_distinct(F.array(first, last + 1 - F.pow(F.lit(2.0), level).cast("long")))).alias("bin"))
    cut = scratch.keep(cut.groupBy(*by, "level", "bin").agg(F.max("top").alias("top")), "pieces")
    most = cut.agg(F.max("level")).first()[0]
    if most is None:
        return cut
    # down to single bins: an entry's halves belong to the level below
    down = cut.where(F.col("level") == most)
    for j in range(most - 1, -1, -1):
        halves = down.select(*by, F.lit(j).alias("level"), F.explode(F.array(F.col("bin"), F.col("bin") + (1 << j))).alias("bin"), "top")
        down = scratch.keep(halves.unionByName(cut.where(F.col("level") == j)).groupBy(*by, "level", "bin").agg(F.max("top").alias("top")), f"down-{j}")
    # up again: an entry of the next level is the larger of two neighbours' of this one
    found, below = [down], down
    for j in range(1, levels):
        half = 1 << (j - 1)
        both = below.select(*by, F.explode(F.array(F.col("bin"), F.col("bin") - half)).alias("bin"), "top")
        below = scratch.keep(both.groupBy(*by, "bin").agg(F.max("top").alias("top")).select(*by, F.lit(j).alias("level"), "bin", "top"), f"level-{j}")
        found.append(below)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _most(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def searched(starts: np.ndarray, lasts: np.ndarray, value: np.ndarray, one: np.ndarray, two: np.ndarray, bins: int) -> np.ndarray:
    """The largest value of the intervals that touch bins ``one`` to ``two`` of each window, of ``bins`` ones; -inf where none does."""
    level = lambda a, b: np.frexp((b - a + 1).astype(float))[1] - 1  # noqa: E731  the largest power of two that fits
    cut, asked = level(starts, lasts), level(one, two)
    tracks = np.full((max(cut.max(initial=0), asked.max(initial=0)) + 1, bins), -np.inf)
    np.maximum.at(tracks, (cut, starts), value)
    np.maximum.at(tracks, (cut, lasts + 1 - (1 << cut)), value)
    for j in range(len(tracks) - 1, 0, -1):  # an entry's halves belong to the level below
        half = 1 << (j - 1)
        tracks[j - 1] = np.maximum(tracks[j - 1], tracks[j])
        tracks[j - 1, half:] = np.maximum(tracks[j - 1, half:], tracks[j, :-half])
    for j in range(1, len(tracks)):
        half = 1 << (j - 1)
        tracks[j] = tracks[j - 1]
        tracks[j, :-half] = np.maximum(tracks[j, :-half], tracks[j - 1, half:])
    return np.maximum(tracks[asked, one], tracks[asked, two + 1 - (1 << asked)])


def _blocks(windows: DataFrame, intervals: DataFrame, by: Sequence[str], value: str, size: int, out: str) -> DataFrame | None:
    """As ``window_tops``, of windows with bounds alone: each row goes once to the block of bins where a window starts and to those whose windows it may
    touch, and a task searches a block of a group at a time. None if a row is too wide or a block too crowded for that."""
    width = lambda df: df.agg(F.max(_bin("end", size) - _bin("start", size) + 1)).first()[0] or 1
    wide, long = width(windows), width(intervals)
    block = 1 << (max(BLOCK, wide, long) - 1).bit_length()
    if block > WIDEST:
        return None
    keys = [f"_by{i}" for i in range(len(by))]
    own = lambda df, *c: df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *c)
    first, last = _bin("start", size), _bin("end", size)
    left = own(windows, F.floor(first / block).alias("_block"), first.alias("_one"), last.alias("_two"), *windows.columns)
    to = F.explode(F.sequence(F.floor((first - (wide - 1)) / block), F.floor(last / block)))
    right = own(intervals, to.alias("_block"), first.alias("_one"), last.alias("_two"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"))
    keys.append("_block")
    if _most(left, keys) > CROWD or _most(right, keys) > CROWD:
        return None

    def search(rows: pa.Table, of: pa.Table) -> pa.Table:
        top = np.zeros(len(rows))
        if len(rows) and len(of):
            start = rows.column("_block")[0].as_py() * block
            at = lambda t, c: np.clip(t.column(c).to_numpy() - start, 0, 2 * block - 1)
            top = searched(at(of, "_one"), at(of, "_two"), of.column("_value").to_numpy(), at(rows, "_one"), at(rows, "_two"), 2 * block)
            top[top == -np.inf] = 0.0
        return rows.drop_columns([*keys, "_one", "_two"]).append_column(out, pa.array(top, pa.float64()))

    kind = windows.limit(0).withColumn(out, F.lit(0.0)).schema
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, kind)


def window_tops(windows: DataFrame, intervals: DataFrame, by: Sequence[str], value: str, size: int, out: str = "top", scratch: Scratch | None = None) -> DataFrame:
    """``windows`` with the largest value of an interval of the same group that touches a bin of theirs, 0 where none does.

    ``start`` and ``end`` of both may be any whole numbers; bins are ``size`` wide and the bin of ``end`` counts. Windows with a
    null bound or that end before they start have null. Nulls in ``by`` are a group.
    """
    scratch = scratch or Scratch(windows.sparkSession)
    by = list(by)
    width = _bin("end", size) - _bin("start", size) + 1
    ok = F.coalesce(F.col("end") >= F.col("start"), F.lit(False))
    none = windows.where(~ok).withColumn(out, F.lit(None).cast("double"))
    found = _blocks(windows.where(ok), intervals.where("end >= start"), by, value, size, out)
    if found is not None:
        return found.unionByName(none)
    level = F.when(ok, F.floor(F.log2(width.cast("double") + 0.5)).cast("int"))
    rows = windows.withColumn("_level", level).withColumn("_one", _bin("start", size)).withColumn("_two", _bin("end", size) + 1 - F.pow(F.lit(2.0), F.col("_level")).cast("long"))
    rows = scratch.keep(rows, "windows")
    most = rows.agg(F.max("_level")).first()[0]
    if most is None:
        return rows.drop("_level", "_one", "_two").withColumn(out, F.lit(None).cast("double"))
    entries = scratch.keep(pyramid(intervals, by, value, size, most + 1, scratch), "pyramid")
    for c, n in (("_one", "_a"), ("_two", "_b")):
        side = entries.select(*by, F.col("level").alias("_level"), F.col("bin").alias(c), F.col("top").alias(n))
        rows = join_same(rows, side, [*by, "_level", c], "left")
    top = F.when(F.col("_level").isNotNull(), F.coalesce(F.greatest("_a", "_b"), F.lit(0.0)))
    return rows.withColumn(out, top).drop("_level", "_one", "_two", "_a", "_b")


def expressed_pairs(windows: DataFrame, genes: DataFrame, chrom: str, strand: str, pair: str, negative: Column, value: str, size: int, least: float, scratch: Scratch | None = None) -> DataFrame:
    """The pairs whose negative window lies on a gene of at least ``least`` on its own strand, with ``anywhere``, the largest value
    on either strand."""
    scratch = scratch or Scratch(windows.sparkSession)
    own = window_tops(windows.where(negative), genes, [chrom, strand], value, size, "_own", scratch)
    both = window_tops(own, genes, [chrom], value, size, "anywhere", scratch)
    return both.where(F.col("_own") >= least).groupBy(pair).agg(F.max("anywhere").alias("anywhere"))
