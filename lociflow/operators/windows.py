"""Window builders: positives from peaks, random candidates, negatives by rejection, shuffles, saturation profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators.intervals import as_of, overlap_join


def hash_number(*parts: Column) -> Column:
    """48 bits of the MD5 of the parts joined by bars, as a long: a draw that does not depend on partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("long")


def positive_windows(peaks: DataFrame, limits: DataFrame, unit: str, size: int, region: str, order: Sequence[str]) -> DataFrame:
    """A window of ``size`` around each peak's middle (w0, w1) with ``reason``, why it is left out, null if it is not.

    In this order: no limit known for the unit, outside of [0, limit), no region, and a window at the same place that comes
    first by ``order``; only windows without another reason compete for a place.
    """
    placed = peaks.join(limits, unit, "left").withColumn("w0", F.floor((F.col("start") + F.col("end")) / 2) - size // 2).withColumn("w1", F.col("w0") + size)
    reason = F.when(F.col("limit").isNull(), F.lit("unit")).when((F.col("w0") < 0) | (F.col("w1") > F.col("limit")), F.lit("bounds")).when(F.col(region).isNull(), F.lit("region"))
    placed = placed.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNull(), F.struct(*order))).over(Window.partitionBy(unit, "w0"))
    later = F.col("reason").isNull() & (F.struct(*order) > first)
    return placed.withColumn("reason", F.when(later, F.lit("duplicate")).otherwise(F.col("reason"))).drop("limit")


def candidate_pool(intervals: DataFrame, by: str, size: int, n: int, tries: int, salt: str) -> DataFrame:
    """Up to ``n`` distinct windows of ``size`` per group, uniform over all places where one fits into an interval.

    ``tries`` hashed draws per group fall on the line of all places, laid end to end; an as-of pass finds the interval of
    each. The first draw of a place keeps it. Returns by, start and draw.
    """
    room = intervals.withColumn("_span", F.col("end") - F.col("start") - size + 1).where("_span > 0")
    line = Window.partitionBy(by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    room = room.select(by, F.col("start").alias("_start"), "_span", F.coalesce(F.sum("_span").over(line), F.lit(0)).cast("long").alias("_from"))
    total = room.groupBy(by).agg(F.sum("_span").alias("_total"))
    draws = total.select(by, "_total", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("draw"))
    draws = draws.select(by, "draw", (hash_number(F.lit(salt), F.col(by), F.col("draw")) % F.col("_total")).alias("_at"))
    found = as_of(draws, room.select(by, F.col("_from").alias("_at"), "_start", F.col("_from").alias("_from2")), [by], "_at", ["_start", "_from2"])
    places = found.groupBy(by, (F.col("_start") + F.col("_at") - F.col("_from2")).alias("start")).agg(F.min("draw").alias("draw"))
    return places.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("draw"))).where(F.col("_r") <= n).drop("_r")


def accepted(tries: DataFrame, key: str, attempt: str, gap: str, tolerance: float, relax_after: int) -> DataFrame:
    """The try that rejection sampling takes for each key: the first whose gap is within the tolerance, doubled from
    ``relax_after`` on; else that of the smallest gap if it is within three tolerances. Keys without one have no row."""
    allowed = F.when(F.col(attempt) < relax_after, F.lit(tolerance)).otherwise(F.lit(2 * tolerance))
    taken, near = F.col(gap) <= allowed, F.col(gap) <= 3 * tolerance
    rank = F.struct((~taken).cast("int").alias("tier"), F.when(taken, F.lit(0.0)).otherwise(F.col(gap)).alias("g"), F.col(attempt).alias("t"))
    best = tries.where(taken | near).groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(gap).alias("gap"))).alias("b"))
    return best.select(key, F.col("b.r.t").alias(attempt), F.col("b.gap").alias(gap), (F.col("b.r.tier") == 1).alias("fallback"))


def letters_shuffled(seq: Column, key: Column, salt: str) -> Column:
    """The letters of a sequence in the order of their places' hashes: a permutation that keeps the composition."""

    def shuffled(texts: pa.Array, names: pa.Array) -> pa.Array:
        found, numbers = [], []
        for text, name in zip(texts, names):
            letters, start = text.as_py(), f"{name.as_py()}|".encode()
            if letters:
                codes = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
                while len(numbers) < len(codes):
                    numbers.append(b"%d" % len(numbers))
                drawn = np.frombuffer(b"".join([md5(start + i).digest() for i in numbers[: len(codes)]]), ">u8").astype(np.uint64)
                order = np.argsort(drawn[::2])
                if (np.diff(drawn[::2][order]) == 0).any():  # the second half of the hash decides
                    order = np.lexsort((drawn[1::2], drawn[::2]))
                letters = codes[order].tobytes().decode("utf-32-le")
            found.append(letters)
        return pa.array(found, pa.string())

    return F.arrow_udf(shuffled, "string")(seq, F.concat_ws("|", F.lit(salt), key))


def overlapping(windows: DataFrame, features: DataFrame, by: Sequence[str], width: int, key: Sequence[str], name: str) -> DataFrame:
    """Per window of unique ``key``: how many features overlap it, 0 included, and their distinct ``name`` values, sorted."""
    met = overlap_join(windows, features, by, width).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(name)).alias("names"))
    return windows.select(*key).join(met, list(key), "left").select(*key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def saturation_profile(df: DataFrame, key: str, seq: str, weights: Mapping[str, float], alphabet: str) -> DataFrame:
    """key, pos and effect: the mean absolute change of the sum of 2-mer weights over all substitutions at each position.

    Only the 2-mers at the position change, so each is scored from its neighbours alone.
    """
    table = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    weight = lambda a, b: F.coalesce(F.element_at(table, F.concat(a, b)), F.lit(0.0))
    around = lambda cs, i, c: F.when(i > 0, weight(F.get(cs, i - 1), c)).otherwise(0.0) + F.when(i < F.size(cs) - 1, weight(c, F.get(cs, i + 1))).otherwise(0.0)
    effect = lambda cs, c, i: sum((F.when(c != a, F.abs(around(cs, i, F.lit(a)) - around(cs, i, c))).otherwise(0.0) for a in alphabet), F.lit(0.0)) / (len(alphabet) - 1)
    cs = F.split(seq, "")
    rows = df.where(F.length(seq) > 0).select(key, F.posexplode(F.transform(F.array(cs), lambda x: F.transform(x, lambda c, i: effect(x, c, i)))[0]).alias("pos", "effect"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def locality(profile: DataFrame, key: str, value: str, top: float = 0.1) -> DataFrame:
    """Per sequence: positions, mean effect, and the share of the effect that the strongest tenth of the positions has."""
    ranked = profile.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value)))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    strong = F.col("_r") <= F.ceil(F.lit(top) * F.col("_n"))
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("positions"), F.avg(value).alias("mean_effect"), (F.sum(F.when(strong, F.col(value)).otherwise(0.0)) / F.nullif(F.sum(value), F.lit(0.0))).alias("top_share"))
