"""Deterministic sampling: hash orders, strides, strata, and matched draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.operators import ordinals
from lociflow.sources.scratch import Scratch, join_same


def hash_order(salt: str, *key: str) -> Column:
    """SHA-256 of the salted key: an order that rows keep in whatever table they are."""
    return F.sha2(F.concat_ws("|", F.lit(salt), *key), 256)


def hash_sample(df: DataFrame, salt: str, key: Sequence[str], by: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group in hash order; equal keys count by their occurrence."""
    w = Window.partitionBy(*by).orderBy(hash_order(salt, *key), *key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def every_nth(df: DataFrame, order: Sequence[str], by: Sequence[str], n: int) -> DataFrame:
    """Every n-th row of each group under a total order, the first included."""
    return ordinals.numbered(df, by, order, "_at").where(F.col("_at") % n == 0).drop("_at")


def stratified_pick(pool: DataFrame, wanted: DataFrame, strata: Sequence[str], salt: str, key: str) -> DataFrame:
    """As many rows of each stratum as ``wanted`` says in its column ``n``, in hash order.

    What a stratum lacks is made up from the rest of the pool, in hash order over all strata. Positions come from range
    partitions of the hash, so that neither a stratum nor the rest gathers in one task. Nulls in the strata are a stratum.
    """
    scratch = Scratch(pool.sparkSession)
    ranked = ordinals.numbered(pool.withColumn("_h", hash_order(salt, key)), strata, ["_h", key], "_r", scratch)
    ranked = scratch.keep(join_same(ranked, wanted.withColumnRenamed("n", "_n"), strata, "left").fillna({"_n": 0}), "ranked")
    lack = wanted.agg(F.sum("n")).first()[0] or 0
    lack -= ranked.where(F.col("_r") < F.col("_n")).count()
    chosen, rest = ranked.where(F.col("_r") < F.col("_n")), ranked.where(F.col("_r") >= F.col("_n"))
    filled = ordinals.numbered(rest, [], ["_h", key], "_order", scratch).where(F.col("_order") < int(lack))
    return chosen.select(*pool.columns).unionByName(filled.select(*pool.columns))


def share_matched(df: DataFrame, fold: str, region: str, label: str, key: str, salt: str) -> DataFrame:
    """All positives and, per fold, the most negatives that repeat the positives' shares of regions, in hash order of the key.

    The number that every region can give its share of is the smallest of what it has over its share; a region gives its share of
    that, rounded half to even. Folds without positives or without negatives fall away; rows with a null label do too.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.where(F.col(label).isNotNull())
    counts = rows.groupBy(fold, region).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_free"))
    both = Window.partitionBy(fold)
    counts = counts.withColumns({"_total": F.sum("_p").over(both), "_all_free": F.sum("_free").over(both)}).where("_total > 0 AND _all_free > 0")
    most = F.min(F.when(F.col("_p") > 0, F.floor(F.col("_free") * F.col("_total") / F.col("_p") + 1e-9))).over(both)
    quota = F.least(F.col("_free"), F.bround(F.col("_take") * F.col("_p") / F.col("_total"), 0).cast("long"))
    quotas = scratch.keep(counts.withColumn("_take", most).select(fold, region, quota.alias("_quota")), "quotas")
    positives = join_same(rows.where(F.col(label) == 1), quotas.select(fold).distinct(), [fold])
    negatives = ordinals.numbered(rows.where(F.col(label) != 1).withColumn("_h", hash_order(salt, key)), [fold, region], ["_h", key], "_at", scratch)
    taken = join_same(negatives, quotas, [fold, region]).where(F.col("_at") < F.col("_quota"))
    return positives.select(*df.columns).unionByName(taken.select(*df.columns))


def match_nearest(positives: DataFrame, pool: DataFrame, by: Sequence[str], value: str, key: str, tolerance: float) -> DataFrame:
    """One unused pool row per positive of its bucket, nearest by ``value`` and at most ``tolerance`` away, positives in hash
    order: a match of vectors of one number."""
    from lociflow.operators.matching import match_vectors

    one = lambda df: df.select(*by, key, F.array(F.col(value).cast("double")).alias("_vector"))
    return match_vectors(one(positives), one(pool), by, "_vector", key, tolerance)


def bootstrap_means(df: DataFrame, value: str, cluster: str, draws: int) -> DataFrame:
    """draw and mean of ``draws`` Poisson bootstraps over clusters: hashes of draw and cluster give the weights, so that no row
    is repeated."""
    from lociflow.operators.resampling import weighted_means

    return weighted_means(df, value, [cluster], draws).where("draw > 0")


def shuffle_dinucleotides(df: DataFrame, seq: str, seed: int, out: str = "shuffled") -> DataFrame:
    """A random sequence with the same first and last letter and the same dinucleotide counts: a random Eulerian path.

    Null and strings of up to two letters stay. The path walks each letter's successors in random order, and the last
    successor of each letter forms a tree to the end letter, drawn by random walks.
    """

    def shuffle(text, salt):
        import random
        from collections import defaultdict

        if text is None or len(text) < 3:
            return text
        rng = random.Random(f"{seed}|{salt}")
        after = defaultdict(list)
        for a, b in zip(text, text[1:]):
            after[a].append(b)
        end, last = text[-1], {}
        joined = {end}
        for start in sorted(after):
            at = start
            while at not in joined:  # walk, overwriting loops
                last[at] = rng.choice(after[at])
                at = last[at]
            at = start
            while at not in joined:
                joined.add(at)
                at = last[at]
        for a, bs in after.items():
            if a != end:
                bs.remove(last[a])
            rng.shuffle(bs)
            if a != end:
                bs.append(last[a])
        out, at = [text[0]], {a: 0 for a in after}
        while len(out) < len(text):
            a = out[-1]
            out.append(after[a][at[a]])
            at[a] += 1
        return "".join(out)

    udf = F.pandas_udf(lambda s, k: s.combine(k, shuffle), "string")
    return df.withColumn(out, udf(F.col(seq), F.md5(F.col(seq).cast("binary"))))
