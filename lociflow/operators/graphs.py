"""Connected components of tables of links."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lociflow-"))
    return df.checkpoint()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and component, the smallest node that links reach.

    Labels spread to neighbours and then to the label's own label, so that chains shorten by half in each round; the
    state of a round is checkpointed. The rounds end when no label falls.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = checkpointed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = checkpointed(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        near = edges.join(labels.withColumnsRenamed({"u": "v", "label": "l"}), "v").groupBy("u").agg(F.min("l").alias("l"))
        spread = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        own = labels.select(F.col("u").alias("label"), F.col("label").alias("further"))
        jumped = checkpointed(spread.join(own, "label", "left").select("u", "old", F.coalesce(F.least("label", "further"), "label").alias("label")))
        labels = jumped.drop("old")
        if not jumped.where("label <> old").limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))


def gram_hashes(gram: Column) -> Column:
    """96 bits of a gram of any length and type: what grams are told apart by once they are shuffled. Among a thousand million
    grams any two collide with a chance of about 10^-11."""
    return F.struct(F.xxhash64(gram).alias("g"), F.hash(gram).alias("g2"))


def sharing(df: DataFrame, key: str, grams: str) -> DataFrame:
    """Links between rows that share a gram: each with the smallest row of the gram, so that a gram of many rows gives a
    star instead of all its pairs. The grams are shuffled once, as hashes."""
    rows = df.select(key, F.explode(F.transform(F.filter(F.array_distinct(grams), lambda g: g.isNotNull()), gram_hashes)).alias("g")).select(key, "g.*")
    first = F.first(key).over(Window.partitionBy("g", "g2").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(key, first.alias("first")).where(F.col(key) != F.col("first")).select("first", key).distinct()
