"""Shard placement by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A key descends it: at each level every child of the node it is at draws ``-ln(u) / weight``
from a hash of its own path and the key, and the smallest draw wins, so that a child wins in proportion to its weight. A node's
weight is the sum of its children's. A changed weight alters only the draws on its path: where it grows, keys move only into the
subtrees on that path, and where it falls, only out of them or inside them; whatever else a key descends through stays as it was.

A key costs a hash for each child of the nodes on its way, not for each shard. A shard that joins a running tree becomes a region
of its own (``grown``), so that no other weight changes and it takes rows only into itself, at every number of shards.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociflow.llm.common import fresh, shared_dir, stored

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def tree_of(shards: int, per_rack: int = 2, racks: int = 2) -> dict[str, dict[str, dict[int, float]]]:
    """Shards 0 to ``shards - 1`` of weight 1, filling racks and regions in order."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        tree.setdefault(f"g{s // (per_rack * racks)}", {}).setdefault(f"k{s // per_rack % racks}", {})[s] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> dict[str, dict[str, dict[int, float]]]:
    """The tree with one more shard, in a region of its own."""
    if any(shard in shards for racks in tree.values() for shards in racks.values()) or f"joined-{shard}" in tree:
        raise ValueError(f"shard {shard} is in the tree")
    return {g: {k: dict(s) for k, s in racks.items()} for g, racks in tree.items()} | {f"joined-{shard}": {"k0": {shard: weight}}}


def _weight(node: Mapping | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else node


def _levels(tree: Tree) -> list[dict[str, list[dict]]]:
    """Per level: the path of each node with weight -> its children with weight, by name."""
    found, nodes = [], {"": tree}
    while nodes:
        found.append({path: [{"name": str(c), "weight": float(_weight(n))} for c, n in node.items() if _weight(n) > 0] for path, node in nodes.items()})
        nodes = {f"{path}/{c}": n for path, node in nodes.items() for c, n in node.items() if isinstance(n, Mapping) and _weight(n) > 0}
    return found


def _table(spark: SparkSession, level: dict[str, list[dict]], path: str, children: str) -> DataFrame:
    """The paths and children of a level's nodes."""
    rows = json.dumps([{"path": p, "children": c} for p, c in level.items()])
    kind = "array<struct<path:string,children:array<struct<name:string,weight:double>>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)).alias(path, children))


def place(df: DataFrame, key: Column, tree: Tree, out: str = "shard") -> DataFrame:
    """Adds the shard of ``key`` in ``tree``; a null key is placed as the empty string, nodes of no weight get nothing.

    Equal draws go to the smaller name. The tables of a level's nodes, as large as the tree, are sent to all tasks. Other columns
    stay, whatever their names; one that is named ``out`` is replaced.
    """
    if _weight(tree) <= 0:
        raise ValueError("the tree has no weight")
    k, path, children = (fresh(df, c) for c in ("_key", "_path", "_children"))
    placed = df.withColumn(k, F.coalesce(key.cast("string"), F.lit(""))).withColumn(path, F.lit(""))

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.concat(path, F.lit("/"), child["name"], F.lit("|"), k)), 12)
        return F.struct((-F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / child["weight"]).alias("draw"), child["name"].alias("name"))

    for level in _levels(tree):
        placed = placed.join(F.broadcast(_table(df.sparkSession, level, path, children)), path)
        placed = placed.withColumn(path, F.concat(path, F.lit("/"), F.array_min(F.transform(children, draw))["name"])).drop(children)
    return placed.withColumn(out, F.substring_index(path, "/", -1).cast("int")).select(*[c for c in df.columns if c != out], out)


def assign(docs: DataFrame, tree: Tree, larger: Tree | None = None, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: doc_id and the tree decide. Size is the text's UTF-8 bytes plus 1; a null text counts as empty. Slots
    run gapless from 0 in each shard: the placed rows are stored without their texts, counted per stored partition and
    shard, and numbered within those, so that neither a shard nor a repeated doc_id gathers in one task. Null doc_ids
    share one shard. Repeated rows get a slot each. Texts are measured whole, however long. With a ``larger`` tree, grown_shard is
    the shard in it, else null. An empty table gives no row; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(keyed, F.col("doc_id"), tree, "shard")
    placed = place(placed, F.col("doc_id"), larger, "grown_shard") if larger else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    placed = stored(placed, folder or shared_dir(docs.sparkSession), "placed")
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row"))
    return (
        placed.withColumn("_rank", rank)
        .join(first, ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_rank") - 1).alias("slot"), "grown_shard")
    )
