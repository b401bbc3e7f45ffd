"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some positions of a token window and ignore the others, so that a hash of the selected tokens survives
substitutions at the ignored ones. The hashes of benchmark items and documents are joined; around each hit, the item and
the document are laid over each other and the overlap is verified token by token.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import fresh, shared_dir, small, stored

#: Selected positions of two masks of which one fits between any two substitutions among thirteen tokens (a test enumerates them).
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 3, 8, 9, 10))
#: Seeds of the benchmark up to which every executor gets them all; beyond it the hashes are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
#: Keys of texts with hits, 8 bytes each, up to which the same holds for them.
BROADCAST_KEYS = 2_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masks_of(n: int, share: float) -> tuple[tuple[int, ...], ...]:
    """Masks of which one, at some place in ``n`` tokens, meets no substitution, wherever as many are as ``share`` allows.

    Beside MASKS, the tokens are cut into two blocks more than that, and each mask leaves out as many blocks.
    """
    wrong = n - math.ceil(share * n)
    if n == 13 and wrong <= 2:
        return MASKS
    count = min(n, wrong + 2)
    blocks = [range(n * i // count, n * (i + 1) // count) for i in range(count)]
    kept = [[p for block in chosen for p in block] for chosen in combinations(blocks, max(1, count - wrong))]
    return tuple(sorted({tuple(p - places[0] for p in places) for places in kept}))


def _hashes(codes: str, mask: Sequence[int]) -> Column:
    """The hash of the selected tokens at each window of the mask's span, in order."""
    span = max(mask) + 1
    at = lambda i: F.xxhash64(F.lit(",".join(map(str, mask))), *[F.get(F.col(codes), i + o) for o in mask])
    return F.when(F.size(codes) >= span, F.transform(F.sequence(F.lit(0), F.size(codes) - span), at)).otherwise(F.array().cast("array<bigint>"))


def _seeds(df: DataFrame, key: str, masks: Sequence[Sequence[int]]) -> DataFrame:
    """key, hash and token position of every window of every mask; ``df`` has the key and the token array ``toks``."""
    codes = df.select(key, F.transform("toks", lambda w: F.xxhash64(w)).alias("codes"))
    windows = codes.select(key, F.size("codes").alias("n"), F.concat(*[_hashes("codes", m) for m in masks]).alias("hashes"))
    # the outer form: Catalyst derives from the inner one a filter on the array, which it computes a second time
    rows = windows.select(key, "n", F.posexplode_outer("hashes").alias("i", "hash"))
    position, before = F.col("i"), F.lit(0)
    for m in masks:  # the windows of a mask follow those of the masks before it
        count = F.greatest(F.col("n") - max(m), F.lit(0))
        inside = (F.col("i") >= before) & (F.col("i") < before + count)
        position = F.when(inside, F.col("i") - before).otherwise(position)
        before = before + count
    return rows.select(key, "hash", position.alias("p"))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, folder: str | None = None) -> DataFrame:
    """One row per distinct text and benchmark item that overlap: text_md5, item_id, matched, item_tokens.

    A document overlaps an item where, on one alignment around a seed hit, some ``window`` consecutive tokens (all of a
    shorter item) agree in at least ``share`` of their positions. ``matched`` is the largest number of agreeing tokens of
    the whole item on such an alignment. The masks find every alignment that this accepts. Items of equal tokens
    count as one and give their smallest item_id; items and texts without a token overlap nothing. Equal texts are
    verified once. Whole texts are searched, however long; a text's tokens must fit in a task's memory. Empty tables give no
    row; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).where("size(item) > 0")
    items = items.withColumn("k", F.md5(F.array_join("item", " ").cast("binary"))).groupBy("k").agg(F.min("item_id").alias("item_id"), F.first("item").alias("item"))
    items = stored(items, folder, "items")
    sizes = [r[0] for r in items.select(F.least(F.size("item"), F.lit(window)).alias("n")).distinct().collect()]  # no more values than ``window``
    by_size = {n: masks_of(n, share) for n in sorted({*sizes, window})}
    masks = sorted({m for found in by_size.values() for m in found})
    of_size = lambda n: items.where(F.least(F.size("item"), F.lit(window)) == n).withColumnRenamed("item", "toks")
    seeds = reduce(DataFrame.unionByName, [_seeds(of_size(n), "k", found) for n, found in by_size.items()]).withColumnRenamed("p", "q").distinct()
    seeds = small(stored(seeds, folder, "seeds"), BROADCAST_SEEDS)

    keyed = docs.select("text").where("text IS NOT NULL").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "text")
    found = _seeds(keyed.select("text_md5", tokens(F.col("text")).alias("toks")), "text_md5", masks).join(seeds, "hash")
    hits = stored(found.select("text_md5", "k", (F.col("p") - F.col("q")).alias("shift")).distinct(), folder, "hits")
    # short keys first, so that only texts with hits are shuffled; the exact key decides in the join with the hits
    hit_keys = small(stored(hits.select(F.xxhash64("text_md5").alias("hit")).distinct(), folder, "hit-keys"), BROADCAST_KEYS)
    texts = keyed.withColumn("hit", F.xxhash64("text_md5")).join(hit_keys, "hit", "left_semi").groupBy("text_md5").agg(F.first("text").alias("text"))
    texts = texts.select("text_md5", tokens(F.col("text")).alias("toks"))
    laid = hits.join(items, "k").join(texts, "text_md5").select(
        "text_md5",
        "item_id",
        F.size("item").alias("item_tokens"),
        F.transform("item", lambda w, j: F.coalesce((F.when(j + F.col("shift") >= 0, F.get("toks", j + F.col("shift"))) == w).cast("int"), F.lit(0))).alias("same"),
    )
    width = F.least(F.lit(window), F.col("item_tokens"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = lambda s: F.array_max(F.transform(F.sequence(F.lit(1), F.col("item_tokens") - width + 1), lambda i: total(F.slice(s, i, width))))
    # bound to a lambda, so that the overlap is laid once
    judged = F.transform(F.array("same"), lambda s: F.struct((best(s) >= F.ceil(F.lit(share) * width)).alias("hit"), total(s).alias("matched")))[0]
    verified = laid.select("text_md5", "item_id", "item_tokens", judged.alias("j")).where("j.hit").withColumn("matched", F.col("j.matched"))
    return verified.groupBy("text_md5", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("item_tokens").cast("long").alias("item_tokens"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id with item_id, matched and item_tokens of each overlap of each document, copies and repeated rows included."""
    found = overlaps(docs, benchmark, **options)
    keyed = docs.where("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return keyed.join(found, "text_md5").drop("text_md5")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without an overlap, all columns as they were, whatever their names; a null text overlaps nothing."""
    name = fresh(docs, "bad_md5")
    options.setdefault("folder", shared_dir(docs.sparkSession))
    bad = overlaps(docs, benchmark, **options).select(F.col("text_md5").alias(name)).distinct()
    bad = small(stored(bad, options["folder"], "bad"), BROADCAST_KEYS // 8)
    return docs.join(bad, F.md5(docs["text"].cast("binary")) == bad[name], "left_anti")
