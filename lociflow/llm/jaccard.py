"""N-gram Jaccard join by vertical partitioning.

Shingles have one global order, that of their hashes. Cutting the order into fragments cuts every document's set into
segments. Fragments serve twice:

* Candidates. Sets that link differ in at most ``d`` shingles, a bound that follows from their sizes. Cut into more than
  ``d`` fragments, they agree in at least one whole segment, so equal segment hashes find every link. How many fragments
  there are depends on the size; sets near the border of a size class are cut for both classes.
* Counting. For the candidates, each fragment's overlap is counted separately, and the counts are summed per pair.

Equal sets are one node. Pairs are counted in rounds, at most one for each node: its partner stands for a segment that they
share, and is the nearest by a parity sketch of their sets, whose Hamming distance never exceeds the true difference. What
links becomes a component, and in the next round only nodes of different components meet. Once hardly any link is found,
all pairs of nodes from different components that share a segment and whose sketches allow a link follow. So no link between
components is lost, and a group of near copies does not become all its pairs.

Segments that many sets have, as those of a common passage, are left out for sets that must share more than these with
any other they link with.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import batches_of, fresh, join_keyed, releasing, remove, shared_dir, small, stored

#: Orders tried for sets that leave too many fragments empty, before each shingle counts as a segment.
ORDERS = 4
#: Fragments in which overlaps are counted.
COUNTED = 8
#: Nodes from which a segment or shingle is frequent: sets that must share others too are not sought by it.
FREQUENT = 100
#: A round that links no more than one part in so many of the first's is the last, before all pairs left are counted.
WORTH = 2
#: One frequent segment of so many takes part in the rounds: sets that link share most of theirs.
ROUNDS_TAKE = 4
#: Rows of a segment up to which its nodes meet by their numbers and pairs get sketches: each row would carry one beyond its pairs.
NARROW = 8
#: Rows of one or three numbers up to which a key table is sent to every executor; beyond it the join is a shuffle.
BROADCAST_ROWS = 500_000
#: The same for tables with text keys, of about 60 bytes a row.
BROADCAST_KEYS = 200_000
#: Texts that a task exchanges with Python at a time.
TEXTS = 1_000
#: Words whose hashes a task remembers.
REMEMBERED = 50_000

words_of_bytes = re.compile(rb"[^\x20\x09-\x0D]+").findall
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which all bits depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def shingles(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles; a text of fewer words is one shingle, none without words."""
    words = words_of_bytes(text.encode().lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < k:
        return mix(np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(words))], np.uint64))
    rolled = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        rolled = mix(rolled * _ODD[0] + h[i : len(words) - k + 1 + i])
    return np.unique(rolled)


def class_ratio(percent: int) -> float:
    """Ratio between the largest and the smallest size of a class: wider than that of sets that link, so that about half
    of the sets need no second class."""
    return max(1.25, (100 / percent) ** 2)


def size_class(n: int, percent: int) -> int:
    return math.ceil(math.log(n) / math.log(class_ratio(percent)) - 1e-9)


def most_differ(n: float, klass: int, percent: int) -> int:
    """In how many shingles a set of n at most differs from one that is no smaller, links with it and is of the class.

    It grows with n, so that it also bounds the difference from smaller sets.
    """
    largest = class_ratio(percent) ** klass
    return int((n + min(largest, n * 100 / percent)) * (100 - percent) / (100 + percent) + 1e-6)


@lru_cache(maxsize=None)
def fragments(klass: int, percent: int) -> int:
    """How many fragments the sets of a class are cut into: one more than its largest sets may differ in, and those that
    stay empty in them by chance, with two deviations to that."""
    largest = class_ratio(percent) ** klass
    differ = most_differ(largest, klass, percent)
    count = differ + 2
    for _ in range(20):
        empty = count * math.exp(-largest / count)
        count = differ + 2 + min(differ // 3, math.ceil(empty + 2 * math.sqrt(empty)))
    return count


def salt(klass: int, order: int) -> np.ndarray:
    """What tells the hashes of classes and orders apart."""
    return mix(np.array([(klass << 8) + order + 1], np.uint64)) * _ODD[2]


def segment_hashes(items: np.ndarray, klass: int, percent: int) -> tuple[np.ndarray, int]:
    """The hashes of the set's segments that are not empty, as a class cuts them, and how many of them any set that links
    with it has at least.

    A set has enough segments if they are more than it may differ in. Of two sets that link, an equal segment is not empty
    if either has enough. Sets without also give the segments of further orders, and after the last their single shingles.
    """
    count, differ = fragments(klass, percent), most_differ(len(items), klass, percent)
    found, common = [], 0
    for order in range(ORDERS):
        keys = items if not order else np.sort(mix(items + np.uint64(order)))
        place = ((keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        content = np.add.reduceat(mix(keys ^ _ODD[1]), starts)
        found.append(mix(content + mix(place[starts] + salt(klass, order))))
        if not order:
            common = max(0, len(starts) - differ)
        if len(starts) > differ:
            return np.concatenate(found), common
    return np.concatenate([*found, mix(items + salt(klass, ORDERS))]), common


def sketch(items: np.ndarray, klass: int, percent: int) -> np.ndarray:
    """Parities of the shingles that fall into each of two bits per shingle of the class's largest sets."""
    bits = 64 * math.ceil(2 * class_ratio(percent) ** klass / 64)
    place = ((mix(items ^ _ODD[2]) >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _text_key() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def measure(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """rid (a number of the row), doc_id, text_key, n (shingles), node (digest of the set, null without shingles) and cuts:
    per class ``common`` and ``least``, how many segments and shingles a set that links shares with it, the segment hashes and the
    sketch."""
    cut = pa.struct([("c", pa.int32()), ("common", pa.int32()), ("least", pa.int64()), ("segments", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.string()), ("n", pa.int64()), ("node", pa.binary()), ("cuts", pa.list_(cut))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, rid = WordHashes(), TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                items = shingles(text.as_py(), k, known)
                n, cuts = len(items), []
                if n * (100 - percent) >= percent:  # smaller sets link with equal ones alone
                    for c in sorted({size_class(n, percent), size_class(n * 100 // percent, percent)}):
                        segments, common = segment_hashes(items, c, percent)
                        cuts.append({"c": c, "common": common, "least": n - most_differ(n, c, percent), "segments": segments.view(np.int64), "sketch": sketch(items, c, percent)})
                held.append((rid, doc_id, key, n, hashlib.md5(items.tobytes()).digest() if n else None, cuts))
                rid += 1
                size += n
                if size > 100_000 or len(held) > 20_000:
                    yield batch_of()
                    held, size = [], 0
        if held:
            yield batch_of()

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return whole.mapInArrow(releasing(rows), "rid long, doc_id long, text_key string, n long, node binary, cuts array<struct<c:int,common:int,least:long,segments:array<long>,sketch:array<long>>>")


def _differs(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _may_link(na: Column, nb: Column, sa: Column, sb: Column, percent: int) -> Column:
    sizes = (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
    return sizes & (_differs(sa, sb) * (100 + percent) <= (na + nb) * (100 - percent))


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, folder: str, name: str) -> DataFrame:
    """nid, n, part and items of the nodes whose nid is in ``wanted``: their sets, made again from one text of each and cut
    at fixed places of the order."""
    keys = stored(nodes.join(wanted.select("nid").distinct(), "nid", "left_semi").select("nid", "n", "text_key"), folder, f"{name}-keys")
    schema = pa.schema([("text_key", pa.string()), ("part", pa.int32()), ("items", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                items = shingles(text.as_py(), k, known)
                place = ((items >> np.uint64(32)) * np.uint64(COUNTED)) >> np.uint64(32)
                ends = np.searchsorted(place, np.arange(COUNTED + 1).astype(np.uint64))
                held += [(key, part, items[ends[part] : ends[part + 1]].view(np.int64)) for part in range(COUNTED) if ends[part] < ends[part + 1]]
                size += len(items)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    # short keys first; the exact key decides in the join with the nodes
    short = small(keys.select(F.xxhash64("text_key").alias("short")), BROADCAST_ROWS)
    texts = docs.select(_text_key().alias("text_key"), F.col("text").cast("string").alias("text")).withColumn("short", F.xxhash64("text_key")).join(short, "short", "left_semi")
    texts = texts.groupBy("text_key").agg(F.first("text").alias("text"))
    parts = texts.mapInArrow(releasing(cut), "text_key string, part int, items array<long>").join(keys, "text_key").select("nid", "n", "part", "items")
    with batches_of(docs.sparkSession, TEXTS):
        return stored(parts, folder, f"{name}-parts")


def verify(pairs: DataFrame, parts: DataFrame, percent: int, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) that link: the overlap of each part is counted by itself and summed per pair."""
    left = pairs.select("a", "b").join(parts.select(F.col("nid").alias("a"), "part", F.col("items").alias("x"), F.col("n").alias("na")), "a")
    both = left.join(parts.select(F.col("nid").alias("b"), "part", F.col("items").alias("y"), F.col("n").alias("nb")), ["b", "part"])
    counted = both.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("overlap"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    linked = summed.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent)
    return stored(linked.select("a", "b"), folder, f"{name}-links")


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """nid and root, the smallest node of its component, for every node of a link: large and small stars in turn until
    nothing changes."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, f"{name}-edges-0")
    state, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        turn += 1
        edges = stored(small.where("u <> v").distinct(), folder, f"{name}-edges-{turn}")
        remove(edges.sparkSession, f"{folder}/{name}-edges-{turn - 1}")
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("nid"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("nid"), F.col("v").alias("root")).distinct())


def without_frequent(often: DataFrame, cuts: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """s, c, nid and cap: what stands in the place of the rows of frequent segments.

    Any set that links with a node shares ``common`` of its segments, so that a node with fewer frequent ones is found by the
    others. The rest share single shingles, ``least`` at any rate: they are sought by those that are not frequent, of which the
    rarest of each set suffice, as many as it may have beside a common one, and by their frequent segments only where frequent shingles alone can make a link, as in copies of one text. Sets of na and nb
    shingles, ha and hb of them frequent, share min(ha, hb) of these at most, which must be percent / (100 + percent) of na + nb.
    So a set's partner there has no more than ``cap`` shingles; a set whose segment has none so small leaves it. Null: no cap.
    """
    count = F.count(F.lit(1))
    hard = often.groupBy("nid", "c").agg(count.alias("h")).join(cuts.select("nid", "n", "c", "common", "least"), ["nid", "c"]).where("h >= common").select("nid", "n", "c", "least")
    hard = stored(hard, folder, "hard")
    sets = sets_of(hard, nodes, docs, k, folder, "hard").select("nid", "items").join(hard, "nid")
    sets = sets.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few sets may be of one group, in few tasks
    single = sets.select("c", "nid", "n", "least", F.explode("items").alias("item")).select(F.xxhash64("c", "item").alias("s"), "c", "nid", "n", "least")
    single = stored(single, folder, "single")
    known = single.groupBy("s").agg(count.alias("m")).where("m > 1")
    of_set = Window.partitionBy("nid", "c")
    placed = single.join(known, "s").withColumn("also", count.over(of_set)).withColumn("place", F.row_number().over(of_set.orderBy("m", "s")))
    # the first shingle in the order (m, s) that two sets share has at most n - least others of each before it, those of one set included
    rare = placed.where(f"m < {FREQUENT} AND place <= also - least + 1").select("s", "c", "nid", F.lit(None).cast("long").alias("cap"))
    held = placed.where(f"m >= {FREQUENT}").groupBy("nid", "n", "c", "least").agg(count.alias("h"))
    alike = held.where("h >= least").select("nid", "n", "c", F.floor(F.col("h") * (100 + percent) / percent - F.col("n") + 1e-6).alias("cap"))
    back = often.select("s", "c", "nid").join(alike, ["nid", "c"])
    smallest = back.groupBy("s").agg(F.min("n").alias("smallest"))
    return rare.unionByName(back.join(smallest, "s").where("cap >= smallest").select("s", "c", "nid", "cap"))


def placed_in(active: DataFrame, roots: DataFrame | None) -> DataFrame:
    """s, c, nid, cap and root, the component that the node belongs to so far."""
    if roots is None:
        return active.select("s", "c", "nid", "cap", F.col("nid").alias("root"))
    return active.select("s", "c", "nid", "cap").join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))


def meeting(placed: DataFrame, turn: int) -> DataFrame:
    """a, c, b: of every segment with nodes of two components, each node a with one node b that is in another component than
    itself. In each segment and turn two nodes of different components, drawn by a hash, stand for the rest; in turn 0, when
    every node is a component, its first and its last one."""
    if not turn:
        stand = placed.groupBy("s").agg(F.min("nid").alias("x"), F.max("nid").alias("y")).where("x <> y")
        return placed.join(stand, "s").select(F.col("nid").alias("a"), "c", F.explode(F.array("x", "y")).alias("b")).where("a <> b").distinct()
    drawn = F.struct(F.xxhash64("nid", "s", F.lit(turn)).alias("h"), "root", "nid")
    one = placed.groupBy("s").agg(F.min(drawn).alias("x"))
    placed = placed.join(one, "s")
    other = placed.where("root <> x.root").groupBy("s").agg(F.min(drawn).alias("y"))
    return placed.join(other, "s").select(F.col("nid").alias("a"), "c", F.when(F.col("root") != F.col("x.root"), F.col("x.nid")).otherwise(F.col("y.nid")).alias("b")).distinct()


def near(met: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b and d, the distance of their sketches, of the pairs that may link."""
    may = _may_link(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), percent)
    found = met.join(_side(sketches, "a"), ["a", "c"]).join(_side(sketches, "b"), ["b", "c"]).where(may)
    return found.select("a", "b", _differs(F.col("sa"), F.col("sb")).alias("d"))


def nearest(found: DataFrame) -> DataFrame:
    """At most one pair (a, b) for each node: that with the nearest sketch."""
    best = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", "best.b")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _side(sketches: DataFrame, side: str) -> DataFrame:
    return sketches.select(F.col("nid").alias(side), "c", F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))


def across(placed: DataFrame, sketches: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """s, c, nid, root, cap and whether the node is the first or the last of its component in the segment, of the segments with nodes
    of two components: those of few rows without a cap, and the others with n and sketch."""
    stand = placed.groupBy("s", "root").agg(F.min("nid").alias("first"), F.max("nid").alias("last"))
    open_ = placed.groupBy("s").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m"), F.count("cap").alias("caps")).where("r0 <> r1")
    open_ = open_.select("s", ((F.col("m") <= NARROW) & (F.col("caps") == 0)).alias("few"))
    placed = placed.join(open_, "s").join(stand, ["s", "root"]).withColumn("first", F.col("nid") == F.col("first")).withColumn("last", F.col("nid") == F.col("last"))
    placed = stored(placed.select("few", "s", "c", "nid", "root", "cap", "first", "last"), folder, "placed")
    wide = placed.where("NOT few").join(sketches, ["nid", "c"]).select("s", "nid", "root", "n", "cap", "sketch", "first", "last")
    return placed.where("few").select("s", "c", "nid", "root", "first", "last"), stored(wide, folder, "wide")


def met_by_number(left: DataFrame, right: DataFrame, sketches: DataFrame, percent: int, order: str, folder: str, name: str) -> DataFrame:
    """As ``met_across`` for segments of few rows: sketches go to their distinct pairs, which share many segments, not to the rows."""
    side = lambda df, x: df.select(F.col("s").alias(f"s_{x}"), F.col("c").alias(f"c_{x}"), F.col("nid").alias(x), F.col("root").alias(f"r{x}"), F.col("first").alias(f"first_{x}"), F.col("last").alias(f"last_{x}"))
    met = side(left, "a").join(side(right, "b"), (F.col("s_a") == F.col("s_b")) & (F.col("ra") != F.col("rb")) & F.expr(order))
    met = stored(met.select(F.least("a", "b").alias("a"), F.col("c_a").alias("c"), F.greatest("a", "b").alias("b")).distinct(), folder, f"{name}-met")
    whose = stored(met.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), folder, f"{name}-whose")
    return near(met, sketches.join(small(whose, BROADCAST_ROWS), "nid", "left_semi"), percent).select("a", "b")


def met_across(left: DataFrame, right: DataFrame, percent: int, order: str) -> DataFrame:
    """The pairs (a, b) of a segment's nodes in different components that may link."""
    side = lambda df, x: df.select(F.col("s").alias(f"s_{x}"), F.col("nid").alias(x), *[F.col(c).alias(f"{o}{x}") for c, o in (("root", "r"), ("n", "n"), ("sketch", "s"), ("cap", "cap_"), ("first", "first_"), ("last", "last_"))])
    fits = (F.col("cap_a").isNull() | (F.col("nb") <= F.col("cap_a"))) & (F.col("cap_b").isNull() | (F.col("na") <= F.col("cap_b")))
    may = _may_link(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), percent)
    met = side(left, "a").join(side(right, "b"), (F.col("s_a") == F.col("s_b")) & (F.col("ra") != F.col("rb")) & F.expr(order) & fits & may)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contracted(roots: DataFrame | None, links: DataFrame, folder: str, name: str) -> DataFrame:
    """nid and root of every linked node, after ``links`` have joined components."""
    if roots is None:
        return components(links, folder, name)
    of = lambda side: roots.select(F.col("nid").alias(side), F.col("root").alias(f"r{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(ends.where("a <> b").distinct(), folder, name).withColumnRenamed("root", "new")
    old = roots.join(moved.withColumnRenamed("nid", "root"), "root", "left").select("nid", F.coalesce("new", "root").alias("root"))
    single = moved.join(roots.select("nid"), "nid", "left_anti").select("nid", F.col("new").alias("root"))
    return stored(old.unionByName(single), folder, f"{name}-roots")


def linked_roots(active: DataFrame, often: DataFrame | None, cuts: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, folder: str) -> DataFrame | None:
    """nid and root, a number of its component, of every node that links with another; None if none does. ``often`` has the rows of
    frequent segments: some take part in the rounds, which are there to save work, and all of them afterwards where their nodes are
    still in different components."""
    every = active if often is None else stored(active.unionByName(often.where(F.pmod("s", F.lit(ROUNDS_TAKE)) == 0)), folder, "every")
    whose = active if often is None else active.select("nid").unionByName(often.select("nid"))
    sketches = stored(cuts.join(small(stored(whose.select("nid").distinct(), folder, "whose"), BROADCAST_ROWS), "nid", "left_semi").select("nid", "n", "c", "sketch"), folder, "sketches")
    found = stored(near(meeting(every, 0), sketches, percent), folder, "near-0")
    involved = stored(found.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), folder, "involved")
    parts = sets_of(involved, nodes, docs, k, folder, "involved")
    pairs, roots, turn, first_links, done = nearest(found), None, 0, 0, None
    inner = stored(every.join(small(involved, BROADCAST_ROWS), "nid", "left_semi"), folder, "inner")
    remove(docs.sparkSession, f"{folder}/every")
    while True:
        pairs = stored(pairs, folder, f"pairs-{turn}")
        done = pairs if done is None else done.unionByName(pairs)
        links = verify(pairs, parts, percent, folder, f"round-{turn}")
        linked = links.count()
        roots = contracted(roots, links, folder, f"round-{turn}") if linked else roots
        first_links, turn = first_links or linked, turn + 1
        if linked * WORTH <= first_links:  # all pairs that are left follow
            break
        met = near(meeting(placed_in(inner, roots), turn), sketches, percent).withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
        pairs = nearest(met.join(done.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti"))
    if often is not None:
        # a frequent segment whose nodes have become one component asks for nothing more
        placed = placed_in(often, roots)
        open_ = placed.groupBy("s").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("s")
        left = stored(often.join(open_, "s", "left_semi"), folder, "often")
        if left.limit(1).count():
            active = stored(active.unionByName(without_frequent(left, cuts, nodes, docs, k, percent, folder)), folder, "open")
            for name in ("single", "hard-parts", "active"):
                remove(docs.sparkSession, f"{folder}/{name}")
    # then all pairs: of the first and of the last nodes of the components in each segment, and of the others where these
    # have not joined their components; no pair is verified twice
    narrow, wide = across(placed_in(active, roots), sketches, folder)
    for name in ("inner", "near-0"):
        remove(docs.sparkSession, f"{folder}/{name}")
    steps = {
        "ends": ("first OR last", "first OR last", "ra < rb AND ((first_a AND first_b) OR (last_a AND last_b))"),  # met with itself: shuffled once
        "others": ("NOT first", "true", "(first_b OR a < b) AND NOT (last_a AND last_b)"),
    }
    for name, (of_a, of_b, order) in steps.items():
        met = met_by_number(narrow.where(of_a), narrow.where(of_b), sketches, percent, order, folder, name)
        met = met.unionByName(met_across(wide.where(of_a), wide.where(of_b), percent, order)).distinct()
        rest = stored(met.join(done, ["a", "b"], "left_anti"), folder, name)
        if not rest.limit(1).count():
            continue
        done = done.unionByName(rest)
        wanted = stored(rest.select(F.explode(F.array("a", "b")).alias("nid")).distinct().join(parts.select("nid").distinct(), "nid", "left_anti"), folder, f"{name}-wanted")
        if wanted.limit(1).count():  # the sets that were not made yet
            parts = parts.unionByName(sets_of(wanted, nodes, docs, k, folder, name))
        links = verify(rest, parts, percent, folder, name)
        if not links.limit(1).count():
            continue
        roots = contracted(roots, links, folder, name)
        sent = small(roots, BROADCAST_ROWS)
        narrow, wide = (x.drop("root").join(sent, "nid", "left").withColumn("root", F.coalesce("root", "nid")) for x in (narrow, wide))

    return roots


def classes(docs: DataFrame, k: int = 5, percent: int = 80, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, text_key (MD5 of the text), n_shingles, component_id, the smallest doc_id that links
    reach, and root, a number of the component (null without shingles).

    Two documents link where 100 |intersection| >= ``percent`` |union| of their sets of k-word shingles, in ASCII lower
    case. Texts without words, null ones included, have no shingle and link with nothing; their component is their own
    doc_id. Null doc_ids take part, but name no component unless all its ids are null. Repeated rows are equal sets, so
    linked. Sets are made of whole texts, however long; one text's set must fit in a task's memory. An empty table gives no row;
    other columns are not read.
    """
    folder = folder or shared_dir(docs.sparkSession)
    with batches_of(docs.sparkSession, TEXTS):
        measured = stored(measure(docs, k, percent), folder, "measured")
    nodes = measured.where("node IS NOT NULL").groupBy("node").agg(F.min("rid").alias("nid"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("m"))
    nodes = stored(nodes, folder, "nodes")
    # the cuts of one row of each node: read beside the measures while the numbers of those rows can be broadcast
    first = measured.select(F.col("rid").alias("nid"), "n", "cuts")
    few = nodes.count() <= BROADCAST_ROWS
    first = first.join(F.broadcast(nodes.select("nid")), "nid", "left_semi") if few else stored(first.join(nodes.select("nid"), "nid", "left_semi"), folder, "cuts")
    cuts = first.select("nid", "n", F.explode_outer("cuts").alias("cut")).where("cut IS NOT NULL").select("nid", "n", "cut.*")
    segments = cuts.select("nid", "c", F.explode_outer("segments").alias("s"))
    shared = segments.groupBy("s").agg(F.min("nid").alias("first"), F.max("nid").alias("last"), F.first("c").alias("c"), F.count(F.lit(1)).alias("m"))
    shared = stored(shared.where("first <> last"), folder, "shared")
    # a segment of two nodes is known in full; the others' nodes are joined back
    two = shared.where("m = 2").select("s", "c", F.explode(F.array("first", "last")).alias("nid"))
    more = segments.select("s", "nid").join(small(shared.where("m > 2").select("s", "c", "m"), BROADCAST_ROWS), "s")
    more = stored(more, folder, "more")
    active = two.unionByName(more.where(F.col("m") < FREQUENT).drop("m")).withColumn("cap", F.lit(None).cast("long"))
    active = stored(active, folder, "active")
    often = more.where(F.col("m") >= FREQUENT).drop("m").withColumn("cap", F.lit(None).cast("long"))
    often = often if often.limit(1).count() else None
    member = nodes.select("node", "nid", "first_id", "m")
    any_ = often is not None or active.limit(1).count()
    if any_ and (roots := linked_roots(active, often, cuts, nodes, docs, k, percent, folder)) is not None:
        linked = stored(roots.join(nodes.select("nid", "first_id"), "nid"), folder, "linked")
        named = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
        named = join_keyed(linked.select("nid", "root"), stored(named, folder, "named"), "root", linked.count())
        member = member.join(named, "nid", "left")
        member = member.select("node", "m", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "nid").alias("root"))
    else:
        member = member.select("node", "m", F.col("first_id").alias("component_id"), F.col("nid").alias("root"))
    with_set = measured.where("node IS NOT NULL").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node")
    with_set = join_keyed(with_set, stored(member, folder, "member"), "node", with_set.count()).select("doc_id", "text_key", "n_shingles", "component_id", "root")
    without = measured.where("node IS NULL").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return with_set.unionByName(without)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one: that of smallest doc_id, then of smallest text key.

    Rows that repeat both doc_id and text count once: any of them stays, whatever it has in further columns. Rows whose text has no words, null ones too, stay all. An empty table
    stays empty. Columns stay as they were, whatever their names.
    """
    folder = options.setdefault("folder", shared_dir(docs.sparkSession))
    found = stored(classes(docs, **options).where("n_shingles > 0"), folder, "found")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    chosen = found.groupBy("root").agg(F.min(key).alias("x"))
    chosen = chosen.select(F.col("x.doc_id").alias("id"), F.col("x.text_key").alias("key"))
    ids = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    other = ids.join(chosen, ids["id"].eqNullSafe(chosen["id"]) & (ids["key"] == chosen["key"]), "left_anti")
    other = stored(other.distinct(), folder, "removed")
    twice = stored(ids.groupBy("id", "key").count().where("count > 1").drop("count"), folder, "repeated")
    name = fresh(docs, "text_key")
    keyed = docs.withColumn(name, _text_key())
    same = lambda rows, k: rows["doc_id"].cast("long").eqNullSafe(k["id"]) & (rows[name] == k["key"])
    removed = small(other, BROADCAST_KEYS)
    kept = keyed.join(removed, same(keyed, removed), "left_anti")
    if twice.limit(1).count():
        repeated = small(twice, BROADCAST_KEYS)
        kept = kept.join(repeated, same(kept, repeated), "left_anti").unionByName(kept.join(repeated, same(kept, repeated), "left_semi").dropDuplicates(["doc_id", name]))
    return kept.drop(name)
