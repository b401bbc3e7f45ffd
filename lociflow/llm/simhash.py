"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link where at most ``radius`` bits differ. Each one emits the variants within half the radius around it, and two
that link emit a common variant. An odd radius has no half: of two fingerprints that differ in an odd number of bits, one has
an odd number of set bits, so that these emit the ball of the half rounded up and the others that of the half rounded down.

Variants are shuffled by their leading bits. All variants of a fingerprint below one lead are one row, (lead, fingerprint),
which the task that gets it writes out and sorts; the flips still allowed follow from the bits in which the two differ. A task
with more variants than ``HELD`` takes one further leading bit at a time, so that its memory is bounded. As only distinct
fingerprints emit, a dense group of them must differ in many bits, so that its variants have many leads.

All that emit a variant lie within half the radius of it, so that one of them stands for the rest: each of them links with it,
and no variant turns into all its pairs. Links are deduplicated and their distance verified.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import join_keyed, shared_dir, stored
from lociflow.llm.jaccard import components

BITS = 64
SEED = 42
#: Variants that a task sorts at a time.
HELD = 2_000_000
#: Leading bits at most; more would only repeat the fingerprints.
MOST_LEAD = 32

words_of_bytes = re.compile(rb"[^\x20\x09-\x0D]+").findall


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; a text of fewer words is one shingle, none without words."""
    words = words_of_bytes(text.encode().lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 where over half of the hashes have it; 0 without hashes."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 << 8):
        some = hashes[at : at + (255 << 8)]
        rows = np.zeros((-(-len(some) // 255) * 255, BITS // 8), np.uint8)
        rows[: len(some)] = some.astype("<u8").view(np.uint8).reshape(-1, BITS // 8)
        # 255 bits sum up within a byte
        count += np.unpackbits(rows, axis=1, bitorder="little").reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(shingle_hashes(t.as_py(), k)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, fp long")


def flips(bits: int, n: int) -> np.ndarray:
    """All masks of n of the ``bits`` lowest bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), n)], np.uint64)


def reach(fp: np.ndarray, radius: int) -> np.ndarray:
    """How many bits the variants of a fingerprint may differ from it."""
    return radius // 2 + (radius % 2) * (np.bitwise_count(fp) & 1).astype(np.int64)


def links_below(fps: np.ndarray, lead: int, t: int, radius: int, held: int = HELD) -> Iterator[np.ndarray]:
    """Pairs of distinct fingerprints that emit a common variant whose ``t`` leading bits are ``lead``."""
    low = BITS - t
    top = fps >> np.uint64(low) if t else np.zeros_like(fps)
    left = reach(fps, radius) - np.bitwise_count(top ^ np.uint64(lead)).astype(np.int64)
    fps, left = fps[left >= 0], left[left >= 0]
    most = radius - radius // 2
    ball = np.cumsum([math.comb(low, n) for n in range(most + 1)])
    if int(ball[left].sum()) > held and t < BITS - 8:
        yield from links_below(fps, 2 * lead, t + 1, radius, held)
        yield from links_below(fps, 2 * lead + 1, t + 1, radius, held)
        return
    base = (fps & np.uint64((1 << low) - 1)) | np.uint64(lead << low)
    variants, sources = [], []
    for n in range(most + 1):
        at, masks = np.flatnonzero(left >= n), flips(low, n)
        variants.append((base[at, None] ^ masks[None, :]).ravel())
        sources.append(np.repeat(fps[at], len(masks)))
    variant, source = np.concatenate(variants), np.concatenate(sources)
    order = np.argsort(variant)
    variant, source = variant[order], source[order]
    same = variant[1:] == variant[:-1]
    meets = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(same) else np.zeros(0, np.int64)
    if not len(meets):
        return
    variant, source = variant[meets], source[meets]
    starts = np.concatenate([[0], np.flatnonzero(variant[1:] != variant[:-1]) + 1])
    # one within the half rounded down stands for all; without one, those that link meet around another variant
    near = np.bitwise_count(variant ^ source) <= radius // 2
    hub = np.minimum.reduceat(np.where(near, source, ~np.uint64(0)), starts)
    sizes = np.diff(np.concatenate([starts, [len(variant)]]))
    hub, known = np.repeat(hub, sizes), np.repeat(np.logical_or.reduceat(near, starts), sizes)
    pairs = np.stack([hub, source], axis=1)[known & (hub != source)]
    yield np.unique(pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius], axis=0)


def leads(fp: Column, t: int, radius: int) -> Column:
    """The leading ``t`` bits of all variants of a fingerprint."""
    own = F.shiftrightunsigned(fp, BITS - t)
    ball = lambda n: F.array(*[F.lit(int(x)) for d in range(n + 1) for x in flips(t, d)])
    masks = ball(radius // 2)
    if radius % 2:
        masks = F.when(F.bit_count(fp) % 2 == 1, ball(radius // 2 + 1)).otherwise(masks)
    return F.transform(masks, lambda x: own.bitwiseXOR(x))


def links(nodes: DataFrame, total: int, radius: int, folder: str) -> DataFrame:
    """a and b, pairs of the ``total`` distinct fingerprints ``fp`` of ``nodes`` that differ in at most ``radius`` bits, whose
    components are those of all such pairs."""
    ball = sum(math.comb(BITS, n) for n in range(radius - radius // 2 + 1))
    parts = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = min(MOST_LEAD, math.ceil(math.log2(max(2, parts, total * ball / HELD))))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        found = list(links_below(fps, table.column("lead")[0].as_py(), t, radius))
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *found]), axis=0).view(np.int64)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    sent = nodes.select("fp", F.explode(leads(F.col("fp"), t, radius)).alias("lead"))
    return stored(sent.groupBy("lead").applyInArrow(meet, "a long, b long").distinct(), folder, "links")


def classes(docs: DataFrame, k: int = 3, radius: int = 3, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hexadecimal digits), component_id, the smallest doc_id that
    links reach.

    Shingles are k words joined by blanks, in ASCII lower case; of fewer words, all of them. Texts without words, null ones
    included, have fingerprint zero and link like any other. Whole texts are hashed, however long. Repeated rows and equal
    fingerprints are one node. Null doc_ids take part, but name no component unless all its ids are null. An empty table
    gives no row; other columns are not read.
    """
    folder = folder or shared_dir(docs.sparkSession)
    measured = stored(fingerprints(docs, k), folder, "measured")
    count = F.count(F.lit(1))
    nodes = stored(measured.groupBy("fp").agg(F.min("doc_id").alias("first_id"), count.alias("m")), folder, "nodes")
    linked = links(nodes, nodes.count(), radius, folder)
    if linked.limit(1).count():
        roots = components(linked, folder, "stars").withColumnRenamed("nid", "fp")
        nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        nodes = stored(nodes, folder, "rooted")
        # a component of many nodes must not gather in one task: its name is found by partial sums and sent back by size
        named = stored(nodes.groupBy("root").agg(F.min("first_id").alias("component_id"), count.alias("m")), folder, "named")
        nodes = stored(join_keyed(nodes.select("fp", "root", F.col("m").alias("copies")), named, "root", nodes.count()).select("fp", "component_id", F.col("copies").alias("m")), folder, "members")
    else:
        nodes = nodes.withColumnRenamed("first_id", "component_id")
    found = join_keyed(measured, nodes.select("fp", "component_id", "m"), "fp", measured.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
