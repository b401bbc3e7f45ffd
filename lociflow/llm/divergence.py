"""Audit of how far the sources of a language diverge in their terms.

A byte-level tokenizer reads whole batches of texts as one buffer: a lookup table marks the bytes of terms (ASCII letters and all
bytes of other characters), the edges of the marks are the terms' bounds, and XXH64 groups equal slices, whose bytes are then
compared. Counts of a batch are a sparse matrix of documents and terms in compressed rows, summed per source by ``reduceat``.

Spark sums these counts per language, source and term. Shares are whole billionths, so that all arithmetic is exact. Sources are
compared in blocks of terms: each block is a sparse matrix of sources and terms in a task of its own, where the differences of a
row to all others are one ``reduceat``, and the blocks' sums are added per pair. A term that neither source has differs by their
shares of a term without occurrence, which is added for all such terms at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.llm.common import shared_dir, small, stored

#: Bytes of text that are tokenized at a time; a longer text is taken alone.
BUFFER = 4_000_000
#: Terms of a block, on average.
BLOCK = 1024
#: Sources whose pairs are compared in one task.
TILE = 256
#: Rows of the table of groups, of four numbers and two names each, up to which it is sent to every executor.
BROADCAST_ROWS = 20_000
#: Parts in which a group's terms are ranked before their first ones are ranked together.
SPREAD = 16
UNIT = 1_000_000_000

_BYTES = np.arange(256)
_IS_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
IS_TERM = _IS_UPPER | (_BYTES >= 0x61) & (_BYTES <= 0x7A) | (_BYTES >= 0x80)
LOWERED = np.where(_IS_UPPER, _BYTES + 0x20, _BYTES).astype(np.uint8)


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every term of the documents data[offsets[i]:offsets[i + 1]]."""
    mark = IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)  # where a document begins
    edge[offsets] = True
    before = np.concatenate([[False], mark[:-1]]) & ~edge[:-1]
    after = np.concatenate([mark[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's group and the groups' bytes: slices of equal hash are one group if their bytes are equal, else
    those that differ from the group's first are grouped anew."""
    whole = data.tobytes()
    pieces = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    hashes = np.fromiter(map(digest, pieces), np.uint64, len(pieces))
    number, names, rest = np.zeros(len(pieces), np.int64), [], np.arange(len(pieces))
    while len(rest):
        _, first, which = np.unique(hashes[rest], return_index=True, return_inverse=True)
        same = same_bytes(data, starts, ends, rest, rest[first][which])
        number[rest[same]] = which[same] + len(names)
        names += [pieces[i] for i in rest[first].tolist()]
        rest = rest[~same]
    return number, names


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether slice one[i] has the bytes of slice other[i]."""
    size = ends[one] - starts[one]
    same = size == ends[other] - starts[other]
    check = np.flatnonzero(same & (one != other))
    if len(check):
        size = size[check]
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(begin, size)
        equal = data[np.repeat(starts[one[check]], size) + step] == data[np.repeat(starts[other[check]], size) + step]
        same[check] = np.logical_and.reduceat(equal, begin)
    return same


def tally(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of every group and term that occur; ``group`` has the group of each document."""
    starts, ends, doc = bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    term, names = grouped(LOWERED[data], starts, ends)
    # compressed rows: the terms of each document and how often it has them
    cell, n = np.unique(doc * len(names) + term, return_counts=True)
    row, column = np.divmod(cell, len(names))
    # summed per group
    key = group[row] * len(names) + column
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    groups, columns = np.divmod(key[begin], len(names))
    return groups, [names[c] for c in columns.tolist()], np.add.reduceat(n, begin), np.diff(np.concatenate([begin, [len(key)]]))


def occurrences(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents), summed over all rows."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).cast(pa.large_binary())
            size = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])
            at = 0
            while at < len(text):
                stop = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), BUFFER, side="right")))
                known: dict[tuple[str, str], int] = {}
                group = np.array([known.setdefault(x, len(known)) for x in zip(batch.column(0)[at:stop].to_pylist(), batch.column(1)[at:stop].to_pylist())], np.int64)
                offsets = np.concatenate([[0], np.cumsum(size[at:stop])])
                begin = int(np.frombuffer(text.buffers()[1], np.int64)[text.offset + at])
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[begin : begin + int(offsets[-1])]
                groups, terms, n, df = tally(data, offsets, group)
                names = list(known)
                lang, source = ([names[g][i] for g in groups.tolist()] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((lang, source, [x.decode() for x in terms], n, df), schema)], schema=schema)
                at = stop

    return docs.mapInArrow(rows, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), in whole numbers."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (wide(n) + 5), wide(total) + 5 * wide(terms)) + 1


def compare(source: np.ndarray, term: np.ndarray, share_: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A matrix with, per two sources, the sum over the terms that either has of how much more their shares differ there than
    ``base`` does, the shares of a term without occurrence. Entries (source, term, share) are sorted by source."""
    width = int(term.max()) + 1 if len(term) else 0
    ptr = np.searchsorted(source, np.arange(len(base) + 1))
    full = np.flatnonzero(np.diff(ptr))
    found = np.zeros((len(base), len(base)), np.int64)
    for i in full.tolist():
        own, has = np.full(width, base[i]), np.zeros(width, bool)
        mine = slice(ptr[i], ptr[i + 1])
        own[term[mine]], has[term[mine]] = share_[mine], True
        apart = np.abs(base[i] - base[source])
        # at the others' terms, less what the next line counts there too
        there = np.abs(own[term] - share_) - apart - has[term] * (np.abs(own[term] - base[source]) - apart)
        found[i, full] += np.add.reduceat(there, ptr[full])
        found[i] += np.abs(share_[mine][:, None] - base[None, :]).sum(axis=0) - (ptr[i + 1] - ptr[i]) * np.abs(base[i] - base)
        rest = np.setdiff1d(np.arange(len(base)), full)
        found[rest, i] = found[i, rest]  # a source without entries has no turn of its own
    return found


def audit(docs: DataFrame, least_docs: int = 30, ranks: int = 50, folder: str | None = None) -> DataFrame:
    """lang, source, part, item, value and rank: per source of a language its distance to each other source (``pair``), and the
    terms that it has more of than the language (``term``, the first ``ranks``).

    Null text, lang and source are read as ''. Terms are runs of letters A-Z, in lower case, and of characters beyond ASCII, in
    whole texts, however long. A language keeps the terms of at least ``least_docs`` of its rows; repeated rows count each.
    Sources without terms are compared like all; without kept terms all distances are 0. Equal values are ranked by the item's
    UTF-8 bytes. A language with one source has no pair. An empty table gives no row; other columns are not read.
    """
    folder = folder or shared_dir(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(occurrences(docs), folder, "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= least_docs).drop("df")
    kept = stored(kept, folder, "kept")
    cells = stored(counts.drop("df").join(kept, ["lang", "term"]), folder, "cells")
    # every group, with its occurrences of kept terms, and its place among the language's sources
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    place = Window.partitionBy("lang").orderBy("source")
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "terms", "lang_total"])
    groups = groups.withColumn("place", F.row_number().over(place) - 1)
    groups = groups.select("lang", "source", "place", "terms", F.col("n").alias("total"), "lang_total", F.when(F.col("terms") > 0, share(F.lit(0), F.col("n"), F.col("terms"))).otherwise(0).alias("base"))
    groups = stored(groups, folder, "groups")
    cells = cells.join(small(groups, BROADCAST_ROWS), ["lang", "source"])
    cells = cells.withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))})
    return pairs(cells, groups).unionByName(leading(cells, ranks))


def leading(cells: DataFrame, ranks: int) -> DataFrame:
    """The first ``ranks`` terms of each group by how much more of them it has than its language."""
    order = [F.desc("value"), F.asc("term")]
    first = Window.partitionBy("lang", "source", "_part").orderBy(*order)
    found = cells.where("p > q").select("lang", "source", "term", (F.col("p") - F.col("q")).alias("value"), F.pmod(F.xxhash64("term"), F.lit(SPREAD)).alias("_part"))
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ranks)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= ranks)
    return found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The distance of every two sources of a language. All sources, with a share for terms without occurrence, go to every
    block, so that the blocks alone make all pairs."""
    tile = F.floor(F.col("place") / TILE).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK))
    tiles = groups.groupBy("lang").agg(F.max(tile).alias("last"))
    # a tile of sources meets each tile; a pair of tiles is one task for each block
    met = lambda df: df.join(tiles, "lang").withColumn("tile", tile).withColumn("with", F.explode(F.sequence(F.lit(0), "last"))).select("*", F.least("tile", "with").alias("x"), F.greatest("tile", "with").alias("y"))
    entries = met(cells.withColumn("block", F.pmod(F.xxhash64("term"), blocks))).select("lang", "block", "x", "y", "place", "term", "p")
    bare = met(groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))).select("lang", "block", "x", "y", "place", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"))
    schema = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("more", pa.int64())])

    def differ(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        has = table.column("term").is_valid().to_numpy()
        place, p = table.column("place").to_numpy(), table.column("p").to_numpy()
        places, base = place[~has], p[~has]
        places, base = places[np.argsort(places)], base[np.argsort(places)]
        term = table.column("term").filter(table.column("term").is_valid()).combine_chunks().dictionary_encode().indices.to_numpy()
        source = np.searchsorted(places, place[has])
        order = np.argsort(source, kind="stable")
        found = compare(source[order], term[order], p[has][order], base)
        i, j = np.nonzero((places[:, None] < places[None, :]) & ((x == y) | (places[:, None] // TILE == x) & (places[None, :] // TILE == y)))
        lang = pa.array([table.column("lang")[0].as_py()] * len(i), pa.string())
        return pa.Table.from_arrays([lang, pa.array(places[i], pa.int32()), pa.array(places[j], pa.int32()), pa.array(found[i, j])], schema=schema)

    more = entries.unionByName(bare).groupBy("lang", "block", "x", "y").applyInArrow(differ, "lang string, i int, j int, more long")
    more = more.groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))
    side = lambda s: groups.select("lang", "terms", F.col("place").alias(s), F.col("source").alias(f"source_{s}"), F.col("base").alias(f"base_{s}"))
    every = more.join(side("i"), ["lang", "i"]).join(side("j").drop("terms"), ["lang", "j"])
    value = (F.col("terms") * F.abs(F.col("base_i") - F.col("base_j")) + F.col("more")).alias("value")
    both = F.explode(F.array(F.struct(F.col("source_i").alias("source"), F.col("source_j").alias("item")), F.struct(F.col("source_j").alias("source"), F.col("source_i").alias("item"))))
    found = every.select("lang", value, both.alias("e")).select("lang", "e.source", "e.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
