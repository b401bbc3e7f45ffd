"""Compression of vectors to codes of one small codebook for each part position.

Components become whole numbers, so that all arithmetic is exact. Equal parts of a position are one distinct row with a weight;
weighted Lloyd steps run over the distinct rows alone, and their codes and errors are joined back to the vectors. A codebook
holds ``ENTRIES`` entries, so that the codebooks, and the sums that a step adds up for them, have the size of 64 vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import join_keyed, shared_dir, stored

PARTS = 16
ENTRIES = 64
SCALE = 256
#: Whole numbers are held within this, so that squared distances of 4,096 components fit a long.
LARGEST = 1 << 24
#: Distances that a task holds at a time.
HELD = 1 << 20


def whole(x: Column) -> Column:
    """floor(256 x), held within the largest whole number; the product is exact."""
    return F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(SCALE)) * x.cast("double")))).cast("int")


def kept(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with ``_v``, the vector in whole numbers, without rows whose vector is null, empty or holds null or non-finite
    components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))).withColumn("_v", F.transform(v, whole))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the entry of ``book`` at the smallest squared distance, the first of equals, and that distance."""
    entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    # a float product is exact while all its sums are below 2^53
    largest = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    exact = 4 * int(largest) ** 2 * x.shape[1] < 1 << 53
    step = max(1, HELD // (len(book) * (1 if exact else x.shape[1])))
    for at in range(0, len(x), step):
        some = x[at : at + step]
        if exact:
            d = (some**2).sum(axis=1)[:, None] - 2 * (some.astype(float) @ book.T.astype(float)).astype(np.int64) + (book**2).sum(axis=1)[None, :]
        else:
            d = ((some[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        entry[at : at + step] = d.argmin(axis=1)
        error[at : at + step] = d.min(axis=1)
    return entry, error


def _parts_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and components of each row."""
    return batch.column("pos").to_numpy(), batch.column("part").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def step(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one Lloyd step: each entry becomes the floor of the mean of its parts, unused ones stay."""
    width = books.shape[2]
    schema = pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("j", pa.int32()), ("s", pa.int64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, books.shape[1], width + 1), np.int64)  # the last column counts
        for batch in batches:
            pos, x = _parts_of(batch, width)
            m = batch.column("m").to_numpy()
            for p in np.unique(pos).tolist():
                own = x[pos == p]
                np.add.at(total[p], nearest(own, books[p])[0], np.concatenate([own, np.ones((len(own), 1), np.int64)], axis=1) * m[pos == p][:, None])
        pos, entry = np.nonzero(total[:, :, width])
        at = np.repeat(np.arange(len(pos)), width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(pos[at], pa.int32()), pa.array(entry[at], pa.int32()), pa.array(np.tile(np.arange(width + 1), len(pos)), pa.int32()), pa.array(total[pos, entry].ravel())], schema=schema)

    found = distinct.mapInArrow(sums, "pos int, entry int, j int, s long").groupBy("pos", "entry", "j").agg(F.sum("s").alias("s"))
    total = np.zeros((PARTS, books.shape[1], width + 1), np.int64)
    for r in found.toLocalIterator():  # one row for each number of the codebooks
        total[r.pos, r.entry, r.j] = r.s
    n = total[:, :, width:]
    return np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), books)


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = 2, folder: str | None = None) -> DataFrame:
    """One row per kept vector: the key, ``code`` (two hexadecimal digits for each part), ``error`` (squared distance to the coded
    vector), ``label_error`` (summed over equal labels) and ``codebooks_sha256`` (of all final codebooks).

    Rows are dropped whose vector is null, empty, or holds null or non-finite components; also those whose length is not the
    commonest one or no multiple of 16. Components beyond 65,536 count as that. The codebooks start with the vectors of the 64
    smallest keys, null keys last, equal keys by their components; of equally near entries the first is taken. Repeated rows
    have a result each and weigh twice. Null labels are one label. An empty table gives no row; other columns are not read.
    """
    folder = folder or shared_dir(df.sparkSession)
    clean = kept(df.select(F.col(key).alias("_key"), F.col(label).cast("string").alias("_label"), F.col(vector).alias("_vector")), "_vector").drop("_vector")
    vectors = stored(clean.withColumn("_row", F.monotonically_increasing_id()), folder, "vectors")
    sizes = vectors.groupBy(F.size("_v").alias("n")).count().where(f"n % {PARTS} = 0").orderBy(F.desc("count"), "n").first()
    empty = vectors.select(F.col("_key").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    if sizes is None:
        return empty
    width = sizes.n // PARTS
    vectors = vectors.where(F.size("_v") == sizes.n)
    first = [r._v for r in vectors.orderBy(F.asc_nulls_last("_key"), "_v").limit(ENTRIES).collect()]
    books = np.array(first, np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.slice("_v", i * width + 1, width))).alias("pos", "part")
    parts = vectors.select("_key", "_label", "_row", cut)
    distinct = stored(parts.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("m")), folder, "distinct")
    for _ in range(rounds):
        books = step(distinct, books)

    schema = pa.schema([("pos", pa.int32()), ("part", pa.list_(pa.int32())), ("m", pa.int64()), ("entry", pa.int64()), ("error", pa.int64())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, x = _parts_of(batch, width)
            entry, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p in np.unique(pos).tolist():
                entry[pos == p], error[pos == p] = nearest(x[pos == p], books[p])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part").cast(pa.list_(pa.int32())), batch.column("m"), pa.array(entry), pa.array(error)], schema=schema)

    coded = stored(distinct.mapInArrow(codes, "pos int, part array<int>, m long, entry long, error long"), folder, "codes")
    joined = join_keyed(parts, coded, ["pos", "part"], PARTS * vectors.count())
    # eight codes of two digits are one long
    digits = lambda half: F.sum(F.when(F.floor(F.col("pos") / 8) == half, F.expr("shiftleft(entry, 8 * (7 - pos % 8))")).otherwise(0))
    whole_ = joined.groupBy("_row", "_key", "_label").agg(digits(0).alias("high"), digits(1).alias("low"), F.sum("error").alias("error"))
    code = F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("high", "low")]))
    whole_ = stored(whole_.select("_key", F.col("_label").isNull().alias("_none"), F.coalesce("_label", F.lit("")).alias("_label"), code.alias("code"), "error"), folder, "whole")
    labels = stored(whole_.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("m")), folder, "labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = join_keyed(whole_, labels, ["_none", "_label"], vectors.count())
    return found.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
