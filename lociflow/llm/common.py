"""What the operators share: readers, the word rule, the shared folder for intermediate tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts whose other letters do not change under lower() take the fast built-in path."""
    folded = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), folded).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``, as a URI that executors and driver all reach.

    Where the setting is absent, a local master (tests) gets a temporary folder; a cluster is refused, because its
    executors would not see one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        chosen = context._jsc.sc().getCheckpointDir()
        base = chosen.get() if chosen.isDefined() else None
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lociflow-')}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lociflow-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int) -> DataFrame:
    """A stored table marked for broadcast where it has at most ``rows`` rows; beyond that the join is a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows``, ``total`` in number, joined with ``keyed``, one stored row for each key with its number ``m`` of rows.

    Keys of more than a thousandth of the rows, fewer than 1,000, are broadcast, so that none gathers in one task.
    """
    frequent = F.broadcast(keyed.where(F.col("m") * 1000 > total).drop("m"))
    rest = rows.join(frequent.select(key), key, "left_anti").join(keyed.where(F.col("m") * 1000 <= total).drop("m"), key)
    return rows.join(frequent, key).unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes an intermediate table below a shared folder and reads it back: later jobs start from files, not lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def releasing(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``each`` for the batches of a task, after which freed memory goes back to the system: a Python worker stays for the next
    steps, and what it holds is missing in the executor."""

    def run(batches: Iterator) -> Iterator:
        yield from each(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, tasks exchange so many rows at a time with Python: texts are long, and both sides hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def make(spark: SparkSession, folder: str) -> None:
    """Creates a folder, if it is not there, through the file system that is to hold it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes an intermediate folder through the file system that holds it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
