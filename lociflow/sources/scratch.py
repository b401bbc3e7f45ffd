"""Intermediate tables in the folder that all executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is sent to every executor.
BROADCAST_BYTES = 64 << 20


class Scratch:
    """A new folder below ``spark.checkpoint.dir``; a local master without that setting gets a temporary one."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='lociflow-')}"
            spark.sparkContext.setCheckpointDir(base)
        self.spark, self.path = spark, f"{base.rstrip('/')}/lociflow-{uuid.uuid4().hex}"
        self.latest: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, by: Sequence[str] = (), codec: str | None = None) -> DataFrame:
        """``df`` written and read back, so that later jobs start from files; in a folder for each value of ``by``."""
        at = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        writer = df.write.partitionBy(*by) if by else df.write
        (writer.option("compression", codec) if codec else writer).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def renew(self, df: DataFrame, name: str) -> DataFrame:
        """As ``keep``; the table that was renewed before under that name is deleted afterwards."""
        at = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(at)
        if name in self.latest:
            self._delete(self.latest[name])
        self.latest[name] = at
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        """Deletes the folder; nothing that was read from it can be used afterwards."""
        self._delete(self.path)

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(kept: DataFrame, width: int) -> DataFrame:
    """A stored table of rows of about ``width`` bytes, marked for broadcast where all of them are within the bound."""
    return F.broadcast(kept) if kept.count() * width <= BROADCAST_BYTES else kept


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equality join in which nulls are equal; the keys are taken from the left."""
    names = {c: f"_right_{c}" for c in keys}
    right = right.withColumnsRenamed(names)
    on = F.lit(True)
    for c, r in names.items():
        on = on & left[c].eqNullSafe(right[r])
    return left.join(right, on, how).drop(*names.values()) if keys else left.crossJoin(F.broadcast(right))  # one row without keys


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int):
    """While it lasts, tasks exchange so many rows at a time with Python: for rows that are long."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_dropped(spark: SparkSession):
    """While it lasts, shuffled files go when the query that made them ends, not when the driver collects its garbage: for loops."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
