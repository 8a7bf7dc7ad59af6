"""Durable intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a recomputation, and the
re-read carries exact sizes for the optimizer.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch where a worker keeps little beside it.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for local masters without a setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches hold BATCH_BYTES at most, or one row, in what runs within: 10,000 whole texts are held by the executor and by its worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Gives memory that a worker freed back to the system; workers are used again by later steps, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Tables of one operator run; ``drop`` frees those that later steps don't read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def keep_only(self, *tables: DataFrame) -> None:
        """Frees all tables but these, which the result still reads; they stay until the folder is cleared."""
        for table, path in self.tables:
            if not any(table is t for t in tables):
                self._delete(path)
        self.tables = [(t, path) for t, path in self.tables if any(t is x for x in tables)]

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self.tables:
            if any(table is t for t in tables):
                self._delete(path)
        self.tables = [(t, path) for t, path in self.tables if not any(t is x for x in tables)]

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
