"""Scratch tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs a re-read and never a wrong result.
A table that nothing reads any more is dropped, and so are the shuffle files of
the job that wrote a table: what follows reads the table.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, as in tests, one of our own, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local["):
            base = "file://" + tempfile.mkdtemp(prefix="orrery-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"
    at, files = hadoop_path(spark, path)
    files.deleteOnExit(at)
    return path


def hadoop_path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs that begin here drop their shuffle files as they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    return Scratch(df.sparkSession).put(name, df, **options)


class Scratch:
    """The scratch tables of one operator, by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        self.paths[name] = path = scratch_path(self.spark, name)
        with shuffle_files_dropped(self.spark):
            df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """For tables that nothing reads any more; what was made of them must have been written."""
        for name in names:
            at, files = hadoop_path(self.spark, self.paths.pop(name))
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


def released() -> None:
    """Give free memory back to the system: a Python worker lives on beside others, and beside the JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; before and after it the worker gives back what earlier tasks and its own left."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        yield from run(batches)
        released()

    return held


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: what a batch becomes is held by the worker and the JVM at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: never broadcast."""
    return df.hint("merge")
