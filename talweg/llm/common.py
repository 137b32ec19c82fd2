"""Storage and small frame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session of one machine (``local[...]``, as in tests)
    gets a temporary folder; a cluster, whose executors couldn't read it, raises.
    """
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "talweg")
        context.setCheckpointDir(at)
    return at.rstrip("/")


#: Rows that go to a Python worker at a time, unless the session says otherwise: whole texts make large batches.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep what JVM and Python workers hold of a task's rows small where the session has Spark's default of 10,000 rows."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers live on after a task and would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` whose workers give their memory back after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    run.__name__ = function.__name__  # plans show it
    return df.mapInArrow(run, schema)


#: Spark's setting that ends a write's shuffles with it, and where each written table lies.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    ``more`` are further parts of the table, of the same columns: each is written
    once the one before it has ended, so that one part's shuffle files lie on disk at a time.
    A lost executor costs nothing that was written. The write's shuffle files go
    as soon as it ends, as does what the driver holds of them: otherwise both stay
    until the driver's next garbage collection. Drop the folder
    ``<spark.checkpoint.dir>/talweg-tables`` once results are stored.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/talweg-tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, once whatever reads them is written itself."""
    for df in tables:
        if path := _paths.pop(df, None):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
