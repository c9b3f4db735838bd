"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while an intermediate table is made: rows may hold whole sets or texts, and both sides keep a batch in memory.
BATCH_ROWS = 1000
#: Bytes of a row group of an intermediate table: the writer keeps one in memory.
ROW_GROUP = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder of our own in local mode (tests), else an error: executors don't share such folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within exchange Arrow batches of BATCH_ROWS rows."""
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, usual)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.clear()


def give_back() -> None:
    """Returns freed memory of this process to the system: the C library keeps blocks below its threshold, which rises to 32 MB as arrays are freed."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(work: Callable, vocabularies: bool = False) -> Callable:
    """A function of Arrow batches for workers that serve stage after stage: vocabularies that earlier stages left in the worker go first, unless it uses them itself, and freed memory goes back when its rows end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not vocabularies and (known := sys.modules.get("quillon.llm.byte_bpe")):
            known.encoder.cache_clear()
            known.byte_lengths.cache_clear()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def lean_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of one group: what the last one freed goes back before the next begins."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        return work(table)

    return run


def lean_cogroup(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        return work(left, right)

    return run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
