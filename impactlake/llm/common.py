"""Session helpers that the operators share."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.stages import dropped, shared_dir, stage

__all__ = ["drop_table", "dropped", "frugal", "partitions", "read_table", "shared_dir", "stage", "tidy_shuffles"]
#: Spark's setting under which the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes that a Python worker gets at a time: rows hold texts or sets, so they are large.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of each finished query go at once, not when the driver collects garbage, and Python workers get small batches.

    It holds for frames made and run within; a frame that runs twice computes its shuffles twice.
    """
    wanted = {CLEANUP: "true"} | BATCHES
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def frugal(run):
    """A function on batches or tables that gives free memory back to the system when it is done, as workers outlive their tasks."""

    def on_batches(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    def on_table(table):
        try:
            return run(table)
        finally:
            _give_back()

    def on_tables(left, right):
        try:
            return run(left, right)
        finally:
            _give_back()

    if inspect.isgeneratorfunction(run):
        return on_batches
    return on_table if len(inspect.signature(run).parameters) == 1 else on_tables


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table of ours together with its files."""
    location = spark.sql(f"describe formatted {name}").filter("col_name = 'Location'").first()
    spark.sql(f"drop table if exists {name}")
    if location is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(location["data_type"])
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
