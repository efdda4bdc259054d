"""What a session needs before queries run on its executors."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()
#: Tables made of few rows or stored with few bytes are far larger than Spark estimates, so a join is
#: planned without sending one side through the driver, unless what was shuffled is known to be small.
MEASURED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}
#: What a task reads of a shuffle: rows of keys take some thirty times that in memory when they are sorted or counted.
MEASURED["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = "8m"
#: The JVM never compiles a method beyond this size, so larger ones are cut into smaller ones, which it does.
MEASURED["spark.sql.codegen.hugeMethodLimit"] = "8000"
#: What a Python worker is given at once; rows hold lists, so their number says little.
MEASURED["spark.sql.execution.arrow.maxBytesPerBatch"] = str(8 << 20)
#: A shuffle is dealt in a part for each so many bytes of the tables, and small parts are read together.
PARTS_OF = 4 << 20
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_before: weakref.WeakKeyDictionary[SparkSession, dict[str, str | None]] = weakref.WeakKeyDictionary()


def stored_bytes(spark: SparkSession, folder: str) -> int:
    """How many bytes the tables of a folder are stored in; 0 where the folder cannot be listed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(where).getLength()
    except Py4JJavaError:
        return 0


def measured_joins(spark: SparkSession, wanted: bool = True, folder: str | None = None) -> None:
    """Let joins of this session go by sizes that were measured, or, where not ``wanted``, by its own settings again.

    Shuffles have parts in proportion to the tables in ``folder``, so that what a task holds does not grow with them.
    A frame is planned when it runs, so the setting stays until a query asks for the other.
    """
    if wanted and spark not in _before:
        _before[spark] = {key: spark.conf.get(key, None) for key in (*MEASURED, INITIAL)}
    given = dict(MEASURED)
    if wanted and folder is not None:
        given[INITIAL] = str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(spark, folder) // PARTS_OF)))
    for key, value in (given if wanted else _before.pop(spark, {})).items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context.

    Functions that run in Python workers are pickled by reference, so workers must be
    able to import them wherever the driver was started.
    """
    context = spark.sparkContext
    if context in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="impactlake-"), "impactlake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(target)
    _shipped.add(context)
