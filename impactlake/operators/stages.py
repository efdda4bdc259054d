"""Tables written to the folder that all executors share, so that nothing is computed twice and little is lost with an executor."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_dir: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of this process; any other is an error.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="impactlake-"))
        base = _own_dir[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what has been computed is not computed again, and a lost
    executor costs only what it was computing.  Columns, order of columns and types
    are those of ``df``; an empty frame stays an empty frame.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more; of other tables none."""
    for df in staged:
        path = _paths.pop(df, None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
