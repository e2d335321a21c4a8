"""Where intermediate tables of the llm operators live.

Lineage is cut only by written tables in the folder that the cluster names in
``spark.checkpoint.dir``.  Where that setting is absent and the master is ``local`` (unit
tests, a laptop) a temporary folder is used, as driver and executors are one process there;
on a cluster the setting must be given.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path without a trailing slash."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="galena-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df``, written once as a table in the shared folder and read from there from now on.

    A written table outlives lost executors, and unlike a checkpointed plan it has its true
    size: joins on it are broadcast only below the session's checked threshold.
    """
    path = fresh_path(df.sparkSession, "cut")
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.galena_path = path
    return back


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give their shuffle files back as they end, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release(df: DataFrame) -> None:
    """Delete the table behind ``cut()``'s result, which nothing still to be computed may read."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.galena_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/galena-{what}-{uuid.uuid4().hex}"
