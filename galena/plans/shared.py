"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path that no other run uses in ``spark.checkpoint.dir``; without that setting a temporary folder, if the master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        named = tempfile.mkdtemp(prefix="galena-shared-")
    return f"{named.rstrip('/')}/galena-{what}-{uuid.uuid4().hex}"


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
