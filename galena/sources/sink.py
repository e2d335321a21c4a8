"""A sink of observations by day, service and signal: partitions are replaced whole, by versions of a manifest.

    path/data/day=D/service=S/signal=G/made=V/part-*   rows of one partition as version V wrote them, sorted
    path/manifest/v=N/parts                            (day, service, signal, made): the folders that version N consists of
    path/manifest/v=N/state                            one row: last micro-batch, first day kept, rows refused as too old

A write reads the partitions that it touches, adds its rows, keeps the newest revision of each id and writes these partitions into
folders of their own; then one rename makes the version, which fails if another writer was first.  Until then no reader sees
anything, and what a lost job leaves is in no manifest.  Lists of partitions stay tables; only the state comes to the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

DAY_US = 86_400_000_000
PARTS = ["day", "service", "signal"]
PART_SCHEMA = "day long, service string, signal string, made string"


class SinkConflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class SinkState:
    batch: int = -1
    keep_from: int = -(1 << 40)
    refused: int = 0


STATE_SCHEMA = "batch long, keep_from long, refused long"


class PartitionedSink:
    """The sink below ``path`` of rows with ``schema``, which has service, signal, us, id and revision."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def _hadoop(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def version(self) -> int:
        where = self._hadoop(f"{self.path}/manifest/v=*")
        found = where.getFileSystem(self._conf()).globStatus(where) or []
        return max((int(x.getPath().getName()[2:]) for x in found), default=0)

    def state(self, version: int | None = None) -> SinkState:
        version = self.version() if version is None else version
        return SinkState(**self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/manifest/v={version:08d}/state").first().asDict()) if version else SinkState()

    def parts(self, version: int | None = None) -> DataFrame:
        """(day, service, signal, made) of the partitions of a version."""
        version = self.version() if version is None else version
        return self.spark.read.schema(PART_SCHEMA).parquet(f"{self.path}/manifest/v={version:08d}/parts") if version else self.spark.createDataFrame([], PART_SCHEMA)

    def _commit(self, version: int, parts: DataFrame, state: SinkState) -> int:
        aside, name = f"{self.path}/manifest/_{uuid.uuid4().hex}", f"{self.path}/manifest/v={version:08d}"
        parts.write.parquet(f"{aside}/parts")
        self.spark.createDataFrame([asdict(state)], STATE_SCHEMA).coalesce(1).write.parquet(f"{aside}/state")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._hadoop(aside).toUri(), self._conf())
        try:
            files.rename(self._hadoop(aside), self._hadoop(name), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            files.delete(self._hadoop(aside), True)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise SinkConflict(name) from None
            raise
        return version

    def _data(self) -> DataFrame:
        kinds = StructType([*self.schema.fields, *(f for f in self.spark.createDataFrame([], PART_SCHEMA).schema if f.name not in self.schema.names)])
        return self.spark.read.schema(kinds).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")

    def read(self, partitions: Column | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version with their day; ``partitions``, a condition on day, service and signal, chooses folders before any is opened."""
        if not self.version():
            return self.spark.createDataFrame([], StructType([*self.schema.fields])).withColumn("day", F.lit(0).cast("long"))
        rows, parts = self._data(), self.parts(version)
        if partitions is not None:
            rows, parts = rows.where(partitions), parts.where(partitions)
        return rows.join(parts, [*PARTS, "made"], "left_semi").select(*self.schema.names, "day")

    def write(self, rows: DataFrame, batch: int | None = None) -> int:
        """Add rows and return the version.  A ``batch`` that the sink has is a redelivery and changes nothing.

        Of rows with one id the one of the largest revision stays, of equal ones the last by their content; rows of days before the first one kept are
        refused and counted; rows without service, signal, us or id are refused too.
        """
        version = self.version()
        state = self.state(version)
        if batch is not None and batch <= state.batch:
            return version
        made = f"{version + 1:08d}-{uuid.uuid4().hex[:8]}"
        own = [f.name for f in self.schema.fields]
        new = rows.select(own).withColumn("day", F.floor(F.col("us") / DAY_US).cast("long"))
        good = new.where("service IS NOT NULL AND signal IS NOT NULL AND us IS NOT NULL AND id IS NOT NULL").where(F.col("day") >= state.keep_from)
        touched = good.select(*PARTS).distinct()
        now = good.select(*own, "day")
        if version:
            now = now.unionByName(self.read(version=version).join(touched, PARTS, "left_semi").select(*own, "day"))
        others = [c for c in own if c not in ("id", "revision")]
        newest = F.row_number().over(Window.partitionBy(*PARTS, "id").orderBy(F.desc("revision"), *(F.desc(c) for c in others)))
        now = now.withColumn("newest_", newest).where("newest_ = 1").drop("newest_").withColumn("made", F.lit(made))
        # a partition is dealt by time to as many tasks as Spark finds right, and sorted inside
        now = now.repartitionByRange(*PARTS, "us", "id").sortWithinPartitions(*PARTS, "us", "id")
        now.write.mode("append").partitionBy(*PARTS, "made").option("compression", "zstd").parquet(f"{self.path}/data")
        parts = self.parts(version).join(touched, PARTS, "left_anti").unionByName(touched.withColumn("made", F.lit(made)))
        refused = new.count() - good.count()
        return self._commit(version + 1, parts, replace(state, batch=state.batch if batch is None else batch, refused=state.refused + refused))

    def expire(self, keep_from: int) -> int:
        """Drop the partitions of days before ``keep_from`` for good, whole; a redelivery of their rows is refused.  Folders go after the version is made."""
        version = self.version()
        state = self.state(version)
        version = self._commit(version + 1, self.parts(version).where(F.col("day") >= keep_from), replace(state, keep_from=max(keep_from, state.keep_from)))
        self.clean(days_before=keep_from)
        return version

    def clean(self, days_before: int | None = None) -> None:
        """Delete the folders of days before ``days_before``, and those that the newest version does not have.

        Readers of older versions and other writers must be done.  Names of folders to delete come to the driver one by one.
        """
        days = self._hadoop(f"{self.path}/data/day=*")
        fs = days.getFileSystem(self._conf())
        for day in fs.globStatus(days) or []:
            if days_before is not None and int(day.getPath().getName()[4:]) < days_before:
                fs.delete(day.getPath(), True)
        if self.version() and fs.globStatus(days):
            rows = self._data()
            files = rows.select(*PARTS, "made", rows.metadataColumn("_metadata").getField("file_path").alias("file")).distinct()
            stale = files.join(self.parts(), [*PARTS, "made"], "left_anti").select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct()
            for row in stale.toLocalIterator():
                fs.delete(self._hadoop(self.spark._jvm.java.net.URI(row.folder)), True)


def partitioned_sink(stream: DataFrame, sink: PartitionedSink, checkpoint: str) -> StreamingQuery:
    """Write a stream to ``sink``, a version for each micro-batch, until the input is used up; a micro-batch that is delivered again changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, number: sink.write(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
