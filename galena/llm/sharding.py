"""Sharding by size-tiered compaction, with a versioned manifest.

Arrivals are appended as small immutable shards (Parquet files).  Compaction puts shards in
tiers by size, joins the shards of a tier in order of arrival into runs of about the target
size, and writes each run as one new shard; nothing is changed in place.  A version of the
table is a manifest, a small table of the shards that belong to it.  It is written aside and
becomes the next version by a rename that fails where that version exists, so readers see the
old version or the new one whole, of two writers one wins, and a job that is lost
half-way leaves no version and nothing that blocks the next try.

The driver holds what any file index holds: the names of the shards of one version, at the
target size about one for ``TARGET_BYTES`` of data.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from .storage import cut, fresh_path

TARGET_BYTES = 32 << 20
TIER_FACTOR = 4
MIN_RUN = 2


class CommitConflict(RuntimeError):
    """Another writer has committed the version first; open the table again and repeat."""


class ShardedTable:
    """A table of immutable shards below ``path``, opened at its newest version (0: nothing was appended yet).

    All rows are kept as they are, repeated ones and nulls too, under any column names.
    Appends must have the columns of the first one; an append of no rows is a version without new shards.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = max(self.versions(), default=0)

    def _hadoop(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def versions(self) -> list[int]:
        """The numbers of all versions."""
        where = self._hadoop(f"{self.path}/manifest")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def _commit(self, shards: DataFrame, schema: StructType) -> int:
        """Make ``shards`` the next version, or raise CommitConflict where it exists."""
        aside, name = f"{self.path}/manifest/_{uuid.uuid4().hex}", f"{self.path}/manifest/v{self.version + 1:08d}"
        shards.select("shard", "bytes", "rows", "since").coalesce(1).write.parquet(f"{aside}/shards")
        self.spark.createDataFrame([(schema.json(),)], "columns string").coalesce(1).write.text(f"{aside}/columns")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._hadoop(aside).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(self._hadoop(aside), self._hadoop(name), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            files.delete(self._hadoop(aside), True)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise CommitConflict(name) from None
            raise
        self.version += 1
        return self.version

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/manifest/v{self.version:08d}/columns").first()[0]))

    def _listed(self, where: str, schema: StructType) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(where)
        file = rows.metadataColumn("_metadata")
        shard = rows.select(file.getField("file_path").alias("shard"), file.getField("file_size").alias("bytes"))
        return shard.groupBy("shard", "bytes").agg(F.count("*").alias("rows")).withColumn("since", F.lit(self.version + 1))

    def append(self, rows: DataFrame, arrival: Column | None = None) -> int:
        """Add ``rows`` as new shards, one at least for each value of ``arrival``; returns the version."""
        if self.version and [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in self.schema()]:
            raise ValueError("the columns are not those of the table")
        schema = StructType.fromJson(rows.schema.jsonValue())
        where, by = f"{self.path}/data/a{self.version + 1:08d}-{uuid.uuid4().hex}", unused("arrival", rows)
        if arrival is not None:
            rows = rows.withColumn(by, arrival)
        writer = rows.write.option("compression", "zstd")
        (writer if arrival is None else writer.partitionBy(by)).parquet(where)
        new = self._listed(where, schema)
        return self._commit(self.shards().unionByName(new) if self.version else new, schema)

    def plan(self, target: int = TARGET_BYTES, factor: int = TIER_FACTOR, least: int = MIN_RUN) -> DataFrame:
        """The shards of this version with their tier and, where a run of ``least`` or more is to be joined, its number."""
        tier = F.greatest(F.lit(0), F.floor(F.log(float(factor), F.greatest(F.col("bytes"), F.lit(1)) / (target / factor**4)))).cast("int")
        shards = self.shards().withColumn("tier", F.when(F.col("bytes") >= target, -1).otherwise(tier))
        # windows over a row for each shard, whatever its rows
        by = Window.partitionBy("tier").orderBy("since", "shard").rowsBetween(Window.unboundedPreceding, -1)
        shards = shards.withColumn("piece", F.floor(F.coalesce(F.sum("bytes").over(by), F.lit(0)) / target))
        joined = (F.col("tier") >= 0) & (F.count("*").over(Window.partitionBy("tier", "piece")) >= least)
        shards = shards.withColumn("joined", joined)
        run = F.dense_rank().over(Window.partitionBy("joined").orderBy("tier", "piece")) - 1
        return shards.withColumn("run", F.when(F.col("joined"), run)).drop("piece", "joined")

    def compact(self, **settings) -> int:
        """One round: join the planned runs, commit the manifest of what is left and what is new; a version without runs stays."""
        plan = cut(self.plan(**settings))
        merge = plan.where("run IS NOT NULL").select("shard", "run")
        files, runs = [r[0] for r in merge.select("shard").collect()], merge.agg(F.max("run")).first()[0]
        if runs is None:
            return self.version
        schema = self.schema()
        where = f"{self.path}/data/c{self.version + 1:08d}-{uuid.uuid4().hex}"
        rows = self.spark.read.schema(schema).parquet(*files)
        by, of = unused("run", rows), unused("shard", rows)
        rows = rows.withColumn(of, rows.metadataColumn("_metadata").getField("file_path"))
        rows = rows.join(merge.select(F.col("shard").alias(of), F.col("run").alias(by)), of).drop(of)
        # each run is one task and one shard
        rows.repartitionById(runs + 1, F.col(by)).write.option("compression", "zstd").partitionBy(by).parquet(where)
        return self._commit(plan.where("run IS NULL").select("shard", "bytes", "rows", "since").unionByName(self._listed(where, schema)), schema)

    def shards(self, version: int | None = None) -> DataFrame:
        """(shard, bytes, rows, since) of a version (the one that is open)."""
        return self.spark.read.parquet(f"{self.path}/manifest/v{version or self.version:08d}/shards")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the one that is open)."""
        files = [r[0] for r in self.shards(version).select("shard").collect()]
        return self.spark.read.schema(self.schema()).parquet(*files) if files else self.spark.createDataFrame([], self.schema())


def unused(name: str, rows: DataFrame) -> str:
    """A column name like ``name`` that ``rows`` does not have, in either case."""
    taken = {c.lower() for c in rows.columns}
    return reduce(lambda n, _: n if n.lower() not in taken else n + "_", range(len(taken) + 1), f"_{name}")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, arriving in eight parts by a hash, appended, compacted, and read back from the last version.

    A row for each document: doc_id, n_chars counted from the text as stored (null: 0), and listed, whether the
    manifest names the shard that holds the row.  Rows are kept as they are, also
    repeated ones and nulls; a null doc_id is in the first arrival.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = ShardedTable(spark, fresh_path(spark, "shards"))
    table.append(docs, F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(8)), F.lit(0)).cast("int"))
    table.compact()
    rows = table.read()
    rows = rows.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), rows.metadataColumn("_metadata").getField("file_path").alias("shard"))
    named = table.shards().select("shard", F.lit(True).alias("found"))
    return rows.join(named, "shard", "left").select("doc_id", "n_chars", F.coalesce("found", F.lit(False)).alias("listed"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLES = {"op6_sharding": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, true AS listed FROM documents"}
