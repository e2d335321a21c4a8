"""Raw messages (topic, partition, offset, value): the stream of topics, captures between two positions, replay, and the bus.

A capture is what topics held between two snapshots of their positions.  It is written with a manifest of sizes and SHA-256,
and read back against it.  Replay runs the readers of the stream over a capture.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.selection import best_of

RECORD = "topic string, partition int, offset long, value binary"
SOURCE = ["topic", "partition"]
PLACE = [*SOURCE, "offset"]
#: Offsets that one group of the gap check holds at most.
BLOCK = 4096


def topic_stream(spark: SparkSession, servers: str, topics: Sequence[str], fetch_bytes: int = 10 << 20, **options: str) -> DataFrame:
    """Records of Kafka topics from the earliest on; the query's checkpoint is the position, which moves on only after a micro-batch is written."""
    named = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", "kafka.max.partition.fetch.bytes": str(fetch_bytes)}
    return spark.readStream.format("kafka").options(**named | options).load().select(*PLACE, "value")


def folder_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same from a folder to which Parquet files of records are added."""
    return spark.readStream.schema(RECORD).parquet(path)


def bounds_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """(topic, partition, start_offset, end_offset, problem) of two snapshots (topic, partition, offset).

    ``problem`` is null, "partition changed" where only one snapshot has the partition, or "moved backwards".
    """
    start, end = (df.select(*SOURCE, F.col("offset").alias(name)) for df, name in ((before, "start_offset"), (after, "end_offset")))
    both = start.join(end, SOURCE, "full")
    one_sided = F.col("start_offset").isNull() | F.col("end_offset").isNull()
    return both.withColumn("problem", F.when(one_sided, "partition changed").when(F.col("end_offset") < F.col("start_offset"), "moved backwards"))


def within(records: DataFrame, bounds: DataFrame) -> DataFrame:
    """Records with start_offset <= offset < end_offset of their partition."""
    limits = bounds.where("problem IS NULL").select(*SOURCE, "start_offset", "end_offset")
    return records.join(limits, SOURCE).where("offset >= start_offset AND offset < end_offset").drop("start_offset", "end_offset")


def capture_gaps(records: DataFrame, bounds: DataFrame, block: int = BLOCK) -> DataFrame:
    """(topic, partition, first_offset, missing, first_missing, empty) of each block of offsets that isn't whole.

    Every offset within the bounds must be there, with a value; a repeated one counts once.  A group is one block, so a busy
    partition is spread over tasks.
    """
    of_block = F.floor(F.col("offset") / block)
    got = within(records, bounds).groupBy(*SOURCE, of_block.alias("block")).agg(F.collect_set("offset").alias("found"), F.count_if(F.col("value").isNull()).alias("empty"))
    span = bounds.where("problem IS NULL AND end_offset > start_offset")
    blocks = span.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_offset") / block), F.floor((F.col("end_offset") - 1) / block))))
    first, last = F.greatest("start_offset", F.col("block") * block), F.least(F.col("end_offset"), (F.col("block") + 1) * block) - 1
    asked = blocks.select(*SOURCE, "block", first.alias("first_offset"), last.alias("last_offset"))
    missing = F.array_except(F.sequence("first_offset", "last_offset"), F.coalesce("found", F.array().cast("array<long>")))
    told = asked.join(got, [*SOURCE, "block"], "left").withColumns({"lost": missing, "empty": F.coalesce("empty", F.lit(0))})
    return told.select(*SOURCE, "first_offset", F.size("lost").cast("long").alias("missing"), F.array_min("lost").alias("first_missing"), "empty").where("missing > 0 OR empty > 0")


def manifest(records: DataFrame) -> DataFrame:
    """(topic, partition, offset, size_bytes, sha256) of records."""
    return records.select(*PLACE, F.octet_length("value").cast("long").alias("size_bytes"), F.sha2("value", 256).alias("sha256"))


def checked(records: DataFrame, listed: DataFrame) -> DataFrame:
    """(topic, partition, offset, value, problem): records against a manifest; problem is null, "unlisted", "missing", "size" or "checksum"."""
    mine = records.select(*PLACE, "value", F.lit(True).alias("here"))
    both = mine.join(listed.select(*PLACE, "size_bytes", "sha256", F.lit(True).alias("there")), PLACE, "full")
    problem = (
        F.when(F.col("there").isNull(), "unlisted").when(F.col("here").isNull(), "missing")
        .when(~F.octet_length("value").eqNullSafe(F.col("size_bytes")), "size").when(~F.sha2("value", 256).eqNullSafe(F.col("sha256")), "checksum")
    )
    return both.select(*PLACE, "value", problem.alias("problem"))


def write_capture(records: DataFrame, bounds: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """Write records within bounds, the bounds and the manifest below ``path``, which must hold no capture yet; labels apart, below ``private``."""
    spark = records.sparkSession
    bounds.write.parquet(f"{path}/bounds")
    within(records, bounds).select(*PLACE, F.col("value").cast("binary").alias("value")).write.parquet(f"{path}/records")
    if labels is not None:
        labels.write.parquet(f"{path}/private/labels")
    manifest(spark.read.schema(RECORD).parquet(f"{path}/records")).write.parquet(f"{path}/manifest")


def load_capture(spark: SparkSession, path: str) -> DataFrame:
    """Records of a capture; reading the value of one that doesn't match the manifest, or is missing, fails.  Labels are not read."""
    got = checked(spark.read.schema(RECORD).parquet(f"{path}/records"), spark.read.parquet(f"{path}/manifest"))
    where = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return got.select(*PLACE, F.when(F.col("problem").isNull(), F.col("value")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("capture:"), "problem", where)).cast("binary")).alias("value"))


def replayed(records: DataFrame, read: Callable[..., DataFrame], root: str, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(observations, dead letters) of records through a reader of ``sources.otlp``.

    Of observations equal in ``identity`` the first by (topic, partition, offset) stays, whatever order records are read in.
    A record without the list ``root`` in its envelope is a dead letter (topic, partition, offset, sha256).
    """
    raw = records.select(*PLACE, "value", F.decode("value", "UTF-8").alias("payload"))
    readable = F.from_json("payload", f"{root} array<string>")[root].isNotNull()
    dead = raw.where(~F.coalesce(readable, F.lit(False))).select(*PLACE, F.sha2("value", 256).alias("sha256"))
    seen = best_of(read(raw, keep=PLACE), list(identity), [F.col(c) for c in PLACE])
    return seen.drop("rank"), dead


def bus_messages(observations: DataFrame) -> DataFrame:
    """(key, value) of each observation, as a Kafka sink takes them: rows of one service and signal share a key."""
    return observations.select(F.concat_ws("\x1f", "service", "signal").alias("key"), F.to_json(F.struct(*observations.columns)).alias("value"))


def bus_observations(messages: DataFrame, schema: str, needed: Sequence[str]) -> DataFrame:
    """(key, fields of ``schema``, decoded): messages read back; ``decoded`` is false where the text is no such JSON or a needed field is null."""
    read = messages.select("key", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("m"))
    good: Column = F.col("m").isNotNull() & F.col("m._corrupt").isNull()
    for field in needed:
        good = good & F.col(f"m.{field}").isNotNull()
    return read.withColumn("decoded", F.coalesce(good, F.lit(False))).select("key", "m.*", "decoded").drop("_corrupt")
