"""The sink over the events: two arrivals, revised signups, and retention of the days from the 16th on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.shared import fresh_path
from .sink import DAY_US, PartitionedSink


def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("service"), F.concat(F.lit("seg"), F.col("user_id") % 3).alias("signal"), us.alias("us"), F.col("event_id").alias("id"), F.lit(1).cast("long").alias("revision"), "value")
    sink = PartitionedSink(spark, fresh_path(spark, "sink"), e.schema)
    sink.write(e.where("value <= 50"), 0)
    sink.write(e.where("value > 50").unionByName(e.where("service = 'signup'").withColumns({"revision": F.lit(2).cast("long"), "value": F.col("value") + 1})), 1)
    first = e.agg(F.min(F.floor(F.col("us") / DAY_US))).first()[0]
    sink.expire((first or 0) + 15)
    return sink.read().select("day", "service", "signal", "id", "revision", "us", F.round("value", 6).alias("value"))


QUERIES = {
    "sink_partitioned": (
        sink_partitioned,
        """SELECT CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, event_type AS service, 'seg' || (user_id % 3) AS signal, event_id AS id, CAST(CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS BIGINT) AS revision,
       epoch_us(ts) AS us, round(value + CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END, 6) AS value FROM events WHERE floor(epoch_us(ts) / 86400000000) >= (SELECT min(floor(epoch_us(ts) / 86400000000)) + 15 FROM events)""",
    )
}
