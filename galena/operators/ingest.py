"""Admission of telemetry: which points, envelopes and names are let in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def normalised_key(key: Column) -> Column:
    """A name as the leak guard compares it: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def leaks(attributes: Column, forbidden: list[str]) -> Column:
    """Whether a map has a key that is forbidden, however it is spelt; a null map has none."""
    return F.coalesce(F.exists(F.map_keys(attributes), lambda k: normalised_key(k).isin(forbidden)), F.lit(False))


def split_envelopes(points: DataFrame, envelope: list[str], reason: Column, payload: str) -> tuple[DataFrame, DataFrame]:
    """(accepted points, dead letters): one bad point rejects its whole envelope.

    ``reason`` is null for a good point.  A dead letter names the envelope, the first reason in alphabetical order, how many points it held
    and the SHA-256 of its payloads in order.
    """
    by = Window.partitionBy(*envelope)
    judged = points.withColumn("reason_", reason).withColumn("bad_", F.max(F.col("reason_").isNotNull()).over(by))
    dead = judged.where("bad_").groupBy(*envelope).agg(F.min("reason_").alias("reason"), F.count("*").alias("points"), F.sha2(F.array_join(F.array_sort(F.collect_list(payload)), "\n"), 256).alias("payload_sha256"))
    return judged.where("NOT bad_").drop("reason_", "bad_"), dead


def server_spans(spans: DataFrame, services: DataFrame, kinds: tuple[str, ...] = ("2",)) -> DataFrame:
    """Spans of a server kind (a number or its text) whose service is mapped, with the logical name; ``services`` is (source_name, service)."""
    return spans.where(F.col("kind").cast("string").isin(*kinds)).join(services, "source_name").drop("source_name")


def container_gauges(points: DataFrame, namespace: str, unit: str = "By") -> DataFrame:
    """Gauges of containers in one namespace, in one unit, whose pod is known; ``points`` has signal_kind, unit and the map attributes."""
    a = lambda k: F.col("attributes")[k]
    return points.where((F.col("signal_kind") == "gauge") & (F.col("unit") == unit) & (a("namespace") == namespace) & a("container").isNotNull() & (F.coalesce(a("pod_uid"), F.lit("")) != ""))


def of_user_agent(agent: Column, root: str) -> Column:
    """Whether an agent is ``root`` or a part of it, root + '/...'."""
    return (agent == root) | agent.startswith(root + "/")


def unit_checked(points: DataFrame, key: list[str]) -> DataFrame:
    """Count and mean of each window, unless its points differ in unit: then an error status and no value."""
    one = F.count_distinct("unit") <= 1
    return points.groupBy(*key).agg(F.count("*").alias("n"), F.when(one, F.round(F.avg("value"), 6)).alias("mean"), F.when(one, "ok").otherwise("mixed units").alias("status"))


def counters(rows: DataFrame, width: int, lateness: int) -> DataFrame:
    """(key, batch, rows, accepted, duplicate, late, closed) of rows (key, id, us, batch, place) as they came in, by batch and then place.

    A row whose id its key has had before is a duplicate.  The watermark of a key is ``lateness`` behind the newest row of its
    earlier batches; another row is late if its tick of ``width`` was over by then, else accepted.  closed: how many ticks, from the
    key's first one on, the batch's own rows closed.  Of an id only its first place and of a batch only its edges are put in order.
    """
    tick = lambda at: F.floor(at / width)
    edges = rows.groupBy("key", "batch").agg(F.max("us").alias("newest"), F.min("us").alias("oldest"))
    order = Window.partitionBy("key").orderBy("batch")
    before = F.max("newest").over(order.rowsBetween(Window.unboundedPreceding, -1)) - lateness
    after = F.max("newest").over(order.rowsBetween(Window.unboundedPreceding, 0)) - lateness
    start = F.first(tick(F.col("oldest"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marks = edges.select("key", "batch", tick(before).alias("open_from"), F.greatest(tick(after), start).alias("end"), F.greatest(tick(before), start).alias("begin"))
    # rows of one id are first counted in their batch, so that an id that comes all the time is one row for each batch
    of_batch = rows.groupBy("key", "id", "batch").agg(F.count("*").alias("n"), F.min(F.struct("place", "us"))["us"].alias("us"))
    of_id = Window.partitionBy("key", "id").orderBy("batch")
    told = of_batch.withColumn("new", F.row_number().over(of_id) == 1).join(marks, ["key", "batch"])
    late = F.col("new") & F.coalesce(tick(F.col("us")) < F.col("open_from"), F.lit(False))
    got = told.groupBy("key", "batch", (F.col("end") - F.col("begin")).alias("closed")).agg(F.sum("n").alias("rows"), F.count_if(F.col("new") & ~late).alias("accepted"), F.sum(F.col("n") - F.col("new").cast("int")).alias("duplicate"), F.count_if(late).alias("late"))
    return got.select("key", "batch", "rows", "accepted", "duplicate", "late", "closed")
