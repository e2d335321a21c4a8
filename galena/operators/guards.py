"""What may count as evidence, and whether the platform may act: outcomes of calls, paths of requests, the breaker of automatic actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import intervals


def status_code(value: Column) -> Column:
    """A code of 0 to 255 from a string of decimal digits, else null."""
    return F.when(value.rlike("^[0-9]{1,9}$"), F.when(value.cast("int") <= 255, value.cast("int")))


def rpc_outcome(kind: Column, traces: Column, latency: Column, rpc_status: Column, span_status: Column) -> Column:
    """'failed' or 'ok' of a client's call, null where it says neither.

    A client's span (kind 3) with one trace, a latency of at least 0 and a status of the call counts.  A span that says ok (1) of a failed
    call, or error (2) of one that did not fail, contradicts itself; without a status of its own it says nothing, with one that is no code as well.
    """
    call, span = status_code(rpc_status), status_code(span_status)
    known = (kind == "3") & (traces == 1) & (latency >= 0) & call.isNotNull()
    failed = call != 0
    torn = F.coalesce((span == 1) & failed | (span == 2) & ~failed, F.lit(False))
    return F.when(known & ~torn, F.when(failed, "failed").otherwise("ok"))


def http_path(url: Column) -> Column:
    """The path of an absolute http(s) URL, null unless it is one without user, fragment and outer white space, with a host, a port of 1 to 65535 if any, and a path."""
    part = lambda i: F.regexp_extract(url, r"(?is)^https?://([^/?#]*)(/[^?#]*)(?:\?[^#]*)?(#.*)?$", i)
    host = F.regexp_extract(part(1), r"^(\[[^\]]*\]|[^:@\[\]]+)(?::([0-9]*))?$", 1)
    port = F.regexp_extract(part(1), r"^(\[[^\]]*\]|[^:@\[\]]+)(?::([0-9]*))?$", 2)
    right_port = (port == "") | F.coalesce((port.try_cast("bigint") >= 1) & (port.try_cast("bigint") <= 65_535), F.lit(False))
    return F.when((host != "") & right_port & (F.length(part(3)) <= 1) & url.rlike(r"(?s)^\S(.*\S)?$"), F.nullif(part(2), F.lit("")))


def breaker(asked: DataFrame, actions: DataFrame, window_us: int, most: int = 5, streak: int = 3, least: float = 0.05) -> DataFrame:
    """(ask_id, recent, tripped, service) for each of ``asked`` (ask_id, at), one row for each id: may the platform act?

    ``actions`` is (id, us, service, improvement).  Recent are those after at - ``window_us``, up to at.  RATE: there are ``most`` or more.  INEFFECTIVE: of some
    service the last ``streak`` recent actions whose improvement is known all improved by less than ``least``; the first such service by name is given.
    Running counts and streaks over each bucket's sorted actions answer, so that the work grows with rows, not with the actions that are recent at each.
    """
    spans = actions.select("id", "us", (F.col("us") + window_us).alias("until"), F.col("service").alias("of"), "improvement")
    near = intervals.dealt(spans, "us", "until", window_us)
    probes = asked.select("ask_id", "at", F.floor(F.col("at") / window_us).alias("bucket_"))
    counts = intervals.in_force(asked.select("ask_id", "at"), spans.where("id IS NOT NULL").select(F.col("us").alias("start"), F.col("until").alias("end")), "at", window_us).withColumnRenamed("n", "recent")

    # an action ends a weak streak until its first action is no longer recent, or the service's next known action comes
    known = near.where("improvement IS NOT NULL AND of IS NOT NULL")
    last = Window.partitionBy("bucket_", "of").orderBy("us", "id").rowsBetween(1 - streak, 0)
    is_weak = (F.count("*").over(last) == streak) & (F.max("improvement").over(last) < least)
    ends = known.withColumn("weak_until", F.when(is_weak, F.min("us").over(last) + window_us).otherwise(F.col("us")))
    offered = ends.where("weak_until > us").select("bucket_", "of").distinct()
    rows = ends.select("bucket_", "of", F.col("us").alias("t"), F.lit(0).alias("asks"), "id", "weak_until", F.lit(None).cast(asked.schema["ask_id"].dataType).alias("ask_id"))
    rows = rows.unionByName(probes.join(offered, "bucket_").select("bucket_", "of", F.col("at").alias("t"), F.lit(1).alias("asks"), "ask_id"), allowMissingColumns=True)
    so_far = Window.partitionBy("bucket_", "of").orderBy("t", "asks", "id").rowsBetween(Window.unboundedPreceding, 0)
    weak = rows.withColumn("weak_until", F.last("weak_until", True).over(so_far)).where("asks = 1 AND weak_until > t").groupBy("ask_id").agg(F.min("of").alias("service"))
    rate = F.col("recent") >= most
    out = counts.join(weak, "ask_id", "left")
    return out.select("ask_id", "recent", F.when(rate, "RATE").when(F.col("service").isNotNull(), "INEFFECTIVE").alias("tripped"), F.when(~rate, F.col("service")).alias("service"))
