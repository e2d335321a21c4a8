"""Behavioural ratios: how far each has left its baseline in the bad direction, and what that makes of a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.sized import small

RULE = "metric string, falls boolean, floor double, trigger double, full double"


def deformed(measures: DataFrame, rules: DataFrame, least_rows: int = 6) -> DataFrame:
    """(stream, metric, tick, status, deformation, score) of each window (stream, metric, tick, value, n, ambiguous).

    A window that is ambiguous, has fewer than ``least_rows`` rows or no value is INSUFFICIENT, and says nothing.  The first
    other window of a stream and metric is its baseline (WARMING).  Later ones deform by the change in the bad direction
    (a fall where ``falls``) over max(baseline, floor); from ``trigger`` on this is a BREACH that scores deformation / full,
    1 at most.  Windows of a metric without a rule are left out.
    """
    usable = ~F.coalesce("ambiguous", F.lit(False)) & (F.col("n") >= least_rows) & F.col("value").isNotNull()
    rows = measures.join(small(rules), "metric").withColumn("usable", usable)
    first = rows.where("usable").groupBy("stream", "metric").agg(F.min("tick").alias("first_tick"), F.min_by("value", "tick").alias("base"))
    change = F.when(F.col("falls"), F.col("base") - F.col("value")).otherwise(F.col("value") - F.col("base"))
    got = rows.join(first, ["stream", "metric"], "left").withColumn("deformation", F.when(F.col("usable"), F.greatest(change, F.lit(0.0)) / F.greatest("base", "floor")))
    breach = F.col("deformation") >= F.col("trigger")
    status = F.when(~F.col("usable"), "INSUFFICIENT").when(F.col("tick") == F.col("first_tick"), "WARMING").when(breach, "BREACH").otherwise("CLEAR")
    score = F.when(breach, F.least(F.lit(1.0), F.col("deformation") / F.col("full")))
    return got.select("stream", "metric", "tick", status.alias("status"), "deformation", score.alias("score"))
