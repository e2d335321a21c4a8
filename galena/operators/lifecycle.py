"""Episode lifecycle: persistence, hysteresis, phases and transitions of scored streams, as windows over each stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.sized import small


def transitions(scored: DataFrame, policies: DataFrame) -> DataFrame:
    """What each tick does to the episode of its stream.

    ``scored`` is (stream, kind, tick, score, sufficient), one row for each tick of a stream; a null score is no symptom.
    ``policies`` is (kind, breach, clear, open_after, close_after, gap); streams of other kinds are ignored.  A score of at
    least ``breach`` breaches, none or one of at most ``clear`` clears, others hold.  An insufficient tick is left out where
    ``gap`` is 'skip', so that a run survives it, and holds where it is 'hold'.  Returns stream, tick, score, class, action
    and phase, and of the episode its number, opened, breaches, revision and peak (null where there is none).
    """
    order = Window.partitionBy("stream").orderBy("tick")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = scored.join(small(policies), "kind").where("sufficient OR gap = 'hold'")
    kind = F.when(~F.col("sufficient"), "H").when(F.col("score") >= F.col("breach"), "B").when(F.col("score").isNull() | (F.col("score") <= F.col("clear")), "C").otherwise("H")
    rows = rows.withColumn("class", kind)
    rows = rows.withColumn("grp", F.sum(F.when(F.lag("class").over(order) == F.col("class"), 0).otherwise(1)).over(sofar))
    same = Window.partitionBy("stream", "grp").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"run": F.count("*").over(same), "run_from": F.min("tick").over(same), "run_peak": F.max("score").over(same)})
    trigger = F.when((F.col("class") == "B") & (F.col("run") >= F.col("open_after")), True).when((F.col("class") == "C") & (F.col("run") >= F.col("close_after")), False)
    rows = rows.withColumn("open", F.coalesce(F.last(trigger, ignorenulls=True).over(sofar), F.lit(False)))
    rows = rows.withColumn("was", F.coalesce(F.lag("open").over(order), F.lit(False)))
    b, c = F.col("class") == "B", F.col("class") == "C"
    action = (
        F.when(b & F.col("open") & ~F.col("was"), "OPENED").when(b & F.col("open"), "SUSTAINED").when(b, "PENDING")
        .when(c & F.col("open"), "CLEARING").when(c & F.col("was"), "CLOSED").otherwise("HELD")
    )
    phase = F.when(b & F.col("open"), "ACTIVE").when(b, "PENDING").when(c & F.col("open"), "CLEARING").when(c & F.col("was"), "CLOSED").when(F.col("open"), "ACTIVE").otherwise("IDLE")
    rows = rows.withColumns({"action": action, "phase": phase})
    opened = F.col("action") == "OPENED"
    rows = rows.withColumn("number", F.sum(opened.cast("long")).over(sofar))
    inside = Window.partitionBy("stream", "number").orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = F.sum(F.when(opened, F.col("open_after")).when(F.col("action") == "SUSTAINED", 1).otherwise(0)).over(inside)
    revision = F.sum(F.col("action").isin("OPENED", "SUSTAINED", "CLOSED").cast("long")).over(inside)
    peak = F.max(F.when(opened, F.col("run_peak")).when(F.col("action") == "SUSTAINED", F.col("score"))).over(inside)
    live = (F.col("open") | (F.col("action") == "CLOSED")) & (F.col("number") > 0)
    of = lambda x: F.when(live, x)
    return rows.select(
        "stream", "tick", "score", "class", "action", "phase", of(F.col("number")).alias("number"), of(F.first(F.when(opened, F.col("run_from")), ignorenulls=True).over(inside)).alias("opened"),
        of(counted.cast("long")).alias("breaches"), of(revision).alias("revision"), of(peak).alias("peak"),
    )


def lifecycle(scored: DataFrame, policies: DataFrame) -> DataFrame:
    """One row for each episode of ``transitions``: when it opened, was confirmed and closed (null: open), breaches, revision, peak."""
    rows = transitions(scored, policies).where("number IS NOT NULL")
    return rows.groupBy("stream", "number").agg(
        F.min("opened").alias("opened"), F.min("tick").alias("confirmed"), F.max(F.when(F.col("action") == "CLOSED", F.col("tick"))).alias("closed"),
        F.max("breaches").alias("breaches"), F.max("revision").alias("revision"), F.max("peak").alias("peak"),
    )
