"""Bursts of log templates: window by window of each service, against rates learned in its first good windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.sized import small
from .templates import line_templates, masked, stored


def log_bursts(
    lines: DataFrame, width_us: int, warmup: int = 3, least_records: int = 5, least_count: int = 5, floor: float = 0.01, trigger: float = 2.0, full: float = 10.0, most_chars: int = 2000, **tree
) -> DataFrame:
    """(service, tick, status, records, leader, n, deformation, score) of every window of ``lines`` (service, us, id, line), from a service's first to its last.

    Templates are learned from all usable lines, evaluated or not, by ``line_templates`` (settings ``tree``).  A window with a line that is blank or longer than
    ``most_chars``, or with an id that comes twice, is INSUFFICIENT.  Others are WARMING until ``warmup`` of them had ``least_records`` lines; a template's baseline
    is its mean rate per second over these, without it 0.  Later windows with fewer lines are INSUFFICIENT, the rest BREACH or CLEAR: a template
    breaches with ``least_count`` lines and a rise over max(baseline, ``floor``) of at least ``trigger``, its score is the rise over ``full``, 1 at most.
    Of several the strongest is given: by score, rise, count, then name.  Rows without service or us are left out.
    Lines and templates are counted by the MD5 of their text; only the templates that breach are named again.
    """
    rows = lines.where("service IS NOT NULL AND us IS NOT NULL").withColumns({"tick": F.floor(F.col("us") / width_us), "text": F.trim(F.coalesce("line", F.lit("")))})
    good = (F.col("text") != "") & (F.char_length("text") <= most_chars)
    seen = rows.groupBy("service", "tick", "id").agg(F.count("*").alias("c"), F.count_if(~good).alias("bad"))
    windows = seen.groupBy("service", "tick").agg(F.count_if(F.col("bad") == 0).alias("records"), F.sum(F.col("bad") + F.when(F.col("id").isNotNull(), F.col("c") - 1).otherwise(F.col("c"))).alias("unclear"))
    span = windows.groupBy("service").agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    spine = span.select("service", F.explode(F.sequence("a", "b")).alias("tick")).join(windows, ["service", "tick"], "left").fillna(0, ["records", "unclear"])
    order = Window.partitionBy("service").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    fine = (F.col("unclear") == 0) & (F.col("records") >= least_records)
    spine = spine.withColumn("learned", F.coalesce(F.count_if(fine).over(order), F.lit(0)))
    status = F.when(F.col("unclear") > 0, "INSUFFICIENT").when(F.col("learned") < warmup, "WARMING").when(F.col("records") < least_records, "INSUFFICIENT").otherwise("EVALUATED")
    spine = spine.withColumn("status", status)

    usable = rows.where(good).withColumn("line", F.col("text"))
    leaders = line_templates(usable.select("service", "line"), ["service"], **tree)
    named = lambda text: F.unhex(F.md5(text))
    counts = usable.withColumn("line_key", named(masked(F.col("text")))).groupBy("service", "tick", "line_key").agg(F.count("*").alias("n"))
    keys = leaders.select("service", named("template").alias("line_key"), named("leader").alias("leader_key"))
    counts = stored(counts.join(keys, ["service", "line_key"]).groupBy("service", "tick", "leader_key").agg(F.sum("n").alias("n")), "counts")
    rate = F.col("n") / (width_us / 1e6)
    warm = spine.where((F.col("status") == "WARMING") & (F.col("records") >= least_records)).select("service", "tick")
    base = counts.join(warm, ["service", "tick"]).groupBy("service", "leader_key").agg((F.sum(rate) / warmup).alias("base"))
    judged = counts.join(spine.where("status = 'EVALUATED'").select("service", "tick"), ["service", "tick"]).join(base, ["service", "leader_key"], "left")
    known = F.coalesce("base", F.lit(0.0))
    judged = judged.withColumn("deformation", F.greatest(rate - known, F.lit(0.0)) / F.greatest(known, F.lit(floor)))
    fired = judged.where((F.col("n") >= least_count) & (F.col("deformation") >= trigger)).withColumn("score", F.least(F.col("deformation") / full, F.lit(1.0)))
    fired = stored(fired, "fired")
    breached = small(fired.select("service", "leader_key").distinct())
    names = leaders.withColumn("leader_key", named("leader")).join(breached, ["service", "leader_key"]).select("service", "leader_key", "leader").distinct()
    best = fired.join(names, ["service", "leader_key"]).groupBy("service", "tick").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("deformation")).alias("d"), (-F.col("n")).alias("k"), "leader")).alias("f"))
    out = spine.join(best, ["service", "tick"], "left")
    final = F.when(F.col("status") != "EVALUATED", F.col("status")).when(F.col("f").isNotNull(), "BREACH").otherwise("CLEAR")
    return out.select("service", "tick", final.alias("status"), "records", F.col("f.leader").alias("leader"), (-F.col("f.k")).alias("n"), (-F.col("f.d")).alias("deformation"), (-F.col("f.s")).alias("score"))
