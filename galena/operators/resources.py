"""Use of a limited resource: series that begin anew when they stop being comparable, and an audit of what a service's samples allow.

``samples`` is (service, tick, us, id, signal, value, instance, supported): a reading of 'used' or 'capacity' of one instance in one tick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Reasons in order of precedence, each with its condition over the facts that ``audit`` gathers; the last one holds for all others.
REASONS = [
    ("MISSING_CONTAINER_INSTANCE_IDENTITY", "unnamed > 0"),
    ("MISSING_USED_AND_CAPACITY", "instance IS NULL OR used = 0 AND capacities = 0"),
    ("MISSING_USED", "used = 0"),
    ("MISSING_FIXED_CAPACITY", "capacities = 0"),
    ("UNSUPPORTED_METRIC_SEMANTICS", "unsupported > 0"),
    ("INVALID_CAPACITY", "least_capacity <= 0"),
    ("NON_CONSTANT_CAPACITY", "least_capacity <> capacity"),
    ("CONFLICTING_USED_TIMESTAMP", "readings <> points"),
    ("NEGATIVE_USED", "least_used < 0"),
    ("USED_EXCEEDS_CAPACITY", "most_used > capacity"),
    ("INSUFFICIENT_SERIES_POINTS", "points < {least}"),
    ("QUALIFIED", "true"),
]


def _named(c: str = "instance") -> Column:
    return F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))


def windows(samples: DataFrame, least: int = 4, keep: int = 24) -> DataFrame:
    """(service, tick, status, reason, instance, capacity, points, first_us) of every tick from a service's first to its last.

    A tick adds a point to its series, or has a reason why not and ends the series: several instances (which also forgets the
    capacity, as a new instance does), readings that are not supported or name no instance, capacities that conflict or are not
    positive, a capacity other than the last one (both are then forgotten), uses that conflict, no use or capacity, a use below 0 or above the
    capacity, a time that is not after the last point's.  A series keeps its last ``keep`` points; ``points`` counts them and ``first_us`` is
    the first one's time.  Status is INSUFFICIENT with a reason, WARMING below ``least`` points, else EVALUATED.
    """
    fine = F.col("supported") & _named().isNotNull()
    used, cap = fine & (F.col("signal") == "used"), fine & (F.col("signal") == "capacity")
    reading = F.when(used, F.struct("us", "value"))
    per = samples.withColumn("instance", _named()).groupBy("service", "tick").agg(
        F.min(F.when(fine, F.col("instance"))).alias("one"), F.max(F.when(fine, F.col("instance"))).alias("other"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("unclear"),
        F.min(F.when(cap, F.col("value"))).alias("low"), F.max(F.when(cap, F.col("value"))).alias("high"), F.min(reading).alias("first"), F.max(reading).alias("last"),
    )
    span = per.groupBy("service").agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    rows = span.select("service", F.explode(F.sequence("a", "b")).alias("tick")).join(per, ["service", "tick"], "left")
    rows = rows.select("service", "tick", "one", F.col("first.us").alias("us"), F.col("first.value").alias("use"), F.col("high").alias("cap"), (F.col("one") != F.col("other")).alias("several"), (F.coalesce("unclear", F.lit(0)) > 0).alias("unclear"), ((F.col("low") != F.col("high")) | (F.col("low") <= 0)).alias("caps_differ"), (F.col("first") != F.col("last")).alias("uses_differ"))
    rows = rows.fillna(False, ["several", "caps_differ", "uses_differ"])

    def order(*more: str, lo: int = Window.unboundedPreceding, hi: int = 0):
        return Window.partitionBy("service", *more).orderBy("tick").rowsBetween(lo, hi)

    # instances: '' stands for none after a tick with several
    mark = F.when(F.col("several"), "").otherwise(F.col("one"))
    rows = rows.withColumns({"mark": mark, "before": F.last(mark, ignorenulls=True).over(order(hi=-1))})
    rows = rows.withColumn("new", F.col("one").isNotNull() & ~F.col("several") & ~F.col("mark").eqNullSafe(F.col("before")))
    rows = rows.withColumns({"epoch": F.count_if(F.col("several") | F.col("new")).over(order()), "instance": F.nullif(F.last("mark", ignorenulls=True).over(order()), F.lit(""))})

    # capacities: of each run of equal ones the first is refused, and forgets, if there is another to differ from.  After a run of
    # several there is; after a run of one there is unless that one was refused, so such runs take turns
    heard = ~F.col("several") & ~F.col("unclear") & F.col("cap").isNotNull()
    rows = rows.withColumns({"torn": heard & F.col("caps_differ"), "said": F.when(heard & ~F.col("caps_differ"), F.col("cap"))})
    rows = rows.withColumn("part", F.count_if("torn").over(order("epoch")))
    rows = rows.withColumn("turn", F.col("said").isNotNull() & ~F.col("said").eqNullSafe(F.last("said", ignorenulls=True).over(order("epoch", "part", hi=-1))))
    rows = rows.withColumn("run", F.count_if("turn").over(order("epoch", "part")) - 1)
    rows = rows.withColumn("long", F.count("said").over(Window.partitionBy("service", "epoch", "part", "run")) > 1)
    since = F.max(F.when(F.col("long"), F.col("run"))).over(order("epoch", "part", hi=-1))
    rows = rows.withColumn("since", since)
    refused = F.when(F.col("since").isNull(), F.col("run") % 2 == 1).otherwise((F.col("run") - F.col("since")) % 2 == 1)
    rows = rows.withColumn("changed", F.col("turn") & refused)
    state = F.when(F.col("torn") | F.col("changed"), F.struct(F.lit(None).cast("double").alias("c"))).when(F.col("said").isNotNull(), F.struct(F.col("said").cast("double").alias("c")))
    rows = rows.withColumn("capacity", F.last(state, ignorenulls=True).over(order("epoch"))["c"])

    reason = (
        F.when(F.col("several"), "SEVERAL_INSTANCES").when(F.col("unclear"), "UNCLEAR").when(F.col("torn"), "CAPACITIES_DIFFER").when(F.col("changed"), "CAPACITY_CHANGED")
        .when(F.col("uses_differ"), "USES_DIFFER").when(F.col("use").isNull() | F.col("capacity").isNull(), "MISSING").when((F.col("use") < 0) | (F.col("use") > F.col("capacity")), "OUT_OF_RANGE")
    )
    rows = rows.withColumn("reason", reason)
    # a point not after the last one ends the series and is left out, so the next one has nothing to follow: refusals take turns here too
    both = F.col("reason").isNull() & ~F.col("new") & F.lag(F.col("reason").isNull()).over(Window.partitionBy("service").orderBy("tick"))
    back = F.coalesce(both & (F.col("us") <= F.lag("us").over(Window.partitionBy("service").orderBy("tick"))), F.lit(False))
    rows = rows.withColumn("back", back).withColumn("stretch", F.count_if(~F.col("back")).over(order()))
    nth = F.count_if("back").over(order("stretch"))
    rows = rows.withColumn("reason", F.when(F.col("back") & (nth % 2 == 1), "NOT_AFTER").otherwise(F.col("reason")))
    rows = rows.withColumn("series", F.count_if(F.col("reason").isNotNull() | F.col("new")).over(order()))
    points = F.count_if(F.col("reason").isNull()).over(order("series", lo=1 - keep))
    first = F.min(F.when(F.col("reason").isNull(), F.col("us"))).over(order("series", lo=1 - keep))
    rows = rows.withColumns({"points": F.when(F.col("reason").isNull(), points).otherwise(0).cast("long"), "first_us": F.when(F.col("reason").isNull(), first)})
    status = F.when(F.col("reason").isNotNull(), "INSUFFICIENT").when(F.col("points") < least, "WARMING").otherwise("EVALUATED")
    return rows.select("service", "tick", status.alias("status"), "reason", "instance", "capacity", "points", "first_us")


def audit(samples: DataFrame, services: DataFrame, least: int = 4, reasons: list[tuple[str, str]] = REASONS) -> DataFrame:
    """(service, reason, instance, points, capacities, capacity, first_us, last_us) of each of ``services`` (service), by its newest instance.

    The newest instance has the latest reading, of equal ones the last name.  ``reasons`` is the rule table: the first whose condition holds is given.
    """
    used, cap = F.col("signal") == "used", F.col("signal") == "capacity"
    rows = samples.where(used | cap).withColumn("instance", _named())
    facts = rows.groupBy("service", "instance").agg(
        F.max("us").alias("newest"), F.count("*").alias("rows"), F.count_if(used).alias("used"), F.count_if(cap).alias("capacities"), F.count_if(~F.coalesce("supported", F.lit(False))).alias("unsupported"),
        F.min(F.when(cap, F.col("value"))).alias("least_capacity"), F.max(F.when(cap, F.col("value"))).alias("capacity"), F.min(F.when(used, F.col("value"))).alias("least_used"), F.max(F.when(used, F.col("value"))).alias("most_used"),
        F.count_distinct(F.when(used, F.struct("us", "value"))).alias("readings"), F.count_distinct(F.when(used, F.col("us"))).alias("points"), F.min(F.when(used, F.col("us"))).alias("first_us"), F.max(F.when(used, F.col("us"))).alias("last_us"),
    )
    last = facts.groupBy("service").agg(F.sum(F.when(F.col("instance").isNull(), F.col("rows")).otherwise(0)).alias("unnamed"), F.max(F.when(F.col("instance").isNotNull(), F.struct("newest", "instance", *(c for c in facts.columns if c not in ("service", "newest", "instance"))))).alias("f"))
    facts = services.join(last, "service", "left").select("service", F.coalesce("unnamed", F.lit(0)).alias("unnamed"), "f.*").fillna(0, ["used", "capacities"])
    case = F.expr("CASE " + " ".join(f"WHEN {rule.format(least=least)} THEN '{name}'" for name, rule in reasons) + " END")
    named = facts.withColumn("reason", case)
    known = lambda c: F.when(F.col("reason") != reasons[0][0], F.col(c))
    return named.select("service", "reason", *(known(c).alias(c) for c in ("instance", "points", "capacities", "capacity", "first_us", "last_us")))
