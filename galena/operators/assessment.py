"""Axes of evidence scored from active episodes, states and severity of incidents, falls and silences by rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.sized import small


class Claim(NamedTuple):
    """Episodes of ``kind`` (of ``signals``, if any are named) that an axis counts with ``weight``; ``scaled``: times the weight of the service's criticality."""

    axis: str
    kind: str
    weight: float
    signals: Sequence[str] = ()
    scaled: bool = False


def contributions(active: DataFrame, claims: Sequence[Claim], criticality: Mapping[str, float], least: float) -> DataFrame:
    """``active`` (.., service, kind, signal, peak) with axis and contribution, a row for each claim that an episode meets with at least ``least``.

    A scaled claim on a service without a criticality contributes nothing.
    """
    met = []
    for c in claims:
        factor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in criticality.items() for x in pair)), F.col("service")), F.lit(0.0)) if c.scaled else F.lit(1.0)
        fits = F.col("kind") == c.kind
        if c.signals:
            fits = fits & F.col("signal").isin(*c.signals)
        met.append(F.when(fits, F.struct(F.lit(c.axis).alias("axis"), (c.weight * F.col("peak") * factor).alias("contribution"))))
    each = active.withColumn("met_", F.explode(F.array_compact(F.array(*met)))).where(F.col("met_.contribution") >= least)
    return each.select(*active.columns, F.col("met_.axis").alias("axis"), F.least(F.lit(1.0), F.col("met_.contribution")).alias("contribution"))


def assessed(key: list[str], coverage: DataFrame, active: DataFrame, claims: Sequence[Claim], criticality: Mapping[str, float], least: float = 0.05, deadband: float = 0.05) -> DataFrame:
    """(key, tick, axis, status, score, trend, covered, contributing, services) of each axis at each tick of ``coverage`` (key, tick, kind).

    An axis without a covered kind among its claims is INSUFFICIENT with score 0; kind is null at a tick without any coverage.
    Else the score is the noisy-or of the contributions of the episodes (key, tick, service, kind, signal, peak) active then, and
    trend compares it with the axis's last score: RISING, FALLING, STEADY within ``deadband``, or UNKNOWN.
    """
    by = [*key, "tick", "axis"]
    axes = list(dict.fromkeys(c.axis for c in claims))
    claimed = F.array_compact(F.array(*(F.when(F.col("kind").isin(*{c.kind for c in claims if c.axis == a}), F.lit(a)) for a in axes)))
    # one pass over coverage: every axis at every tick, with the kind only where the axis claims it
    spine = coverage.withColumn("claimed_", claimed).withColumn("axis", F.explode(F.array(*map(F.lit, axes))))
    covered = spine.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(F.array_contains("claimed_", F.col("axis")), F.col("kind")))).alias("covered"))
    found = contributions(active, claims, criticality, least).groupBy(*by).agg(
        (1 - F.product(1 - F.col("contribution"))).alias("score"), F.array_sort(F.collect_set("kind")).alias("contributing"), F.array_sort(F.collect_set("service")).alias("services"),
    )
    rows = covered.join(found, by, "left")
    enough = F.size("covered") > 0
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"score": F.when(enough, F.coalesce("score", F.lit(0.0))), "contributing": F.when(enough, F.coalesce("contributing", none)).otherwise(none), "services": F.when(enough, F.coalesce("services", none)).otherwise(none)})
    before = F.last("score", ignorenulls=True).over(Window.partitionBy(*key, "axis").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1))
    change = F.col("score") - before
    trend = F.when(change > deadband, "RISING").when(change < -deadband, "FALLING").when(change.isNotNull(), "STEADY").otherwise("UNKNOWN")
    return rows.select(*by, F.when(enough, "SCORED").otherwise("INSUFFICIENT").alias("status"), F.coalesce("score", F.lit(0.0)).alias("score"), trend.alias("trend"), "covered", "contributing", "services")


def incident_states(ticks: DataFrame, grace: int) -> DataFrame:
    """``ticks`` (incident, at, active, last_activity) with state: OPEN while active, then MONITORING, and RESOLVED once it has been quiet for ``grace``.

    Quiet counts from the first tick that isn't active, or from the last activity if that is later; activity starts it anew.
    """
    order = Window.partitionBy("incident").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = ticks.withColumn("run_", F.count_if("active").over(order))
    quiet = F.min(F.when(~F.col("active"), F.greatest("last_activity", "at"))).over(Window.partitionBy("incident", "run_").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("active"), "OPEN").when(F.col("at") - quiet >= grace, "RESOLVED").otherwise("MONITORING")
    return runs.withColumn("state", state).drop("run_")


def severity(impact: Column, worst: Column, bands: Sequence[tuple[str, float]], fallback: Mapping[str, str]) -> Column:
    """The first of ``bands`` (severity, least impact) that a measured impact reaches; without one, by the worst criticality of its services.

    ``fallback`` goes from the least criticality to the worst; an unknown one counts as the least.
    """
    measured = F.coalesce(*(F.when(impact >= least, name) for name, least in bands))
    by_service = F.coalesce(*(F.when(worst == level, name) for level, name in fallback.items()), F.lit(next(iter(fallback.values()))))
    return F.when(impact.isNotNull(), measured).otherwise(by_service)


def drops(observed: DataFrame, rules: DataFrame) -> DataFrame:
    """(stream, at, fall, score): how far each (stream, at, observed, expected) fell below what was expected.

    ``rules`` is (stream, least, trigger, full).  fall is null without a rule, or below ``least`` expected; score is null below ``trigger``.
    """
    rows = observed.join(small(rules), "stream", "left")
    fall = F.when(F.col("expected") >= F.col("least"), F.greatest(F.col("expected") - F.col("observed"), F.lit(0.0)) / F.nullif(F.col("expected"), F.lit(0.0)))
    rows = rows.withColumn("fall", fall)
    return rows.select("stream", "at", "fall", F.when(F.col("fall") >= F.col("trigger"), F.least(F.lit(1.0), F.col("fall") / F.col("full"))).alias("score"))


def silences(emitters: DataFrame, rules: DataFrame) -> DataFrame:
    """(stream, emitter, age, onset, score) of each (stream, emitter, expected_since, last_seen, watermark), in microseconds.

    Age counts from the later of expected_since and last_seen (null: never).  ``rules`` is (stream, most_age, full_age); without one
    all is null, and onset and score are null below ``most_age``.  A time after the watermark is an error.
    """
    rows = emitters.join(small(rules), "stream", "left")
    late = F.greatest("expected_since", "last_seen")  # skips nulls
    ahead = F.when(late > F.col("watermark"), F.raise_error(F.concat(F.lit("time after the watermark of "), "stream")).cast("long")).otherwise(F.col("watermark"))
    rows = rows.withColumn("age", F.when(F.col("most_age").isNotNull(), ahead - late))
    fires = F.col("age") >= F.col("most_age")
    return rows.select("stream", "emitter", "age", F.when(fires, late + F.col("most_age")).alias("onset"), F.when(fires, F.least(F.lit(1.0), F.col("age") / F.col("full_age"))).alias("score"))
