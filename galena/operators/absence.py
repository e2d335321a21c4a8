"""What is not there: episodes that no fault explains, services without telemetry, edges that do not exist, actions that nothing asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import intervals


def unrelated_episodes(episodes: DataFrame, matches: DataFrame, targets: DataFrame, hops: DataFrame, most_hops: int, width: int) -> DataFrame:
    """Unmatched ``episodes`` (id, service, start, end) that no fault within ``most_hops`` of their service overlaps.

    ``matches`` is (id), ``targets`` (service, start, end), ``hops`` (source, target, hops) without the pairs of a service and itself, which are
    0 apart.  A service with no target near it is unrelated at any time.
    """
    near = hops.where(F.col("hops") <= most_hops).select(F.col("source").alias("service"), F.col("target").alias("fault")).unionByName(targets.select("service", F.col("service").alias("fault")).distinct())
    left = episodes.join(matches.select("id"), "id", "left_anti")
    dealt = left.join(near.distinct(), "service").select(F.col("id").alias("l_id"), "fault", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    faults = targets.select(F.col("service").alias("fault"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return left.join(intervals.overlapped(dealt, faults, width, ["fault"]).withColumnRenamed("l_id", "id"), "id", "left_anti")


def uncovered_services(named: DataFrame, coverage: DataFrame) -> DataFrame:
    """(incident_id, service) of the services that an incident names, as symptomatic or implicated, and no telemetry covers."""
    return named.select("incident_id", "service").distinct().join(coverage.select("service"), "service", "left_anti").select("incident_id", "service")


def invented_edges(episodes: DataFrame, topology: DataFrame) -> DataFrame:
    """(incident_id, caller, callee) of the edges that an incident's episodes accuse and ``topology`` (caller, callee) does not have; episodes without a callee accuse none."""
    return episodes.where("callee IS NOT NULL").select("incident_id", "caller", "callee").distinct().join(topology, ["caller", "callee"], "left_anti").select("incident_id", "caller", "callee")


def implicated_services(accusations: DataFrame, symptomatic: DataFrame) -> DataFrame:
    """(incident_id, service, onset): the services accused by others that show no symptom of their own, with the first accusation."""
    first = accusations.groupBy("incident_id", "service").agg(F.min("at").alias("onset"))
    return first.join(symptomatic.select("incident_id", "service"), ["incident_id", "service"], "left_anti")


def false_acts(judgements: DataFrame, windows: DataFrame, width: int, acting: tuple[str, ...] = ("ACT",)) -> DataFrame:
    """Acting ``judgements`` (id, start, end, services, action) that no labelled window with a class (start, end, service, class) answers.

    A window answers a judgement on one of its services while they overlap; windows without a class say that nothing was wrong.
    """
    acts = judgements.where(F.col("action").isin(*acting))
    asked = acts.select(F.col("id").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"), F.explode("services").alias("service"))
    faults = windows.where(F.col("class").isNotNull()).select(F.col("start").alias("r_start"), F.col("end").alias("r_end"), "service")
    return acts.join(intervals.overlapped(asked, faults, width, ["service"]).withColumnRenamed("l_id", "id"), "id", "left_anti")
