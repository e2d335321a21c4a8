"""What is done about an incident: checks of its hypothesis, and the ladder of actions with guards and floors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .intervals import suppressed


def verified(
    incidents: DataFrame, episodes: DataFrame, edges: DataFrame, services: DataFrame, coverage: DataFrame, matches: DataFrame, memory_size: int,
    tolerance: int, bootstrap: int = 20, floor: float = 0.9, prefix: str = "dependency.", accusing: str = "EDGE_DEGRADED",
) -> DataFrame:
    """(incident, temporal, covered, dependencies, memory, confirmed): PASSED or FAILED for each of (incident, origin) by its episodes (incident, service, kind, signal, opened).

    temporal: nothing but the origin and the edges accusing it was seen more than ``tolerance`` before these; fails without an
    origin.  covered: telemetry ``coverage`` (incident, service) holds every service with episodes or accused over one of the
    ``edges`` (service, dependency).  dependencies: these are among ``services`` (service), every accusing edge among ``edges``.
    memory: the best of ``matches`` (incident, similarity) reaches ``floor``; BOOTSTRAP below ``bootstrap`` entries.
    confirmed: none failed.  An incident without episodes fails the first check only.
    """
    callee = F.when((F.col("kind") == accusing) & F.col("signal").startswith(prefix), F.expr(f"nullif(substring(signal, {len(prefix) + 1}), '')"))
    edges = edges.select("service", F.col("dependency").alias("callee"), F.lit(True).alias("committed")).distinct()
    rows = episodes.select("incident", "service", "opened", callee.alias("callee")).join(edges, ["service", "callee"], "left").join(incidents.select("incident", "origin"), "incident")
    ours = F.coalesce((F.col("service") == F.col("origin")) | (F.col("callee") == F.col("origin")), F.col("service") == F.col("origin"), F.lit(False))
    times = rows.groupBy("incident").agg(
        F.min(F.when(ours, F.col("opened"))).alias("first"), F.min(F.when(~ours, F.col("opened"))).alias("other"),
        F.count(F.when(F.col("callee").isNotNull() & F.col("committed").isNull(), 1)).alias("invented"),
    )
    # an accused service is named only over an edge that exists
    named = rows.select("incident", F.explode(F.array("service", F.when(F.col("committed"), F.col("callee")))).alias("service")).where("service IS NOT NULL").distinct()
    named = named.join(coverage.select("incident", "service", F.lit(True).alias("seen")).distinct(), ["incident", "service"], "left").join(services.select("service", F.lit(True).alias("known")).distinct(), "service", "left")
    lacks = named.groupBy("incident").agg(F.count(F.when(F.col("seen").isNull(), 1)).alias("unseen"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown"))
    best = matches.groupBy("incident").agg(F.max("similarity").alias("best"))
    got = incidents.select("incident", "origin").join(times, "incident", "left").join(lacks, "incident", "left").join(best, "incident", "left")
    origins = services.select(F.col("service").alias("origin"), F.lit(True).alias("origin_known")).distinct()
    got = got.join(origins, "origin", "left")
    passed = lambda test: F.when(F.coalesce(test, F.lit(False)), "PASSED").otherwise("FAILED")
    sound = (F.coalesce("invented", F.lit(0)) == 0) & (F.coalesce("unknown", F.lit(0)) == 0) & (F.col("origin").isNull() | F.col("origin_known"))
    checks = {
        "temporal": passed(F.col("first").isNotNull() & (F.col("other").isNull() | (F.col("other") + tolerance >= F.col("first")))),
        "covered": passed(F.coalesce("unseen", F.lit(0)) == 0),
        "dependencies": passed(sound),
        "memory": F.lit("BOOTSTRAP") if memory_size < bootstrap else passed(F.col("best") >= floor),
    }
    confirmed = ~F.array_contains(F.array(*checks), "FAILED")
    return got.withColumns(checks).select("incident", *checks, confirmed.alias("confirmed"))


class ActionRule(NamedTuple):
    """An action and what it asks of the peak evidence and the current incident; what is empty or None isn't asked."""

    name: str
    action: str
    verdicts: Sequence[str] = ()
    statuses: Sequence[str] = ()
    states: Sequence[str] = ()
    confirmed: bool | None = None
    confidence: float | None = None
    severity: str | None = None


class Floor(NamedTuple):
    """The least action where an incident is in one of the states, this severe, and of this measured impact."""

    name: str
    action: str
    states: Sequence[str] = ()
    severity: str | None = None
    impact: float | None = None


class Guards(NamedTuple):
    """What an acting decision needs besides verdict, verification, origin and a live incident, and what it falls back to."""

    confidence: float
    services: int
    fallback: str
    live: Sequence[str] = ("OPEN", "MITIGATING")
    approve_severities: Sequence[str] = ("CRITICAL",)
    approve_services: int = 3


def decided(
    ticks: DataFrame, rules: Sequence[ActionRule], floors: Sequence[Floor], guards: Guards, severities: Sequence[str],
    attention: Mapping[str, int], acting: Sequence[str], quiet: Sequence[str], ended: str = "RESOLVED",
) -> DataFrame:
    """(incident, at, rule, action, evidence_at, guards, floors, approvals) of each tick (incident, at, state, severity, impact, origin, services, verdict, confidence, status, confirmed).

    Evidence peaks: the highest of ``severities`` so far, and the earliest verdict of the highest confidence, with its status;
    before any verdict, the current status.  A tick that is ``ended`` counts by itself and clears what was held.  The first rule
    that holds names an action (the last one must ask nothing).  An ``acting`` action without all that the guards ask becomes
    the fallback; floors then raise an action of less ``attention``.  approvals: why a person must sign an action not ``quiet``.
    """
    if rules[-1][2:] != ActionRule("", "")[2:]:
        raise ValueError("the last rule must hold always")
    rank = F.array_position(F.array(*map(F.lit, severities)), F.col("severity"))
    before = F.sum(F.when(F.col("state") == ended, 1).otherwise(0)).over(Window.partitionBy("incident").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = ticks.withColumns({"rank": F.coalesce(rank, F.lit(0)), "epoch": F.coalesce(before, F.lit(0))})
    so_far = Window.partitionBy("incident", "epoch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    is_ended = F.coalesce(F.col("state") == ended, F.lit(False))
    own = F.struct("confidence", (-F.col("at")).alias("minus_at"), "verdict", "status")
    held = F.max(F.when(F.col("verdict").isNotNull() & ~is_ended, own)).over(so_far)
    rows = rows.withColumns({"peak": F.when(is_ended, own).otherwise(F.coalesce(held, own)), "top": F.when(is_ended, F.col("rank")).otherwise(F.max("rank").over(so_far))})
    rank_of = {s: i + 1 for i, s in enumerate(severities)}
    peak = F.col("peak")
    holds = lambda test: F.coalesce(test, F.lit(False))

    def matches(r: ActionRule) -> Column:
        test = F.lit(True)
        for asked, column in ((r.verdicts, peak["verdict"]), (r.statuses, peak["status"]), (r.states, F.col("state"))):
            if asked:
                test = test & holds(column.isin(*asked))
        if r.confirmed is not None:
            test = test & (holds(F.col("confirmed")) == r.confirmed)
        if r.confidence is not None:
            test = test & peak["verdict"].isNotNull() & holds(peak["confidence"] >= r.confidence)
        return test if r.severity is None else test & (F.col("top") >= rank_of[r.severity])

    picked = F.coalesce(*(F.when(matches(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"))) for r in rules))
    rows = rows.withColumn("picked", picked)
    blocks = {
        "require_verdict": peak["verdict"].isNull(),
        "require_verification": ~holds(F.col("confirmed")),
        "require_named_origin": F.col("origin").isNull(),
        "require_active_incident": ~holds(F.col("state").isin(*guards.live)),
        "minimum_act_confidence": holds(peak["verdict"].isNotNull() & (peak["confidence"] < guards.confidence)),
        "maximum_affected_services": holds(F.col("services") > guards.services),
    }
    listed = lambda tests: F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))
    acts = F.col("picked.action").isin(*acting)
    rows = rows.withColumn("guards", F.when(acts, listed(blocks)).otherwise(F.array().cast("array<string>")))
    action = F.when(F.size("guards") > 0, guards.fallback).otherwise(F.col("picked.action"))
    rows = rows.withColumns({"action": action, "floors": F.array().cast("array<string>")})
    level = lambda c: F.coalesce(*(F.when(c == a, n) for a, n in attention.items()))
    for f in floors:
        test = level(F.col("action")) < attention[f.action]
        if f.states:
            test = test & holds(F.col("state").isin(*f.states))
        if f.severity is not None:
            test = test & (F.col("top") >= rank_of[f.severity])
        if f.impact is not None:
            test = test & holds(F.col("impact") >= f.impact)
        rows = rows.withColumns({"action": F.when(test, f.action).otherwise(F.col("action")), "floors": F.when(test, F.array_append("floors", F.lit(f.name))).otherwise(F.col("floors"))})
    signed = listed({"severity": F.col("top").isin(*(rank_of[s] for s in guards.approve_severities)), "services": holds(F.col("services") >= guards.approve_services)})
    approvals = F.when(F.col("action").isin(*quiet), F.array().cast("array<string>")).otherwise(F.concat("guards", signed))
    return rows.select("incident", "at", F.col("picked.rule").alias("rule"), "action", (-peak["minus_at"]).alias("evidence_at"), "guards", "floors", approvals.alias("approvals"))


def governed(decisions: DataFrame, windows: DataFrame, critical: DataFrame, attention: Mapping[str, int], width: int, acting: Sequence[str], quiet: Sequence[str], escalating: Sequence[str], fallback: str) -> DataFrame:
    """(decision_id, action, applied, approvals, escalated): decisions after the windows in force, and why a person must sign them.

    ``decisions`` is (decision_id, at, services, class, action, approvals), one row for each id, ``windows`` as ``intervals.suppressed``
    takes them, ``critical`` the services (service) whose actions need a signature.  To the approvals so far come "change_freeze" and
    "critical_service"; a ``quiet`` action needs none.  ``escalated``, that the action itself goes to a person, asks for no signature.
    """
    after = suppressed(decisions, windows, dict(attention), width, tuple(acting), fallback)
    named = decisions.select("decision_id", F.explode("services").alias("service")).join(critical.select("service"), "service", "left_semi")
    after = after.join(named.select("decision_id", F.lit(True).alias("critical_")).distinct(), "decision_id", "left")
    added = F.array_compact(F.array(F.when(F.col("applied_kind") == "CHANGE_FREEZE", "change_freeze"), F.when(F.col("critical_"), "critical_service")))
    asked = F.array_distinct(F.concat(F.coalesce("approvals", F.array().cast("array<string>")), added))
    approvals = F.when(F.col("final").isin(*quiet), F.array().cast("array<string>")).otherwise(asked)
    return after.select("decision_id", F.col("final").alias("action"), "applied", approvals.alias("approvals"), F.col("final").isin(*escalating).alias("escalated"))
