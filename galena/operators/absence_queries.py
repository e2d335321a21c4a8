"""Queries of anti joins, snapshots and contexts in force, with SQL that asks NOT EXISTS of every row.

A signup or error above 100 is a fault of its service for an hour, an event type a service; user and day make an incident.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import absence, intervals
from .queries import EVENTS, HOUR, _events
from .statements import SCORED

DAY = 24 * HOUR
#: (id, first tick, end tick, multiplier, trust) of the contexts
CONTEXT_ROWS = [(1, 78912, 78920, 2.5, 1.0), (2, 78918, 78940, 1.5, 0.5), (3, 78930, 78931, 0.5, 1.0)]
NEXT = [("view", "click"), ("click", "purchase"), ("purchase", "error"), ("error", "signup")]


def _hops(spark):
    """The services in a row, hops apart in both directions."""
    names = ["view", "click", "purchase", "error", "signup"]
    return spark.createDataFrame([(a, b, abs(i - j)) for i, a in enumerate(names) for j, b in enumerate(names) if i != j], "source string, target string, hops int")


def unrelated_episodes(spark, sf_dir):
    e = _events(spark, sf_dir)
    episodes = e.where("value > 40").select(F.col("event_id").alias("id"), F.col("event_type").alias("service"), F.col("us").alias("start"), (F.col("us") + HOUR // 2).alias("end"))
    targets = e.where("event_type IN ('signup', 'error') AND value > 100").select(F.col("event_type").alias("service"), F.col("us").alias("start"), (F.col("us") + HOUR).alias("end"))
    return absence.unrelated_episodes(episodes, e.where("user_id % 5 = 0").select(F.col("event_id").alias("id")), targets, _hops(spark), 1, HOUR)


def _incidents(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("incident_id", F.concat_ws("/", F.col("user_id").cast("string"), F.floor(F.col("us") / DAY).cast("string")))


def uncovered_services(spark, sf_dir):
    """Covered are the pairs of a type and a user's last two digits that some event of value 10 to 50 has."""
    e = _incidents(spark, sf_dir).withColumn("service", F.concat("event_type", (F.col("user_id") % 100).cast("string")))
    return absence.uncovered_services(e, e.where("value BETWEEN 10 AND 50").select("service").distinct())


def _accusing(spark, sf_dir):
    """An event accuses the service of the user's next one."""
    from pyspark.sql import Window

    e = _incidents(spark, sf_dir)
    return e.withColumn("callee", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("us", "event_id"))).withColumnRenamed("event_type", "caller")


def invented_edges(spark, sf_dir):
    return absence.invented_edges(_accusing(spark, sf_dir), spark.createDataFrame(NEXT, "caller string, callee string"))


def implicated_services(spark, sf_dir):
    e = _accusing(spark, sf_dir)
    accused = e.where("callee IS NOT NULL AND value > 50").select("incident_id", F.col("callee").alias("service"), F.col("us").alias("at"))
    return absence.implicated_services(accused, e.select("incident_id", F.col("caller").alias("service")))


def false_act_antijoin(spark, sf_dir):
    e = _events(spark, sf_dir)
    judged = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), (F.col("us") - HOUR).alias("start"), F.col("us").alias("end"), F.array(F.concat(F.lit("seg"), "segment"), F.concat(F.lit("user"), F.col("user_id") % 10)).alias("services"), F.when(F.col("value") > 20, "ACT").otherwise("WATCH").alias("action"))
    fault = F.when(F.col("value") > 60, "FAULT")
    windows = e.where("event_type = 'error'").select((F.col("us") - HOUR).alias("start"), (F.col("us") + HOUR).alias("end"), F.explode(F.array(F.concat(F.lit("seg"), "segment"), F.concat(F.lit("user"), F.col("user_id") % 10))).alias("service"), fault.alias("class"))
    return absence.false_acts(judged, windows, 2 * HOUR).select("id", "action")


def episode_snapshots(spark, sf_dir):
    """Every second morning, the users' latest versions: of the revisions, numbered by event, one of seven comes late."""
    e = _events(spark, sf_dir)
    versions = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("revision"), (F.col("us") + F.when(F.col("event_id") % 7 == 0, 2 * DAY).otherwise(0)).alias("effective"), F.when(F.col("event_type") == "purchase", "CLOSED").otherwise("OPEN").alias("state"))
    times = e.select(((F.floor(F.col("us") / (2 * DAY)) + 1) * 2 * DAY).alias("at")).distinct()
    return intervals.snapshots(versions, times, 2 * DAY).select("at", "id", "revision", "state", "effective")


def _in_force(spark, points: DataFrame) -> DataFrame:
    contexts = spark.createDataFrame(CONTEXT_ROWS, "context_id int, valid_from long, valid_to long, multiplier double, trust double")
    return intervals.point_in_interval(points, contexts, "tick", "valid_from", "valid_to", 8, how="left")


def context_interval_join(spark, sf_dir):
    met = _in_force(spark, _events(spark, sf_dir).select("event_id", "value", "tick"))
    lift = F.when((F.col("multiplier") > 1) & (F.col("trust") > 0), F.col("value") * (F.col("multiplier") - 1) * F.col("trust"))
    return met.groupBy("event_id").agg(F.count("context_id").alias("contexts"), F.round(F.coalesce(F.sum(lift), F.lit(0.0)), 6).alias("lift"))


def event_features(spark, sf_dir):
    met = _in_force(spark, _events(spark, sf_dir).select("event_id", "tick"))
    lift = F.greatest(F.lit(0.0), F.col("multiplier") - 1) * F.col("trust")
    return met.groupBy("event_id").agg(F.count("context_id").alias("event_count"), F.round(F.coalesce(F.sum(lift), F.lit(0.0)), 6).alias("event_lift"), F.coalesce(F.max("trust"), F.lit(0.0)).alias("trust_max"))


def unrelated_episode_antijoin(spark, sf_dir):
    from ..plans.dialect import statement

    scored, _ = statement(f"SELECT DISTINCT stream, tick FROM {SCORED} s WHERE score >= 0.5e0")
    rows = scored(spark, sf_dir).select(F.struct("stream", "tick").alias("l_id"), F.col("tick").alias("l_start"), (F.col("tick") + 1).alias("l_end"))
    contexts = spark.createDataFrame(CONTEXT_ROWS, "context_id int, r_start long, r_end long, multiplier double, trust double").select("r_start", "r_end")
    return intervals.without_overlap(rows, contexts, 8, []).select("l_id.*")


def change_pressure(spark, sf_dir):
    """Every event after the signups of the last hour."""
    e = _events(spark, sf_dir).withColumnRenamed("event_type", "service")
    return intervals.pressed(e, e.where("service = 'signup'"), HOUR).withColumn("pressure", F.round("pressure", 6))


change_pressure_all = change_pressure
INCIDENT = f"CAST(user_id AS VARCHAR) || '/' || CAST(CAST(floor(us / {DAY}) AS BIGINT) AS VARCHAR)"
ACCUSING = f"(SELECT *, {INCIDENT} AS incident_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS callee FROM {EVENTS})"
ORDER = "CASE {0} WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END"
ORACLES = {
    "unrelated_episodes": f"SELECT event_id AS id, event_type AS service, us AS start, us + 1800000000 AS end FROM {EVENTS} x WHERE value > 40 AND user_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM {EVENTS} f WHERE f.event_type IN ('signup', 'error') AND f.value > 100 AND abs({ORDER.format('x.event_type')} - {ORDER.format('f.event_type')}) <= 1 AND x.us < f.us + 3600000000 AND f.us < x.us + 1800000000)",
    "uncovered_services": f"SELECT DISTINCT {INCIDENT} AS incident_id, event_type || (user_id % 100) AS service FROM {EVENTS} x WHERE NOT EXISTS (SELECT 1 FROM events y WHERE y.event_type = x.event_type AND y.user_id % 100 = x.user_id % 100 AND y.value BETWEEN 10 AND 50)",
    "invented_edges": f"SELECT DISTINCT incident_id, event_type AS caller, callee FROM {ACCUSING} WHERE callee IS NOT NULL AND (event_type, callee) NOT IN ({', '.join(map(str, NEXT))})",
    "implicated_services": f"SELECT incident_id, callee AS service, min(us) AS onset FROM {ACCUSING} x WHERE callee IS NOT NULL AND value > 50 AND NOT EXISTS (SELECT 1 FROM {ACCUSING} y WHERE y.incident_id = x.incident_id AND y.event_type = x.callee) GROUP BY incident_id, callee",
    "false_act_antijoin": f"SELECT p.event_id AS id, 'ACT' AS action FROM {EVENTS} p WHERE p.event_type = 'purchase' AND p.value > 20 AND NOT EXISTS (SELECT 1 FROM {EVENTS} e WHERE e.event_type = 'error' AND e.value > 60 AND (e.segment = p.segment OR e.user_id % 10 = p.user_id % 10) AND p.us - 3600000000 < e.us + 3600000000 AND e.us - 3600000000 < p.us)",
    "episode_snapshots": f"""WITH v AS (SELECT user_id AS id, event_id AS revision, us + CASE WHEN event_id % 7 = 0 THEN {2 * DAY} ELSE 0 END AS effective, CASE WHEN event_type = 'purchase' THEN 'CLOSED' ELSE 'OPEN' END AS state FROM {EVENTS}),
t AS (SELECT DISTINCT (CAST(floor(us / {2 * DAY}) AS BIGINT) + 1) * {2 * DAY} AS "at" FROM {EVENTS})
SELECT "at", id, max(revision) AS revision, arg_max(state, revision) AS state, arg_max(effective, revision) AS effective FROM t JOIN v ON v.effective <= t."at" GROUP BY "at", id""",
}
QUERIES = {name: (globals()[name], sql) for name, sql in ORACLES.items()}
#: Statements that joined by nested loops or met every change: the same SQL checks these.
INSTEAD = {name: globals()[name] for name in ("context_interval_join", "event_features", "unrelated_episode_antijoin", "change_pressure", "change_pressure_all")}
