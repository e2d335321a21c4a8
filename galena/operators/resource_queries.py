"""Queries of resource series and of their audit: a user is a service, a tick twelve hours; SQL that follows the rules tick by tick."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import resources
from .queries import EVENTS, HOUR, _events

LONG = 12 * HOUR


def _samples(spark, sf_dir):
    """Signups and errors read the capacity, other events the use; one of 40 readings isn't supported, one of 60 names no instance, some come late."""
    e = _events(spark, sf_dir)
    value = F.when(~F.col("event_type").isin("signup", "error"), F.col("value")).when(F.col("value") > 150, 0.0).otherwise(200.0 + 100 * (F.floor(F.col("us") / (5 * LONG)) % 2))
    return e.select(
        F.col("user_id").alias("service"), F.floor(F.col("us") / LONG).alias("tick"), (F.col("us") - F.when(F.col("event_id") % 5 == 0, 2 * LONG).otherwise(0)).alias("us"), F.col("event_id").alias("id"),
        F.when(F.col("event_type").isin("signup", "error"), "capacity").otherwise("used").alias("signal"), value.alias("value"),
        F.when(F.col("event_id") % 60 != 7, F.concat(F.lit("pod"), F.floor((F.col("us") / LONG + F.col("user_id") % 9) / 9).cast("string"))).alias("instance"), (F.col("event_id") % 40 != 3).alias("supported"),
    )


def resource_windows(spark, sf_dir):
    return resources.windows(_samples(spark, sf_dir), 2, 4)


def resource_audit(spark, sf_dir):
    services = _events(spark, sf_dir).select(F.col("user_id").alias("service")).distinct()
    return resources.audit(_samples(spark, sf_dir), services.unionByName(spark.createDataFrame([(-1,)], "service long").select(F.col("service").cast(services.schema[0].dataType))), 3)


SAMPLES = f"""(SELECT user_id AS service, CAST(floor(us / {LONG}) AS BIGINT) AS tick, us - CASE WHEN event_id % 5 = 0 THEN {2 * LONG} ELSE 0 END AS us, event_id AS id,
  event_type IN ('signup', 'error') AS is_cap, CASE WHEN event_type NOT IN ('signup', 'error') THEN value WHEN value > 150 THEN 0.0 ELSE 200.0 + 100 * (CAST(floor(us / {5 * LONG}) AS BIGINT) % 2) END AS value,
  CASE WHEN event_id % 60 <> 7 THEN 'pod' || CAST(floor((us / {LONG} + user_id % 9) / 9) AS BIGINT) END AS instance, event_id % 40 <> 3 AS supported FROM {EVENTS})"""
ORACLES = {
    "resource_windows": f"""WITH RECURSIVE r AS MATERIALIZED (SELECT *, supported AND instance IS NOT NULL AS fine FROM {SAMPLES}),
g AS MATERIALIZED (SELECT service, tick, min(instance) FILTER (WHERE fine) AS one, count(DISTINCT instance) FILTER (WHERE fine) AS pods, count(*) FILTER (WHERE NOT fine) AS unclear,
  min(value) FILTER (WHERE fine AND is_cap) AS low, max(value) FILTER (WHERE fine AND is_cap) AS high, count(DISTINCT (us, value)) FILTER (WHERE fine AND NOT is_cap) AS uses,
  arg_min(us, id) FILTER (WHERE fine AND NOT is_cap) AS us, arg_min(value, id) FILTER (WHERE fine AND NOT is_cap) AS use FROM r GROUP BY service, tick),
n AS (SELECT service, min(tick) AS a, max(tick) AS b FROM g GROUP BY service),
s AS (
  SELECT service, a - 1 AS tick, b, CAST(NULL AS VARCHAR) AS pod, CAST(NULL AS DOUBLE) AS cap, CAST([] AS BIGINT[]) AS pts, CAST(NULL AS VARCHAR) AS reason FROM n
  UNION ALL
  SELECT service, tick, b, pod, CASE WHEN reason IN ('CAPACITIES_DIFFER', 'CAPACITY_CHANGED') THEN NULL WHEN reason IN ('SEVERAL_INSTANCES', 'UNCLEAR') THEN cap ELSE coalesce(high, cap) END,
         CASE WHEN reason IS NULL THEN list_append(pts, us)[-4:] ELSE CAST([] AS BIGINT[]) END, reason
  FROM (
    SELECT *, CASE WHEN pods > 1 THEN 'SEVERAL_INSTANCES' WHEN unclear > 0 THEN 'UNCLEAR' WHEN low <> high OR low <= 0 THEN 'CAPACITIES_DIFFER' WHEN high <> cap THEN 'CAPACITY_CHANGED'
                   WHEN uses > 1 THEN 'USES_DIFFER' WHEN use IS NULL OR coalesce(high, cap) IS NULL THEN 'MISSING' WHEN use < 0 OR use > coalesce(high, cap) THEN 'OUT_OF_RANGE' WHEN us <= pts[-1] THEN 'NOT_AFTER' END AS reason
    FROM (SELECT x.service, x.tick + 1 AS tick, x.b, g.pods, g.unclear, g.low, g.high, g.uses, g.us, g.use, CASE WHEN g.pods > 1 THEN NULL ELSE coalesce(g.one, x.pod) END AS pod,
                 CASE WHEN g.pods > 1 OR g.one <> coalesce(x.pod, '') THEN NULL ELSE x.cap END AS cap, CASE WHEN g.one <> coalesce(x.pod, '') THEN CAST([] AS BIGINT[]) ELSE x.pts END AS pts
          FROM s x LEFT JOIN g ON g.service = x.service AND g.tick = x.tick + 1 WHERE x.tick < x.b)))
SELECT s.service, s.tick, CASE WHEN reason IS NOT NULL THEN 'INSUFFICIENT' WHEN len(pts) < 2 THEN 'WARMING' ELSE 'EVALUATED' END AS status, reason, pod AS instance, cap AS capacity, CAST(len(pts) AS BIGINT) AS points, pts[1] AS first_us
FROM s JOIN n ON n.service = s.service AND s.tick >= n.a""",
    "resource_audit": f"""WITH r AS (SELECT * FROM {SAMPLES}), k AS (SELECT DISTINCT user_id AS service FROM events UNION ALL SELECT -1),
u AS (SELECT service, count(*) AS unnamed FROM r WHERE instance IS NULL GROUP BY service),
i AS (SELECT service, instance, row_number() OVER (PARTITION BY service ORDER BY max(us) DESC, instance DESC) AS k FROM r WHERE instance IS NOT NULL GROUP BY service, instance),
x AS (SELECT r.* FROM r JOIN i ON i.service = r.service AND i.instance = r.instance AND i.k = 1),
f AS (SELECT service, any_value(instance) AS instance, count(*) FILTER (WHERE is_cap) AS capacities, count(DISTINCT us) FILTER (WHERE NOT is_cap) AS points, max(value) FILTER (WHERE is_cap) AS capacity, min(us) FILTER (WHERE NOT is_cap) AS first_us, max(us) FILTER (WHERE NOT is_cap) AS last_us FROM x GROUP BY service)
SELECT k.service, CASE WHEN u.unnamed > 0 THEN 'MISSING_CONTAINER_INSTANCE_IDENTITY' ELSE reason END AS reason, CASE WHEN u.unnamed IS NULL THEN instance END AS instance, CASE WHEN u.unnamed IS NULL THEN points END AS points,
       CASE WHEN u.unnamed IS NULL THEN coalesce(capacities, 0) END AS capacities, CASE WHEN u.unnamed IS NULL THEN capacity END AS capacity, CASE WHEN u.unnamed IS NULL THEN first_us END AS first_us, CASE WHEN u.unnamed IS NULL THEN last_us END AS last_us
FROM (SELECT k.service, f.instance, f.points, f.capacities, f.capacity, f.first_us, f.last_us,
        CASE WHEN f.service IS NULL THEN 'MISSING_USED_AND_CAPACITY'
             WHEN f.points = 0 THEN 'MISSING_USED' WHEN f.capacities = 0 THEN 'MISSING_FIXED_CAPACITY'
             WHEN EXISTS (SELECT 1 FROM x WHERE x.service = k.service AND NOT x.supported) THEN 'UNSUPPORTED_METRIC_SEMANTICS'
             WHEN EXISTS (SELECT 1 FROM x WHERE x.service = k.service AND x.is_cap AND x.value <= 0) THEN 'INVALID_CAPACITY'
             WHEN EXISTS (SELECT 1 FROM x WHERE x.service = k.service AND x.is_cap AND x.value <> f.capacity) THEN 'NON_CONSTANT_CAPACITY'
             WHEN EXISTS (SELECT 1 FROM x JOIN x y ON y.service = x.service AND y.us = x.us AND y.value <> x.value AND NOT y.is_cap WHERE x.service = k.service AND NOT x.is_cap) THEN 'CONFLICTING_USED_TIMESTAMP'
             WHEN EXISTS (SELECT 1 FROM x WHERE x.service = k.service AND NOT x.is_cap AND x.value < 0) THEN 'NEGATIVE_USED'
             WHEN EXISTS (SELECT 1 FROM x WHERE x.service = k.service AND NOT x.is_cap AND x.value > f.capacity) THEN 'USED_EXCEEDS_CAPACITY'
             WHEN f.points < 3 THEN 'INSUFFICIENT_SERIES_POINTS' ELSE 'QUALIFIED' END AS reason
      FROM k LEFT JOIN f ON f.service = k.service) k LEFT JOIN u ON u.service = k.service""",
}
QUERIES = {name: (globals()[name], sql) for name, sql in ORACLES.items()}
