"""Queries of axes, incident states, falls, silences and feeds, each with SQL of its own that follows the definition.

Events, ticks and segments are those of ``queries``; k is the number in an event's properties.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..sources import feeds
from . import assessment, ingest
from .capture_queries import DAY, END, START
from .queries import EVENTS, HOUR, TICK, _events

KINDS = ("RATIO_DEFORM", "RESIDUAL_EXCEED", "EDGE_DEGRADED", "DROP", "SATURATION")
CLAIMS = [
    assessment.Claim("SECURITY", "RATIO_DEFORM", 0.85, ("source_entropy",)),
    assessment.Claim("SECURITY", "RESIDUAL_EXCEED", 0.45),
    assessment.Claim("RELIABILITY", "EDGE_DEGRADED", 0.85),
    assessment.Claim("RELIABILITY", "SATURATION", 0.8),
    assessment.Claim("RELIABILITY", "DROP", 0.7),
    assessment.Claim("CHANGE_CONFIG", "DEPLOY_MARKER", 0.9),
    assessment.Claim("BUSINESS_IMPACT", "RATIO_DEFORM", 0.85, ("conversion_ratio",), scaled=True),
    assessment.Claim("BUSINESS_IMPACT", "DROP", 0.8, scaled=True),
]
CRITICALITY = {"view": 1.0, "click": 0.7, "purchase": 0.4}
BANDS = [("CRITICAL", 0.75), ("HIGH", 0.5), ("MEDIUM", 0.25), ("LOW", 0.0)]
FALLBACK = {"low": "LOW", "medium": "LOW", "high": "MEDIUM", "critical": "HIGH"}


def _numbered(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def axis_assessments(spark, sf_dir):
    """A large value is an active episode, a small one covers its kind."""
    e = _numbered(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 5 + 1).cast("int"))
    rows = e.select("segment", "tick", F.col("event_type").alias("service"), kind.alias("kind"), F.when(F.col("k") % 2 == 0, "conversion_ratio").otherwise("source_entropy").alias("signal"), F.least(F.lit(1.0), F.col("value") / 200).alias("peak"), "value")
    coverage = rows.select("segment", "tick", F.when(F.col("value") < 15, F.col("kind")).alias("kind"))
    got = assessment.assessed(["segment"], coverage, rows.where("value > 60").drop("value"), CLAIMS, CRITICALITY)
    return got.withColumns({"score": F.round("score", 6)} | {c: F.array_join(c, ",") for c in ("covered", "contributing", "services")})


def incident_states(spark, sf_dir):
    """A user is an incident, active at a tick with a value above 60; its impact is measured where it has at least two purchases so far."""
    e = _events(spark, sf_dir)
    high = F.col("value") > 60
    ticks = e.groupBy(F.col("user_id").alias("incident"), (F.col("tick") * TICK).alias("at")).agg(F.max(high).alias("active"), F.max(F.when(high, F.col("us"))).alias("seen"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.max("value").alias("top"), F.max(F.when(high, F.col("event_type"))).alias("named"))
    sofar = Window.partitionBy("incident").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ticks = ticks.withColumns({"last_activity": F.max("seen").over(sofar), "bought": F.sum("bought").over(sofar), "top": F.max("top").over(sofar), "named": F.max("named").over(sofar)}).where("last_activity IS NOT NULL")
    impact = F.when(F.col("bought") >= 2, F.least(F.lit(1.0), F.col("top") / 300))
    worst = F.when(F.col("named") == "view", "critical").when(F.col("named") == "signup", "high").when(F.col("named") == "click", "medium")
    return assessment.incident_states(ticks, 2 * DAY).select("incident", "at", "state", assessment.severity(impact, worst, BANDS, FALLBACK).alias("severity"))


def drop_by_rule(spark, sf_dir):
    """What a service did at the tick before is what is expected of it."""
    counts = _events(spark, sf_dir).groupBy(F.col("event_type").alias("stream"), F.col("segment"), F.col("tick").alias("at")).agg(F.count("*").cast("double").alias("observed"))
    before = counts.select("stream", "segment", (F.col("at") + 1).alias("at"), F.col("observed").alias("expected"))
    rules = spark.createDataFrame([("view", 2.0, 0.5, 0.9), ("click", 4.0, 0.3, 0.6), ("error", 1.0, 0.2, 1.0)], "stream string, least double, trigger double, full double")
    got = assessment.drops(counts.join(before, ["stream", "segment", "at"], "left"), rules)
    return got.groupBy("stream", "at").agg(F.round(F.max("fall"), 6).alias("fall"), F.round(F.max("score"), 6).alias("score"), F.count("*").alias("segments"))


def silence_by_rule(spark, sf_dir):
    """Customers are emitters, expected since the tenth day; most are never seen."""
    e = _events(spark, sf_dir)
    seen = e.groupBy(F.col("user_id").alias("emitter")).agg(F.max("us").alias("last_seen"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("emitter"), F.col("c_mktsegment").alias("stream"))
    emitters = customers.join(seen, "emitter", "left").withColumns({"expected_since": F.lit(START + 10 * DAY), "watermark": F.lit(END)})
    rules = spark.createDataFrame([("BUILDING", 3 * DAY, 10 * DAY), ("MACHINERY", 6 * HOUR, 20 * DAY), ("AUTOMOBILE", 30 * DAY, 30 * DAY)], "stream string, most_age long, full_age long")
    return assessment.silences(emitters, rules).withColumn("score", F.round("score", 6))


def fixture_windows(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("fixture_id"), F.col("o_orderstatus").alias("status"), (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY).alias("kickoff"))
    return feeds.fixture_windows(orders, ("O", "F"), HOUR // 4, 2 * HOUR)


def _changes(spark, sf_dir):
    """Changes named by segment and k, so that some come twice, alike or not."""
    e = _numbered(spark, sf_dir).where("event_type IN ('signup', 'purchase')")
    feed = e.select(F.concat_ws(":", "event_type", F.col("tick").cast("string"), F.col("k").cast("string")).alias("change_id"), F.col("event_type").alias("kind"), F.concat(F.lit("w"), (F.col("k") % 4).cast("string")).alias("name"), F.col("tick").alias("ts"), (F.col("user_id") % 2).cast("string").alias("revision"))
    mapping = spark.createDataFrame([("signup", f"w{i}", f"s{i}") for i in range(4)] + [("purchase", "w0", "s9"), ("purchase", "w2", "s9")], "kind string, name string, service string")
    return feeds.changes(feed, mapping)


def change_feed(spark, sf_dir):
    return _changes(spark, sf_dir)[0]


def change_feed_refused(spark, sf_dir):
    return _changes(spark, sf_dir)[1]


def offsets_checked(spark, sf_dir):
    """An event's interval lies k hours after its user's first event, for as many minutes as its value; a run is of 90 hours and has an error in it."""
    e = _numbered(spark, sf_dir)
    anchors = e.groupBy("user_id").agg(F.min("us").alias("anchor"), F.count_if(F.col("event_type") == "error").alias("errors")).where("errors > 0").select("user_id", "anchor", F.lit(90 * HOUR).alias("duration"))
    relative = e.select("user_id", F.col("event_id").alias("id"), ((F.col("k") - 5) * HOUR).alias("offset"), F.floor(F.col("value") * (HOUR // 60)).alias("length"))
    return feeds.absolute(relative, anchors, ["user_id"]).select("id", "start", "end", "problem")


def latest_checked(spark, sf_dir):
    """Episodes of users and kinds in revisions of six hours; their opener is their identity."""
    e = _numbered(spark, sf_dir)
    episodes = e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("tick") / 8).cast("string")).alias("episode_id"), F.col("tick").alias("revision"), (F.col("k") % 9 > 0).alias("opener"), F.col("event_type").alias("state"))
    return feeds.latest_revisions(episodes, ["opener"])


def arrival_counters(spark, sf_dir):
    """Events arrive by id, five hundred at a time; a user's k is what tells them apart."""
    e = _numbered(spark, sf_dir)
    rows = e.select(F.col("event_type").alias("key"), F.concat_ws(":", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("id"), "us", F.floor(F.col("event_id") / 500).alias("batch"), F.col("event_id").alias("place"))
    return ingest.counters(rows, TICK, HOUR)


_CLAIMED = ", ".join(f"('{c.axis}', '{c.kind}', {c.weight}, {repr(c.signals[0]) if c.signals else 'NULL'}, {c.scaled})" for c in CLAIMS)
_K = f"(SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM {EVENTS} e)"
ORACLES = {
    "axis_assessments": f"""WITH claim(axis, kind, weight, signal, scaled) AS (VALUES {_CLAIMED}),
x AS (SELECT segment, tick, event_type, value, {list(KINDS)}[k % 5 + 1] AS kind, if(k % 2 = 0, 'conversion_ratio', 'source_entropy') AS signal FROM {_K}),
spine AS (SELECT DISTINCT segment, tick, axis FROM x CROSS JOIN (SELECT DISTINCT axis FROM claim)),
cov AS (SELECT segment, tick, axis, string_agg(DISTINCT kind, ',' ORDER BY kind) AS covered FROM x JOIN claim USING (kind) WHERE value < 15 GROUP BY ALL),
con AS (SELECT segment, tick, axis, kind, event_type, weight * least(1, value / 200) * CASE WHEN NOT scaled THEN 1 WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 0.7 WHEN event_type = 'purchase' THEN 0.4 ELSE 0 END AS c
  FROM x JOIN claim USING (kind) WHERE value > 60 AND (claim.signal IS NULL OR claim.signal = x.signal)),
f AS (SELECT segment, tick, axis, 1 - product(1 - c) AS score, string_agg(DISTINCT kind, ',' ORDER BY kind) AS contributing, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS services FROM con WHERE c >= 0.05 GROUP BY ALL),
r AS (SELECT segment, tick, axis, coalesce(covered, '') AS covered, CASE WHEN covered IS NOT NULL THEN coalesce(score, 0) END AS score, CASE WHEN covered IS NULL THEN '' ELSE coalesce(contributing, '') END AS contributing, CASE WHEN covered IS NULL THEN '' ELSE coalesce(services, '') END AS services
  FROM spine LEFT JOIN cov USING (segment, tick, axis) LEFT JOIN f USING (segment, tick, axis)),
t AS (SELECT *, score - last_value(score IGNORE NULLS) OVER (PARTITION BY segment, axis ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM r)
SELECT segment, tick, axis, if(score IS NULL, 'INSUFFICIENT', 'SCORED') AS status, round(coalesce(score, 0), 6) AS score, CASE WHEN d IS NULL THEN 'UNKNOWN' WHEN d > 0.05 THEN 'RISING' WHEN d < -0.05 THEN 'FALLING' ELSE 'STEADY' END AS trend, covered, contributing, services FROM t""",
    "incident_states": f"""WITH t AS (SELECT DISTINCT user_id AS incident, tick FROM {EVENTS} e),
s AS (SELECT t.incident, t.tick, bool_or(e.tick = t.tick AND value > 60) AS active, max(us) FILTER (WHERE value > 60) AS last_us, max(e.tick) FILTER (WHERE value > 60) AS last_tick, count(*) FILTER (WHERE event_type = 'purchase') AS bought, max(value) AS top, max(event_type) FILTER (WHERE value > 60) AS named
  FROM t JOIN {EVENTS} e ON e.user_id = t.incident AND e.tick <= t.tick GROUP BY t.incident, t.tick),
q AS (SELECT s.*, (SELECT min(b.tick) FROM t b WHERE b.incident = s.incident AND b.tick > s.last_tick) * {TICK} AS first_quiet FROM s WHERE last_us IS NOT NULL)
SELECT incident, tick * {TICK} AS at, CASE WHEN active THEN 'OPEN' WHEN tick * {TICK} - greatest(first_quiet, last_us) >= {2 * DAY} THEN 'RESOLVED' ELSE 'MONITORING' END AS state,
  CASE WHEN bought < 2 THEN CASE named WHEN 'view' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' ELSE 'LOW' END WHEN top >= 225 THEN 'CRITICAL' WHEN top >= 150 THEN 'HIGH' WHEN top >= 75 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM q""",
    "drop_by_rule": f"""WITH c AS (SELECT event_type, segment, tick, count(*) AS n FROM {EVENTS} e GROUP BY ALL), r(event_type, least_, trigger_, full_) AS (VALUES ('view', 2, 0.5, 0.9), ('click', 4, 0.3, 0.6), ('error', 1, 0.2, 1.0)),
f AS (SELECT c.*, trigger_, full_, CASE WHEN b.n >= least_ THEN greatest(0, b.n - c.n) / b.n END AS fall FROM c LEFT JOIN c b ON b.event_type = c.event_type AND b.segment = c.segment AND b.tick = c.tick - 1 LEFT JOIN r ON r.event_type = c.event_type)
SELECT event_type AS stream, tick AS at, round(max(fall), 6) AS fall, round(max(CASE WHEN fall >= trigger_ THEN least(1, fall / full_) END), 6) AS score, count(*) AS segments FROM f GROUP BY event_type, tick""",
    "silence_by_rule": f"""WITH r(stream, most_age, full_age) AS (VALUES ('BUILDING', {3 * DAY}, {10 * DAY}), ('MACHINERY', {6 * HOUR}, {20 * DAY}), ('AUTOMOBILE', {30 * DAY}, {30 * DAY})),
s AS (SELECT c_custkey AS emitter, c_mktsegment AS stream, greatest({START + 10 * DAY}, coalesce((SELECT max(us) FROM {EVENTS} e WHERE user_id = c_custkey), 0)) AS ref FROM customer)
SELECT stream, CAST(emitter AS BIGINT) AS emitter, CASE WHEN most_age IS NOT NULL THEN {END} - ref END AS age, CASE WHEN {END} - ref >= most_age THEN ref + most_age END AS onset, round(CASE WHEN {END} - ref >= most_age THEN least(1, ({END} - ref) / full_age) END, 6) AS score FROM s LEFT JOIN r USING (stream)""",
    "fixture_windows": "SELECT 'fixture-' || o_orderkey AS context_id, epoch_us(o_orderdate::TIMESTAMP) - 900000000 AS valid_from, epoch_us(o_orderdate::TIMESTAMP) + 7200000000 AS valid_to FROM orders WHERE o_orderstatus IN ('O', 'F')",
    "change_feed": f"""SELECT event_type || ':' || tick || ':' || k AS change_id, event_type AS kind, if(event_type = 'signup', 's' || k % 4, 's9') AS service, tick AS ts, min(user_id % 2)::VARCHAR AS revision
FROM {_K} WHERE event_type IN ('signup', 'purchase') GROUP BY event_type, tick, k HAVING count(DISTINCT user_id % 2) = 1 AND (event_type = 'signup' OR k % 2 = 0)""",
    "change_feed_refused": f"""SELECT event_type || ':' || tick || ':' || k AS change_id, if(count(DISTINCT user_id % 2) > 1, 'conflict', 'unmapped') AS reason
FROM {_K} WHERE event_type IN ('signup', 'purchase') GROUP BY event_type, tick, k HAVING count(DISTINCT user_id % 2) > 1 OR (event_type = 'purchase' AND k % 2 = 1)""",
    "offsets_checked": f"""WITH x AS (SELECT event_id AS id, min(us) OVER (PARTITION BY user_id) AS lo, bool_or(event_type = 'error') OVER (PARTITION BY user_id) AS run, k, CAST(floor(value * {HOUR // 60}) AS BIGINT) AS len FROM {_K}),
y AS (SELECT *, CASE WHEN run THEN lo + (k - 5) * {HOUR} END AS start FROM x)
SELECT id, start, start + len AS "end", CASE WHEN NOT run THEN 'no anchor' WHEN k < 5 OR (k - 5) * {HOUR} + len > {90 * HOUR} THEN 'out of bounds' END AS problem FROM y""",
    "latest_checked": f"""WITH x AS (SELECT user_id || '-' || tick // 8 AS episode_id, tick AS revision, k % 9 > 0 AS opener, event_type AS state FROM {_K}),
a AS (SELECT episode_id, count(DISTINCT opener) AS openers, max(revision) AS newest FROM x GROUP BY episode_id),
b AS (SELECT episode_id, max(n) AS most FROM (SELECT episode_id, revision, count(DISTINCT (opener, state)) AS n FROM x GROUP BY ALL) GROUP BY episode_id)
SELECT DISTINCT ON (x.episode_id) x.*, CASE WHEN openers > 1 THEN 'identity' WHEN most > 1 THEN 'payload' END AS problem FROM x JOIN a ON a.episode_id = x.episode_id AND a.newest = x.revision JOIN b ON b.episode_id = x.episode_id ORDER BY x.episode_id, x.opener, x.state""",
    "arrival_counters": f"""WITH x AS (SELECT event_type AS key, event_id // 500 AS batch, us, event_id, tick, row_number() OVER (PARTITION BY event_type, user_id, k ORDER BY event_id) > 1 AS again FROM {_K}),
b AS (SELECT DISTINCT key, batch FROM x),
m AS (SELECT b.*, (SELECT max(us) FROM x WHERE x.key = b.key AND x.batch < b.batch) - {HOUR} AS was, (SELECT max(us) FROM x WHERE x.key = b.key AND x.batch <= b.batch) - {HOUR} AS now, (SELECT min(tick) FROM x WHERE x.key = b.key AND x.batch = (SELECT min(batch) FROM b c WHERE c.key = b.key)) AS first FROM b)
SELECT key, batch, count(*) AS rows, count(*) FILTER (WHERE NOT again AND coalesce(tick >= was // {TICK}, true)) AS accepted, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE NOT again AND tick < was // {TICK}) AS late,
  greatest(max(now) // {TICK}, max(first)) - greatest(coalesce(max(was) // {TICK}, max(first)), max(first)) AS closed FROM x JOIN m USING (key, batch) GROUP BY key, batch""",
}
QUERIES = {name: (globals()[name], sql) for name, sql in ORACLES.items()}
