"""Queries of grades and runs, each with SQL of its own that follows the definition.  A user is a run, an event an episode of the kind ``event_type``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import grading
from .capture_queries import DAY, HALF
from .queries import EVENTS, HOUR, _events

CALLS = [("view", "click"), ("click", "purchase"), ("purchase", "error")]
KINDS = ["view", "click", "purchase", "error", "signup"]


def score_separation(spark, sf_dir):
    """Errors against the rest by user and rounded value, so that scores tie."""
    e = _events(spark, sf_dir).select("user_id", F.floor("value").alias("score"), (F.col("event_type") == "error").alias("positive"))
    return grading.separation(e, ["user_id"]).withColumns({c: F.round(c, 6) for c in ("auc", "positive_mean", "negative_mean", "gap")})


def score_headline(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("kind"), F.when(F.col("value") > 20, F.col("event_id")).alias("symptom"), F.when(F.col("user_id") % 3 > 0, F.col("event_id")).alias("label"), F.col("value").alias("latency"))
    return grading.headline(e, ["view", "click", "error"]).withColumn("least_recall", F.round("least_recall", 6))


def _bounds(spark, sf_dir):
    """Markers are signups up to the 17th day, correlated spans errors from the 16th day on; a run lasts ten days."""
    e = _events(spark, sf_dir)
    known = (F.col("event_type") == "signup") & (F.col("us") < HALF + DAY) | (F.col("event_type") == "error") & (F.col("us") >= HALF)
    spans = e.where(known).select(F.col("user_id").alias("run"), F.col("us").alias("at"), (F.col("event_type") == "signup").alias("marker"))
    users = e.select(F.col("user_id").alias("run")).distinct()
    return grading.run_bounds(spans, users.withColumn("duration", F.lit(240 * HOUR)))


def checked_run_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir)


def run_offsets(spark, sf_dir):
    episodes = _events(spark, sf_dir).select(F.col("user_id").alias("run"), "event_id", F.col("us").alias("opened"), (F.col("us") + HOUR).alias("closed"))
    return grading.characterised(episodes, _bounds(spark, sf_dir), ["opened", "closed"])


def run_kinds(spark, sf_dir):
    episodes = _events(spark, sf_dir).where("value > 50").select(F.col("user_id").alias("run"), F.col("event_type").alias("kind"))
    return grading.counts_by_kind(episodes, _bounds(spark, sf_dir), KINDS)


def episode_adjacency_pairs(spark, sf_dir):
    """Values above 100 are episodes; half an hour apart is near."""
    e = _events(spark, sf_dir).where("value > 100").select(F.col("event_id").alias("id"), F.col("event_type").alias("service"), F.col("us").alias("opened"))
    return grading.adjacent(e, spark.createDataFrame(CALLS, "a string, b string"), HOUR // 2)


_BOUNDS = f"""b AS (SELECT user_id AS run, max(us) FILTER (WHERE event_type = 'signup' AND us < {HALF + DAY}) AS anchor, min(us) FILTER (WHERE event_type = 'error' AND us >= {HALF}) AS first, CASE WHEN first IS NULL THEN 'no spans' WHEN anchor IS NULL THEN 'no marker' WHEN anchor > first THEN 'anchor after first span' END AS problem
  FROM {EVENTS} e GROUP BY user_id)"""
ORACLES = {
    "score_separation": """WITH x AS (SELECT user_id, floor(value) AS s, event_type = 'error' AS p FROM events WHERE value IS NOT NULL),
w AS (SELECT a.user_id, avg(CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS auc FROM x a JOIN x b ON a.user_id = b.user_id AND a.p AND NOT b.p GROUP BY a.user_id)
SELECT user_id, count(*) AS n, round(max(auc), 6) AS auc, round(avg(s) FILTER (WHERE p), 6) AS positive_mean, round(avg(s) FILTER (WHERE NOT p), 6) AS negative_mean, round(avg(s) FILTER (WHERE p) - avg(s) FILTER (WHERE NOT p), 6) AS gap FROM x LEFT JOIN w USING (user_id) GROUP BY user_id""",
    "score_headline": """WITH x AS (SELECT event_type, value > 20 AS s, user_id % 3 > 0 AS l, value FROM events WHERE event_type IN ('view', 'click', 'error')),
h AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM x WHERE s AND l), k AS (SELECT count(*) FILTER (WHERE s AND l) / count(*) FILTER (WHERE l) AS recall FROM x GROUP BY event_type)
SELECT 'OK' AS recall_status, (SELECT round(min(recall), 6) FROM k) AS least_recall, 'OK' AS latency_status, value AS p95, n AS matched FROM h WHERE i = ceil(0.95 * n)""",
    "checked_run_bounds": f"WITH {_BOUNDS} SELECT run, anchor, first, CASE WHEN problem IS NULL THEN anchor + {240 * HOUR} END AS \"end\", problem FROM b",
    "run_offsets": f"WITH {_BOUNDS} SELECT run, event_id, us - anchor AS opened, us - anchor + {HOUR} AS closed FROM {EVENTS} e JOIN b ON b.run = e.user_id WHERE problem IS NULL",
    "run_kinds": f"WITH {_BOUNDS} SELECT run, kind, (SELECT count(*) FROM events e WHERE e.user_id = run AND e.event_type = kind AND e.value > 50) AS n FROM b CROSS JOIN (SELECT unnest({KINDS}) AS kind) WHERE problem IS NULL",
    "episode_adjacency_pairs": f"""WITH x AS (SELECT event_id, event_type, us FROM {EVENTS} e WHERE value > 100), h(a, b) AS (VALUES {", ".join(map(str, CALLS))})
SELECT x.event_id AS earlier, y.event_id AS later, y.us - x.us AS apart FROM x JOIN x y ON y.us - x.us BETWEEN 0 AND {HOUR // 2} AND (y.us > x.us OR y.event_id > x.event_id)
WHERE x.event_type = y.event_type OR EXISTS (SELECT 1 FROM h WHERE (a = x.event_type AND b = y.event_type) OR (b = x.event_type AND a = y.event_type))""",
}
QUERIES = {name: (globals()[name], sql) for name, sql in ORACLES.items()}
