"""Queries of outcomes, paths and the breaker; purchases ask, the user's type of events are services, their values improvements."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import guards
from .queries import EVENTS, HOUR, _events


def rpc_outcomes(spark, sf_dir):
    """Statuses by event number: codes, words, and numbers that are no codes."""
    e = _events(spark, sf_dir)
    call = F.element_at(F.array(*map(F.lit, ("0", "0", "13", "255", "256", "-1", "1x", ""))), (F.col("event_id") % 8 + 1).cast("int"))
    span = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("0", "1", "2", "x"))), (F.col("user_id") % 5 + 1).cast("int"))
    kind, traces = F.when(F.col("event_id") % 13 == 0, "2").otherwise("3"), F.when(F.col("event_id") % 17 == 0, 2).otherwise(1)
    return e.select("event_id", guards.rpc_outcome(kind, traces, F.col("value") - 1, call, span).alias("outcome"))


def url_paths(spark, sf_dir):
    """Pages' addresses, six of seven changed: a user, a fragment, ports, no path, another scheme."""
    u = F.col("url")
    kinds = [F.replace(u, F.lit("://"), F.lit("://me@")), F.concat(u, F.lit("#top")), F.regexp_replace(u, "^(https?://[^/]*)/", "$1:99999/"), F.regexp_replace(u, "^(https?://[^/]*)/", "$1:8080/"), F.regexp_extract(u, "^https?://[^/]*", 0), F.concat(F.lit("ftp"), F.substring(u, 5, 1 << 30))]
    asked = u
    for i, k in enumerate(kinds, 1):
        asked = F.when(F.col("page_id") % 7 == i, k).otherwise(asked)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", guards.http_path(asked).alias("path"))


def breaker_states(spark, sf_dir):
    e = _events(spark, sf_dir)
    actions = e.where("event_type IN ('error', 'signup', 'click')").select(F.col("event_id").alias("id"), "us", F.col("event_type").alias("service"), F.when(F.col("event_id") % 4 != 0, F.col("value") / 100).alias("improvement"))
    asked = e.where("event_type = 'purchase'").select(F.col("event_id").alias("ask_id"), F.col("us").alias("at"))
    return guards.breaker(asked, actions, 4 * HOUR, 9, 2, 0.2)


ORACLES = {
    "rpc_outcomes": """WITH x AS (SELECT event_id, value - 1 AS latency, ['0', '0', '13', '255', '256', '-1', '1x', ''][event_id % 8 + 1] AS call, [NULL, '0', '1', '2', 'x'][user_id % 5 + 1] AS span FROM events),
y AS (SELECT *, CASE WHEN call IN ('0', '13', '255') THEN CAST(call AS INT) END AS code FROM x)
SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 OR latency < 0 OR code IS NULL THEN NULL WHEN span = '1' AND code <> 0 OR span = '2' AND code = 0 THEN NULL WHEN code = 0 THEN 'ok' ELSE 'failed' END AS outcome FROM y""",
    "url_paths": """SELECT page_id, CASE WHEN page_id % 7 IN (1, 2, 3, 5, 6) OR strpos(url, '#') BETWEEN 1 AND length(url) - 1 OR url LIKE '%://%@%' THEN NULL WHEN url LIKE 'http://%/%' OR url LIKE 'https://%/%' THEN nullif('/' || split_part(split_part(substr(url, strpos(url, '://') + 3 + strpos(substr(url, strpos(url, '://') + 3), '/')), '?', 1), '#', 1), '') END AS path FROM pages""",
    "breaker_states": f"""WITH a AS MATERIALIZED (SELECT event_id AS id, us, event_type AS service, CASE WHEN event_id % 4 <> 0 THEN value / 100 END AS gain FROM {EVENTS} WHERE event_type IN ('error', 'signup', 'click')),
m AS MATERIALIZED (SELECT p.event_id AS ask_id, a.* FROM {EVENTS} p LEFT JOIN a ON a.us > p.us - {4 * HOUR} AND a.us <= p.us WHERE p.event_type = 'purchase'),
w AS (SELECT ask_id, min(service) AS service FROM (SELECT ask_id, service, list(gain ORDER BY us DESC, id DESC)[1:2] AS last FROM m WHERE gain IS NOT NULL GROUP BY ask_id, service) WHERE len(last) = 2 AND last[1] < 0.2 AND last[2] < 0.2 GROUP BY ask_id)
SELECT c.ask_id, recent, CASE WHEN recent >= 9 THEN 'RATE' WHEN service IS NOT NULL THEN 'INEFFECTIVE' END AS tripped, CASE WHEN recent < 9 THEN service END AS service FROM (SELECT ask_id, count(id) AS recent FROM m GROUP BY ask_id) c LEFT JOIN w USING (ask_id)""",
}
QUERIES = {name: (globals()[name], sql) for name, sql in ORACLES.items()}
