"""Queries of captures, runs and adaptive drift, each with SQL of its own that follows the definition.

Events are the messages: eight partitions of one topic, ids dealt to them in turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import captures, otlp
from . import monitors, runs
from .queries import EVENTS, HOUR, _events

DAY = 24 * HOUR
#: A context lifts these ticks; the run's two halves are of 15 days, from 2024-01-01 and 2024-01-16.
LIFTED = (78912, 78940)
HALF = 1_705_363_200_000_000
START, END = HALF - 15 * DAY, HALF + 15 * DAY


def _messages(spark, sf_dir):
    placed = [F.lit("obs").alias("topic"), (F.col("event_id") % 8).cast("int").alias("partition"), F.floor(F.col("event_id") / 8).alias("offset")]
    return _events(spark, sf_dir).select(*placed, F.when(F.length("props") > 8, F.col("props")).cast("binary").alias("value"), "event_type", "us")


def _snapshots(spark, sf_dir):
    """The position of each partition at two times; one that has none yet is missing from the first."""
    m = _messages(spark, sf_dir)
    newest = F.max("offset").alias("offset")
    return m.where("event_type = 'signup'").groupBy("topic", "partition").agg(newest), m.where("event_type = 'purchase'").groupBy("topic", "partition").agg(newest)


def capture_bounds(spark, sf_dir):
    return captures.bounds_between(*_snapshots(spark, sf_dir))


def capture_gaps(spark, sf_dir):
    """Errors are what the capture lost."""
    m = _messages(spark, sf_dir)
    bounds = m.groupBy("topic", "partition").agg(F.min("offset").alias("start_offset"), (F.max("offset") + 1).alias("end_offset"), F.lit(None).cast("string").alias("problem"))
    return captures.capture_gaps(m.where("event_type <> 'error'"), bounds, block=64)


def snapshot_checksum(spark, sf_dir):
    """Documents with an embedding against a manifest of all documents whose sizes are in characters."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = d.select("doc_id", F.col("lang").alias("topic"), F.lit(0).alias("partition"), F.col("doc_id").alias("offset"), F.col("text").cast("binary").alias("value"), F.length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    embedded = placed.join(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return captures.checked(embedded, placed).select("topic", "partition", "offset", F.coalesce("problem", F.lit("ok")).alias("problem"))


def _sent(spark, sf_dir):
    """Log envelopes in the place of their message; errors send their bare properties."""
    placed = _messages(spark, sf_dir).select("topic", "partition", "offset", (F.col("offset") * 8 + F.col("partition")).alias("event_id"))
    bare = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props")
    sent = otlp.envelopes(spark, sf_dir, "logs").join(placed, "event_id").join(bare, "event_id")
    return sent.select("topic", "partition", "offset", F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("payload")).cast("binary").alias("value"))


def replay_batch(spark, sf_dir):
    seen, _ = captures.replayed(_sent(spark, sf_dir), otlp.logs, "resourceLogs", ["service", "body"])
    return seen.select("service", "body", "partition", "offset")


def replay_dead_letters(spark, sf_dir):
    return captures.replayed(_sent(spark, sf_dir), otlp.logs, "resourceLogs", ["service", "body"])[1]


def bus_encode_decode(spark, sf_dir):
    """Users by last digit are signals; values from 90 on are not sent, and messages of errors lose their last character."""
    e = _events(spark, sf_dir)
    sent = captures.bus_messages(e.select(F.col("event_type").alias("service"), (F.col("user_id") % 10).cast("string").alias("signal"), "us", F.when(F.col("value") < 90, F.col("value")).alias("value")))
    cut = sent.withColumn("value", F.when(F.col("key").startswith("error"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))
    got = captures.bus_observations(cut, "service string, signal string, us long, value double", ["us", "value"])
    return got.groupBy("key").agg(F.count_if("decoded").alias("decoded"), F.count_if(~F.col("decoded")).alias("undecodable"), F.round(F.sum(F.when(F.col("decoded"), F.col("value"))), 3).alias("total"))


def telemetry_completeness(spark, sf_dir):
    """The plan: two phases of each service, both at the rate of the first ten days."""
    e = _events(spark, sf_dir)
    early = e.where(F.col("us") < START + 10 * DAY).groupBy("event_type").agg((F.count("*") / (10 * DAY / 1e6)).alias("rate"))
    phases = [F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((START, HALF), (HALF, END))]
    plan = early.select("event_type", "rate", F.explode(F.array(*phases)).alias("p")).select("event_type", "rate", "p.*")
    return runs.completeness(e, plan, ["event_type"]).withColumns({"expected": F.round("expected", 4), "completeness": F.round("completeness", 6)})


def golden_diff(spark, sf_dir):
    """The second half of the run against the first: service, user and day since the half began."""
    e = _events(spark, sf_dir)
    first = runs.transcript(e.where(F.col("us") < HALF), F.lit(START), "us", DAY, ["event_type", "user_id"])
    second = runs.transcript(e.where(F.col("us") >= HALF), F.lit(HALF), "us", DAY, ["event_type", "user_id"])
    return runs.transcript_diff(second, first)


def envelope_backoff(spark, sf_dir):
    e = _events(spark, sf_dir).withColumns({"quarter": F.col("tick") % 4, "weekend": (F.floor(F.col("tick") / 4) + 3) % 7 >= 5, "lifted": (F.col("tick") >= LIFTED[0]) & (F.col("tick") < LIFTED[1])})
    got = runs.envelopes(e, "event_type", ["quarter", "weekend", "lifted"], "value", least=40)
    return got.withColumns({c: F.round(c, 6) for c in ("q10", "q50", "q90", "blind_q90", "event_part")})


def drift_adaptive(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("stream"), F.col("us").alias("at"), F.col("event_id").alias("id"), "value")
    return monitors.adaptive_drift(e).withColumn("mean", F.round("mean", 6))


_PLACED = f"SELECT 'obs' AS topic, CAST(event_id % 8 AS INTEGER) AS partition, event_id // 8 AS offset_, * FROM {EVENTS} e"
ORACLES = {
    "capture_bounds": f"""WITH m AS ({_PLACED}) SELECT 'obs' AS topic, partition, max(offset_) FILTER (WHERE event_type = 'signup') AS start_offset, max(offset_) FILTER (WHERE event_type = 'purchase') AS end_offset,
  CASE WHEN start_offset IS NULL OR end_offset IS NULL THEN 'partition changed' WHEN start_offset > end_offset THEN 'moved backwards' END AS problem FROM m WHERE event_type IN ('signup', 'purchase') GROUP BY partition""",
    "capture_gaps": f"""WITH m AS ({_PLACED}), edge AS (SELECT partition, min(offset_) AS lo, max(offset_) AS hi FROM m GROUP BY partition),
wanted AS (SELECT partition, lo, unnest(range(lo, hi + 1)) AS offset_ FROM edge),
s AS (SELECT w.*, m.event_id IS NULL AS lost, m.event_id IS NOT NULL AND length(m.props) <= 8 AS blank FROM wanted w LEFT JOIN m ON m.partition = w.partition AND m.offset_ = w.offset_ AND m.event_type <> 'error')
SELECT 'obs' AS topic, partition, greatest(min(lo), offset_ // 64 * 64) AS first_offset, count(*) FILTER (WHERE lost) AS missing, min(offset_) FILTER (WHERE lost) AS first_missing, count(*) FILTER (WHERE blank) AS empty
FROM s GROUP BY partition, offset_ // 64 HAVING bool_or(lost OR blank)""",
    "snapshot_checksum": """SELECT lang AS topic, 0 AS partition, doc_id AS "offset", CASE WHEN doc_id NOT IN (SELECT vec_id FROM embeddings) THEN 'missing' WHEN strlen(text) <> length(text) THEN 'size' ELSE 'ok' END AS problem FROM documents""",
    "replay_batch": """SELECT event_type AS service, props AS body, CAST(min(event_id % 8 * 1000000000000 + event_id) // 1000000000000 AS INTEGER) AS partition, min(event_id % 8 * 1000000000000 + event_id) % 1000000000000 // 8 AS "offset"
FROM events WHERE event_type <> 'error' GROUP BY event_type, props""",
    "replay_dead_letters": """SELECT 'obs' AS topic, CAST(event_id % 8 AS INTEGER) AS partition, event_id // 8 AS "offset", sha256(props) AS sha256 FROM events WHERE event_type = 'error'""",
    "bus_encode_decode": """SELECT event_type || chr(31) || user_id % 10 AS key, count(*) FILTER (WHERE event_type <> 'error' AND value < 90) AS decoded, count(*) FILTER (WHERE event_type = 'error' OR coalesce(value >= 90, true)) AS undecodable,
  round(sum(value) FILTER (WHERE event_type <> 'error' AND value < 90), 3) AS total FROM events GROUP BY 1, event_type""",
    "telemetry_completeness": f"""WITH t AS (SELECT event_type, count(*) AS actual, 3 * count(*) FILTER (WHERE us < {START + 10 * DAY}) AS expected FROM {EVENTS} e GROUP BY event_type)
SELECT event_type, actual, CAST(expected AS DOUBLE) AS expected, round(actual / expected, 6) AS completeness FROM t""",
    "golden_diff": f"""WITH a AS (SELECT (us - {HALF}) // {DAY} AS step, event_type, user_id FROM {EVENTS} e WHERE us >= {HALF}), b AS (SELECT CAST(floor((us - {START}) / {DAY}) AS BIGINT) AS step, event_type, user_id FROM {EVENTS} e WHERE us < {HALF})
SELECT 'added' AS side, *, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT 'missing', *, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""",
    "envelope_backoff": f"""WITH s AS (SELECT event_type, tick % 4 AS quarter, (tick // 4 + 3) % 7 >= 5 AS weekend, tick BETWEEN {LIFTED[0]} AND {LIFTED[1] - 1} AS lifted, value FROM {EVENTS} e WHERE value IS NOT NULL),
g AS (SELECT event_type, quarter, weekend, lifted, count(*) AS n, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90, 3 - GROUPING(quarter) - GROUPING(weekend) - GROUPING(lifted) AS level
  FROM s GROUP BY GROUPING SETS ((event_type), (event_type, quarter), (event_type, quarter, weekend), (event_type, quarter, weekend, lifted))),
c AS (SELECT event_type, quarter, weekend, lifted, n FROM g WHERE level = 3 AND event_type IN (SELECT event_type FROM g WHERE level = 0 AND n >= 200)),
m AS (SELECT c.*, g.level, g.q10, g.q50, g.q90 FROM c JOIN g ON g.event_type = c.event_type AND (g.level < 1 OR g.quarter = c.quarter) AND (g.level < 2 OR g.weekend = c.weekend) AND (g.level < 3 OR g.lifted = c.lifted) AND (g.level = 0 OR g.n >= 40))
SELECT event_type, quarter, weekend, lifted, n, CAST(max(level) AS INTEGER) AS level, round(arg_max(q10, level), 6) AS q10, round(arg_max(q50, level), 6) AS q50, round(arg_max(q90, level), 6) AS q90,
  round(arg_max(q90, level) FILTER (WHERE level < 3), 6) AS blind_q90, round(greatest(0, arg_max(q90, level) - arg_max(q90, level) FILTER (WHERE level < 3)), 6) AS event_part FROM m GROUP BY ALL""",
}
QUERIES = {name: (globals()[name], sql) for name, sql in ORACLES.items()} | {"drift_adaptive": (drift_adaptive, None)}
