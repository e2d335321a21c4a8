"""Queries that call the parameterised operators, each with SQL of its own that follows the definition and shares no text with them.

An event is an observation or a call of the service ``event_type`` by segment ``user_id % 3``; ticks are six hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chains, graph, ingest, intervals, lifecycle, memory, selection, templates

HOUR = 3_600_000_000
TICK = 6 * HOUR
POLICIES = [("view", 0.5, 0.2, 2, 2, "skip"), ("click", 0.5, 0.3, 1, 2, "hold"), ("purchase", 0.45, 0.25, 2, 1, "hold"), ("error", 0.4, 0.3, 3, 1, "skip")]
ATTENTION = {"WATCH": 0, "ASK": 1, "HOLD": 2, "ACT": 3}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.withColumn("us", us).withColumns({"tick": F.floor(F.col("us") / TICK), "segment": F.col("user_id") % 3})


def _scored(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("event_type", "segment", "tick").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("mean") - 20) / 60))
    return e.select(F.concat("event_type", F.lit("-"), "segment").alias("stream"), F.col("event_type").alias("kind"), "tick", F.when(score >= 0.05, score).alias("score"), (F.col("n") >= 2).alias("sufficient"))


def _policies(spark):
    return spark.createDataFrame(POLICIES, "kind string, breach double, clear double, open_after int, close_after int, gap string")


def episode_transitions(spark, sf_dir):
    return lifecycle.transitions(_scored(spark, sf_dir), _policies(spark)).withColumns({"score": F.round("score", 6), "peak": F.round("peak", 6)})


def episode_lifecycle(spark, sf_dir):
    return lifecycle.lifecycle(_scored(spark, sf_dir), _policies(spark)).withColumn("peak", F.round("peak", 6))


def _signatures(spark, sf_dir):
    e = _events(spark, sf_dir)
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    return e.groupBy(F.col("tick").alias("id")).agg(F.array(*(share(k) for k in ("view", "click", "purchase", "error"))).alias("vector"))


def signature_knn(spark, sf_dir):
    s = _signatures(spark, sf_dir)
    return memory.signature_knn(s, s, 4).withColumn("similarity", F.round("similarity", 6))


def recognised_confidence(spark, sf_dir):
    s = _signatures(spark, sf_dir)
    verdicts = s.select("id", F.col("vector")[0].alias("confidence"))
    return memory.nudged(verdicts, memory.signature_knn(s, s, 4)).withColumns({"confidence": F.round("confidence", 6), "best": F.round("best", 6)})


def _entries(spark, sf_dir):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_custkey").alias("chain"), seq.cast("long").alias("seq"), F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("content"))


def audit_chain_build(spark, sf_dir):
    return chains.build_chains(_entries(spark, sf_dir))


def audit_chain_breaks(spark, sf_dir):
    """Chains in which each customer's dearest order was altered afterwards: the break is found where it is."""
    built = chains.build_chains(_entries(spark, sf_dir))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dear = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("key")).select(F.col("o_custkey").alias("chain"), F.col("key").cast("string").alias("key"))
    changed = F.when(F.substring_index("content", "|", 1) == F.col("key"), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return chains.verify_chains(built.join(dear, "chain").withColumn("content", changed).drop("key"))


def _calls_graph(spark, sf_dir):
    """Who follows whom: an edge from the service and cell of a dear event to those of the user's next one."""
    from pyspark.sql import Window

    e = _events(spark, sf_dir).where("value > 150")
    node = F.concat("event_type", F.lit("/"), F.floor(F.col("us") / (8 * HOUR)).cast("string"))
    after = F.lead(node).over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return e.select(node.alias("source"), after.alias("target")).where("target IS NOT NULL AND source <> target").distinct()


def graph_hops(spark, sf_dir):
    return graph.reach(_calls_graph(spark, sf_dir), directed=False).groupBy("source").agg(F.count("*").alias("reached"), F.max("hops").alias("farthest"), F.sum("hops").alias("hops"))


def graph_dependents_all(spark, sf_dir):
    return graph.reach(_calls_graph(spark, sf_dir)).groupBy("target").agg(F.count("*").alias("dependents"), F.max("hops").alias("farthest"))


def causal_graph_nodes(spark, sf_dir):
    e = _events(spark, sf_dir)
    node = F.concat("event_type", F.lit("-"), "segment")
    episodes = e.where("value > 100").select(node.alias("node"), F.when(F.col("value") > 200, "saturation").otherwise("latency").alias("kind"), F.col("value").alias("peak"), (F.col("value") > 150).alias("active"))
    return graph.node_heat(e.select(node.alias("node")).distinct(), episodes)


def causal_graph_edges(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.concat(F.lit("seg"), "segment").alias("source"), F.col("event_type").alias("target"), "value")
    return graph.edge_evidence(e.select("source", "target").distinct(), e.where("value > 150").withColumnRenamed("value", "peak"))


def contexts_as_of(spark, sf_dir):
    e = _events(spark, sf_dir)
    contexts = e.where("event_type = 'signup'").select(F.col("event_id").alias("context_id"), F.col("us").alias("valid_from"), (F.col("us") + 2 * HOUR).alias("valid_to"))
    decisions = e.where("event_type = 'purchase'").select(F.col("event_id").alias("decision_id"), F.col("us").alias("at"))
    got = intervals.contexts_as_of(decisions, contexts, 2 * HOUR)
    return got.select("decision_id", F.size("contexts").cast("long").alias("n"), F.array_join(F.col("contexts").cast("array<string>"), ",").alias("contexts"))


def judgement_window_join(spark, sf_dir):
    """Judgements of a day and segment against windows of an hour around dear errors: overlap, and a service in common."""
    e = _events(spark, sf_dir)
    services = F.array(F.concat(F.lit("seg"), "segment"), F.concat(F.lit("user"), F.col("user_id") % 10)).alias("services")
    judged = e.where("event_type = 'purchase'").select(F.col("event_id").alias("l_id"), (F.col("us") - HOUR).alias("l_start"), F.col("us").alias("l_end"), services)
    windows = e.where("event_type = 'error' AND value > 100").select(F.col("event_id").alias("r_id"), (F.col("us") - HOUR).alias("r_start"), (F.col("us") + HOUR).alias("r_end"), services)
    return intervals.meetings(judged, windows, 2 * HOUR).select(F.col("l_id").alias("judgement"), F.col("r_id").alias("window"))


def suppression_windows(spark, sf_dir):
    e = _events(spark, sf_dir)
    action = F.when(F.col("value") > 80, "ACT").when(F.col("value") > 40, "HOLD").when(F.col("value") > 20, "ASK").otherwise("WATCH")
    decisions = e.where("event_type = 'purchase'").select(F.col("event_id").alias("decision_id"), F.col("us").alias("at"), F.array("event_type", F.concat(F.lit("seg"), "segment")).alias("services"), F.when(F.col("user_id") % 2 == 0, "SURGE").otherwise("FAULT").alias("class"), action.alias("action"))
    windows = e.where("event_type = 'signup'").select(
        F.col("event_id").alias("window_id"), F.col("us").alias("start"), (F.col("us") + HOUR).alias("end"), F.when(F.col("value") > 60, "CHANGE_FREEZE").otherwise("MAINTENANCE").alias("kind"),
        F.when(F.col("value") > 60, F.array(F.concat(F.lit("seg"), "segment"))).otherwise(F.array(F.lit("purchase"), F.concat(F.lit("seg"), "segment"))).alias("window_services"), F.array(F.lit("SURGE")).alias("classes"), F.lit("WATCH").alias("most"),
    )
    return intervals.suppressed(decisions, windows, ATTENTION, HOUR).select("decision_id", "action", "applied", "final")


def path_entropy(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select(F.regexp_extract("url", "^https?://[^/]*[.]([a-z]+)/", 1).alias("zone"), F.regexp_extract("url", "^https?://[^/]*/([^/?#]*)", 1).alias("path"))
    return selection.entropy(rows, ["zone"], "path", 6)


def crowd_coherence(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("user_id", "tick").agg(F.sum((F.col("event_type") == "view").cast("double")).alias("views"), F.sum((F.col("event_type") == "click").cast("double")).alias("clicks"))
    return selection.coherence(e, ["user_id"], "views", "clicks", 3)


def top2_per_group(spark, sf_dir):
    e = _events(spark, sf_dir)
    return selection.best_of(e, ["user_id"], [F.desc("value"), F.asc("event_id")], 2).select("user_id", "rank", "event_id", "value")


def first_acting_outcome(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'purchase' AND value > 50")
    return selection.best_of(e, ["user_id"], [F.asc("us"), F.asc("event_id")]).select("user_id", "event_id", "us")


def select_strongest(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("event_type", "tick", "user_id").agg(F.count("*").alias("strength"), F.max("value").alias("score"), F.min("us").alias("onset"))
    return selection.best_of(e, ["event_type", "tick"], [F.desc("strength"), F.desc("score"), F.asc("onset"), F.asc("user_id")]).select("event_type", "tick", "user_id", "strength", "score", "onset")


def edge_sliding_window(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("segment").alias("caller"), F.col("event_type").alias("service"), "us", "value", (F.col("value") > 150).alias("failed"))
    return selection.sliding_edges(e, 12 * HOUR, 2 * HOUR)


def edge_p95_error_rate(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy(F.col("segment").alias("caller"), F.col("event_type").alias("service"), "tick").agg(F.count("*").alias("calls"), selection.nearest_rank("value", 0.95).alias("p95"), F.round(F.avg((F.col("value") > 150).cast("double")), 6).alias("error_rate"))


def _lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("source", F.explode(F.split("text", "\n")).alias("line"), F.col("doc_id").alias("ref"))


def template_frequency(spark, sf_dir):
    return selection.template_frequency(_lines(spark, sf_dir), ["source"])


def log_template_merge(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit("")))
    return templates.line_templates(lines, ["source"])


def slo_before_after(spark, sf_dir):
    e = _events(spark, sf_dir)
    windows = e.groupBy(F.col("segment").alias("service"), "tick").agg((1 - F.avg((F.col("event_type") == "error").cast("double"))).alias("availability"))
    actions = e.where("event_type = 'signup'").select(F.col("event_id").alias("action_id"), F.explode(F.array(F.col("segment"), (F.col("segment") + 1) % 3)).alias("service"), "tick")
    return selection.restored(windows, actions)


def security_timeline(spark, sf_dir):
    e = _events(spark, sf_dir)
    members = e.select(F.col("user_id").alias("incident_id"), F.col("event_id").alias("episode_id"), F.col("event_type").alias("kind"), F.col("us").alias("ts"))
    cites = e.where("value > 100").groupBy(F.col("user_id").alias("incident_id"), "tick").agg(F.collect_list("event_id").alias("refs"))
    return selection.cited(members, cites, ["error", "signup"]).select("incident_id", "place", "episode_id", "kind", "ts")


def envelope_rejection(spark, sf_dir):
    e = _events(spark, sf_dir)
    why = F.when(F.col("value") < 1, "value too small").when(F.col("value") > 400, "value too large")
    return ingest.split_envelopes(e, ["user_id", "tick"], why, "props")[1]


def envelope_accepted(spark, sf_dir):
    e = _events(spark, sf_dir)
    why = F.when(F.col("value") < 1, "value too small").when(F.col("value") > 400, "value too large")
    return ingest.split_envelopes(e, ["user_id", "tick"], why, "props")[0].groupBy("event_type").agg(F.count("*").alias("n"))


def ingress_filter(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", (F.col("user_id") % 4).alias("kind"), F.col("event_type").alias("source_name"))
    services = e.select("source_name").where("source_name <> 'signup'").distinct().withColumn("service", F.concat(F.lit("shop-"), "source_name"))
    return ingest.server_spans(e, services).groupBy("service").agg(F.count("*").alias("spans"))


def unit_homogeneity(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("unit", F.when(F.col("value") > 450, "s").otherwise("ms"))
    return ingest.unit_checked(e, ["event_type", "tick"])


def normalised_key_guard(spark, sf_dir):
    e = _events(spark, sf_dir)
    key = F.concat(F.upper("event_type"), F.lit("_"), F.col("user_id") % 5)
    return e.select("event_id", ingest.leaks(F.create_map(key, F.lit(1)), ["error1", "signup2"]).alias("leaks"))


EVENTS = "(SELECT *, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) AS tick, user_id % 3 AS segment FROM events)"
SIGNATURES = f"(SELECT tick AS id, avg((event_type = 'view')::INT) AS a, avg((event_type = 'click')::INT) AS b, avg((event_type = 'purchase')::INT) AS c, avg((event_type = 'error')::INT) AS d FROM {EVENTS} GROUP BY tick)"
KNN = f"""(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank FROM (
  SELECT x.id, y.id AS neighbour, 1 - sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2) / sqrt(4) AS similarity FROM {SIGNATURES} x, {SIGNATURES} y WHERE x.id <> y.id) WHERE similarity >= 0.9) WHERE rank <= 3)"""
ENTRIES = "(SELECT o_custkey AS chain, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority AS content, o_orderkey, o_totalprice FROM orders)"
#: The state machine tick by tick: consecutive breaches and clears, open or not, first tick and peak of the pending run.
MACHINE = f"""WITH RECURSIVE policy(kind, breach, clear, open_after, close_after, gap) AS (VALUES {", ".join(map(str, POLICIES))}),
raw AS (SELECT event_type || '-' || segment AS stream, event_type AS kind, tick, least(1.0, greatest(0.0, (avg(value) - 20) / 60)) AS s, count(*) >= 2 AS sufficient FROM {EVENTS} GROUP BY event_type, segment, tick),
t AS (SELECT stream, tick, CASE WHEN s >= 0.05 THEN s END AS score, open_after, close_after,
             CASE WHEN NOT sufficient THEN 'H' WHEN s >= 0.05 AND s >= breach THEN 'B' WHEN s < 0.05 OR s <= clear THEN 'C' ELSE 'H' END AS class,
             row_number() OVER (PARTITION BY stream ORDER BY tick) AS i
      FROM raw JOIN policy USING (kind) WHERE sufficient OR gap = 'hold'),
m AS (
  SELECT stream, i - 1 AS i, tick, score, class, CAST(0 AS BIGINT) AS cb, CAST(0 AS BIGINT) AS cc, false AS open, CAST('' AS VARCHAR) AS action, CAST('IDLE' AS VARCHAR) AS phase, CAST(0 AS BIGINT) AS number,
         CAST(NULL AS BIGINT) AS pending, CAST(NULL AS BIGINT) AS opened, CAST(0 AS BIGINT) AS breaches, CAST(0 AS BIGINT) AS revision, CAST(NULL AS DOUBLE) AS run_peak, CAST(NULL AS DOUBLE) AS peak
  FROM t WHERE i = 1
  UNION ALL
  SELECT stream, i, tick, score, class, cb, cc, open, action,
         CASE WHEN action IN ('OPENED', 'SUSTAINED') THEN 'ACTIVE' WHEN action IN ('PENDING', 'CLEARING', 'CLOSED') THEN action WHEN open THEN 'ACTIVE' ELSE 'IDLE' END,
         number + (action = 'OPENED')::INT, pending, CASE WHEN action = 'OPENED' THEN pending ELSE opened END,
         CASE action WHEN 'OPENED' THEN open_after WHEN 'SUSTAINED' THEN breaches + 1 ELSE breaches END,
         CASE WHEN action = 'OPENED' THEN 1 WHEN action IN ('SUSTAINED', 'CLOSED') THEN revision + 1 ELSE revision END, run_peak,
         CASE WHEN action = 'OPENED' THEN run_peak WHEN action = 'SUSTAINED' THEN greatest(peak, score) ELSE peak END
  FROM (
    SELECT *, CASE WHEN action = 'OPENED' THEN true WHEN action = 'CLOSED' THEN false ELSE was END AS open FROM (
      SELECT *, CASE WHEN class = 'B' THEN CASE WHEN was THEN 'SUSTAINED' WHEN cb >= open_after THEN 'OPENED' ELSE 'PENDING' END
                     WHEN class = 'C' AND was THEN CASE WHEN cc >= close_after THEN 'CLOSED' ELSE 'CLEARING' END ELSE 'HELD' END AS action FROM (
        SELECT t.stream, t.i, t.tick, t.score, t.class, t.open_after, t.close_after, m.open AS was, m.number, m.opened, m.breaches, m.revision, m.peak,
               CASE WHEN t.class = 'B' THEN m.cb + 1 ELSE 0 END AS cb, CASE WHEN t.class = 'C' AND m.open THEN m.cc + 1 ELSE 0 END AS cc,
               CASE WHEN t.class = 'B' AND m.cb = 0 THEN t.tick ELSE m.pending END AS pending, CASE WHEN t.class = 'B' AND m.cb = 0 THEN t.score WHEN t.class = 'B' THEN greatest(m.run_peak, t.score) ELSE m.run_peak END AS run_peak
        FROM m JOIN t ON t.stream = m.stream AND t.i = m.i + 1))))
"""
LIVE = "number > 0 AND (open OR action = 'CLOSED')"
GRAPH = "(SELECT DISTINCT source, target FROM (SELECT event_type || '/' || CAST(floor(epoch_us(ts) / 28800000000) AS BIGINT) AS source, lead(event_type || '/' || CAST(floor(epoch_us(ts) / 28800000000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events WHERE value > 150) WHERE target IS NOT NULL AND source <> target)"
LEAST = "SELECT source, target, min(hops) AS hops FROM reach WHERE source <> target GROUP BY source, target"
LINES = "(SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
MASKED = "regexp_replace(trim(line), '\\S*[0-9]\\S*', '<*>', 'g')"



def _learned(name: str, rows: str, group: str) -> str:
    """Leaves of ``rows`` (group, template, n, ws) learned line by line: a list of templates for each, after each line."""
    agree = "len(list_filter(list_zip(c.t, x.ws), lambda p: p[1] = p[2] AND p[1] <> '<*>'))"
    wild = "len(list_filter(c.t, lambda w: w = '<*>'))"
    return f"""{name}_i AS MATERIALIZED (SELECT {group}, ws, n, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, template) AS i FROM {rows}),
{name}_s AS (
  SELECT {group}, i, [{{'t': ws, 'n': CAST(n AS HUGEINT)}}] AS cs FROM {name}_i WHERE i = 1
  UNION ALL
  SELECT {group}, i, CASE WHEN best.same >= 0.4 * len(ws) THEN list_transform(cs, lambda c, k: CASE WHEN k = best.k THEN {{'t': list_transform(list_zip(c.t, ws), lambda p: CASE WHEN p[1] = p[2] THEN p[1] ELSE '<*>' END), 'n': c.n + n}} ELSE c END)
                     ELSE list_append(cs, {{'t': ws, 'n': CAST(n AS HUGEINT)}}) END
  FROM (SELECT {", ".join("x." + c.strip() for c in group.split(","))}, x.i, x.ws, x.n, s.cs,
               list_sort(list_transform(s.cs, lambda c, k: {{'a': -{agree}, 'w': -{wild}, 'k': k, 'same': {agree}}}))[1] AS best
        FROM {name}_s s JOIN {name}_i x USING ({group}) WHERE x.i = s.i + 1)),
{name} AS MATERIALIZED (SELECT {group}, array_to_string(c.t, ' ') AS template, c.n AS n, c.t AS ws FROM (SELECT {group}, unnest(arg_max(cs, i)) AS c FROM {name}_s GROUP BY {group}))"""


#: Leaves are learned in one part each up to 4096 distinct lines; all are smaller where this runs.
TEMPLATES = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT coalesce(source, '') AS source, regexp_replace({MASKED}, '\\s+', ' ', 'g') AS template, count(*) AS n FROM {LINES} WHERE trim(line) <> '' GROUP BY 1, 2),
w AS MATERIALIZED (SELECT *, string_split(template, ' ') AS ws, len(string_split(template, ' ')) AS length FROM f),
own AS (SELECT source, length, ws[1] AS head FROM w WHERE ws[1] <> '<*>' GROUP BY source, length, ws[1] QUALIFY row_number() OVER (PARTITION BY source, length ORDER BY sum(n) DESC, ws[1]) < 100),
leaves AS MATERIALIZED (SELECT w.*, coalesce(own.head, '<*>') AS child FROM w LEFT JOIN own ON own.source = w.source AND own.length = w.length AND own.head = w.ws[1]),
{_learned("one", "leaves", "source, length, child")},
again AS MATERIALIZED (SELECT source, length, child, template, sum(n) AS n, any_value(ws) AS ws FROM one GROUP BY ALL),
{_learned("two", "again", "source, length, child")},
t AS (SELECT source, length, template, sum(n) AS n, any_value(ws) AS ws FROM two GROUP BY source, length, template)
SELECT w.source, w.template, w.n, (SELECT t.template FROM t WHERE t.source = w.source AND t.length = w.length AND (t.ws[1] = w.ws[1] OR t.ws[1] = '<*>')
       AND len(list_filter(list_zip(w.ws, t.ws), lambda p: p[1] = p[2] OR p[2] = '<*>')) = w.length ORDER BY len(list_filter(t.ws, lambda x: x = '<*>')), t.n DESC, t.template LIMIT 1) AS leader
FROM w"""

ORACLES = {
    "episode_transitions": MACHINE + f"""SELECT stream, tick, round(score, 6) AS score, class, action, phase, CASE WHEN {LIVE} THEN number END AS number, CASE WHEN {LIVE} THEN opened END AS opened, CASE WHEN {LIVE} THEN breaches END AS breaches, CASE WHEN {LIVE} THEN revision END AS revision, CASE WHEN {LIVE} THEN round(peak, 6) END AS peak FROM m WHERE i > 0""",
    "episode_lifecycle": MACHINE + f"SELECT stream, number, max(opened) AS opened, min(tick) AS confirmed, max(CASE WHEN action = 'CLOSED' THEN tick END) AS closed, max(breaches) AS breaches, max(revision) AS revision, round(max(peak), 6) AS peak FROM m WHERE i > 0 AND {LIVE} GROUP BY stream, number",
    "signature_knn": f"SELECT id, rank, neighbour, round(similarity, 6) AS similarity FROM {KNN}",
    "recognised_confidence": f"SELECT s.id, round(CASE WHEN best IS NULL THEN s.a ELSE least(1.0, s.a + 0.05 * least(1.0, (best - 0.9) / 0.1)) END, 6) AS confidence, round(best, 6) AS best FROM {SIGNATURES} s LEFT JOIN (SELECT id, max(similarity) AS best FROM {KNN} GROUP BY id) b ON b.id = s.id",
    "audit_chain_build": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {ENTRIES}), c AS (
  SELECT chain, seq, content, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || '|' || seq || '|' || content) AS entry_hash FROM e WHERE seq = 0
  UNION ALL SELECT e.chain, e.seq, e.content, c.entry_hash, sha256(c.entry_hash || '|' || e.seq || '|' || e.content) FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq + 1)
SELECT * FROM c""",
    "audit_chain_breaks": f"SELECT chain, count(*) AS entries, arg_max(seq, o_totalprice * 1e7 + o_orderkey / 1e7) AS first_break FROM {ENTRIES} GROUP BY chain",
    "graph_hops": f"WITH RECURSIVE g AS MATERIALIZED (SELECT source, target FROM {GRAPH} UNION SELECT target, source FROM {GRAPH}), reach(source, target, hops) AS (SELECT source, target, 1 FROM g UNION SELECT r.source, g.target, r.hops + 1 FROM reach r JOIN g ON g.source = r.target WHERE r.hops < 60) SELECT source, count(*) AS reached, max(hops) AS farthest, CAST(sum(hops) AS BIGINT) AS hops FROM ({LEAST}) GROUP BY source",
    "graph_dependents_all": f"WITH RECURSIVE g AS MATERIALIZED (SELECT source, target FROM {GRAPH}), reach(source, target, hops) AS (SELECT source, target, 1 FROM g UNION SELECT r.source, g.target, r.hops + 1 FROM reach r JOIN g ON g.source = r.target WHERE r.hops < 60) SELECT target, count(*) AS dependents, max(hops) AS farthest FROM ({LEAST}) GROUP BY target",
    "causal_graph_nodes": f"SELECT event_type || '-' || segment AS node, max(value) FILTER (WHERE value > 100) AS peak, CAST(count(*) FILTER (WHERE value > 150) AS BIGINT) AS active, concat_ws(',', CASE WHEN bool_or(value > 100 AND value <= 200) THEN 'latency' END, CASE WHEN bool_or(value > 200) THEN 'saturation' END) AS kinds FROM {EVENTS} GROUP BY event_type, segment",
    "causal_graph_edges": f"SELECT 'seg' || segment AS source, event_type AS target, count(*) FILTER (WHERE value > 150) AS evidence, max(value) FILTER (WHERE value > 150) AS peak FROM {EVENTS} GROUP BY segment, event_type",
    "contexts_as_of": f"SELECT d.event_id AS decision_id, count(c.event_id) AS n, coalesce(string_agg(c.event_id, ',' ORDER BY c.us, c.event_id), '') AS contexts FROM {EVENTS} d LEFT JOIN {EVENTS} c ON c.event_type = 'signup' AND d.us >= c.us AND d.us < c.us + 7200000000 WHERE d.event_type = 'purchase' GROUP BY d.event_id",
    "judgement_window_join": f"SELECT p.event_id AS judgement, e.event_id AS window FROM {EVENTS} p JOIN {EVENTS} e ON p.us - 3600000000 < e.us + 3600000000 AND e.us - 3600000000 < p.us AND (p.segment = e.segment OR p.user_id % 10 = e.user_id % 10) WHERE p.event_type = 'purchase' AND e.event_type = 'error' AND e.value > 100",
    "suppression_windows": f"""SELECT event_id AS decision_id, action, applied, coalesce(final, action) AS final FROM (
  SELECT d.event_id, d.action, arg_min(w.event_id, w.us * 1000000.0 + w.event_id) AS applied, arg_min(CASE WHEN w.value > 60 THEN 'ASK' WHEN w.value <= 60 THEN 'WATCH' END, w.us * 1000000.0 + w.event_id) AS final
  FROM (SELECT *, CASE WHEN value > 80 THEN 'ACT' WHEN value > 40 THEN 'HOLD' WHEN value > 20 THEN 'ASK' ELSE 'WATCH' END AS action FROM {EVENTS} WHERE event_type = 'purchase') d
  LEFT JOIN {EVENTS} w ON w.event_type = 'signup' AND d.us >= w.us AND d.us < w.us + 3600000000 AND w.segment = d.segment AND CASE WHEN w.value > 60 THEN d.action = 'ACT' ELSE d.user_id % 2 = 0 AND d.action <> 'WATCH' END
  GROUP BY d.event_id, d.action)""",
    "path_entropy": "WITH p AS (SELECT regexp_extract(url, '^https?://[^/]*[.]([a-z]+)/', 1) AS zone, regexp_extract(url, '^https?://[^/]*/([^/?#]*)', 1) AS path FROM pages) SELECT zone, count(*) AS n, CASE WHEN count(*) >= 6 THEN round(entropy(path), 6) END AS entropy, CASE WHEN count(*) >= 6 THEN 'ok' ELSE 'insufficient' END AS status FROM p GROUP BY zone",
    "crowd_coherence": f"SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(v) > 0 AND var_pop(c) > 0 THEN round(least(1.0, greatest(0.0, covar_pop(v, c) / sqrt(var_pop(v) * var_pop(c)))), 6) END AS coherence FROM (SELECT user_id, tick, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c FROM {EVENTS} GROUP BY user_id, tick) GROUP BY user_id",
    "top2_per_group": "SELECT x.user_id, CAST(1 + count(y.event_id) AS INTEGER) AS rank, x.event_id, x.value FROM events x LEFT JOIN events y ON y.user_id = x.user_id AND (y.value > x.value OR y.value = x.value AND y.event_id < x.event_id) GROUP BY x.user_id, x.event_id, x.value HAVING count(y.event_id) < 2",
    "first_acting_outcome": f"SELECT x.user_id, x.event_id, x.us FROM {EVENTS} x WHERE event_type = 'purchase' AND value > 50 AND NOT EXISTS (SELECT 1 FROM {EVENTS} y WHERE y.user_id = x.user_id AND y.event_type = 'purchase' AND y.value > 50 AND (y.us < x.us OR y.us = x.us AND y.event_id < x.event_id))",
    "select_strongest": f"SELECT DISTINCT ON (event_type, tick) event_type, tick, user_id, strength, score, onset FROM (SELECT event_type, tick, user_id, count(*) AS strength, max(value) AS score, min(us) AS onset FROM {EVENTS} GROUP BY event_type, tick, user_id) ORDER BY event_type, tick, strength DESC, score DESC, onset, user_id",
    "edge_sliding_window": f"""WITH k AS (SELECT unnest(range((SELECT min(us) // 7200000000 FROM {EVENTS}), (SELECT max(us) // 7200000000 + 8 FROM {EVENTS}))) * 7200000000 AS tick_us),
r AS (SELECT segment AS caller, event_type AS service, tick_us, value, row_number() OVER (PARTITION BY segment, event_type, tick_us ORDER BY value) AS i, count(*) OVER (PARTITION BY segment, event_type, tick_us) AS calls FROM {EVENTS} e JOIN k ON e.us > tick_us - 43200000000 AND e.us <= tick_us)
SELECT caller, service, tick_us, calls, max(value) FILTER (WHERE i = ceil(0.95 * calls)) AS p95, round(count(*) FILTER (WHERE value > 150) / calls, 6) AS error_rate FROM r GROUP BY caller, service, tick_us, calls""",
    "edge_p95_error_rate": f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY segment, event_type, tick ORDER BY value) AS i, count(*) OVER (PARTITION BY segment, event_type, tick) AS calls FROM {EVENTS}) SELECT segment AS caller, event_type AS service, tick, calls, max(value) FILTER (WHERE i = ceil(0.95 * calls)) AS p95, round(count(*) FILTER (WHERE value > 150) / calls, 6) AS error_rate FROM r GROUP BY segment, event_type, tick, calls",
    "template_frequency": f"SELECT source, {MASKED} AS template, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS rate, min(doc_id) AS first_ref FROM {LINES} WHERE trim(line) <> '' GROUP BY source, template",
    "log_template_merge": TEMPLATES,
    "slo_before_after": f"""WITH s AS (SELECT segment, tick, 1 - avg((event_type = 'error')::INT) AS a FROM {EVENTS} GROUP BY segment, tick),
x AS (SELECT e.event_id, q.a - p.a AS gain FROM {EVENTS} e CROSS JOIN (VALUES (0), (1)) o(k) LEFT JOIN s p ON p.segment = (e.segment + k) % 3 AND p.tick = e.tick - 1 LEFT JOIN s q ON q.segment = (e.segment + k) % 3 AND q.tick = e.tick + 1 WHERE e.event_type = 'signup')
SELECT event_id AS action_id, count(gain) AS services, round(min(gain), 6) AS delta FROM x GROUP BY event_id""",
    "security_timeline": f"SELECT user_id AS incident_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS INTEGER) AS place, event_id AS episode_id, event_type AS kind, us AS ts FROM {EVENTS} WHERE value > 100 AND event_type IN ('error', 'signup')",
    "envelope_rejection": f"SELECT user_id, tick, CASE WHEN bool_or(value > 400) THEN 'value too large' ELSE 'value too small' END AS reason, count(*) AS points, sha256(string_agg(props, chr(10) ORDER BY props)) AS payload_sha256 FROM {EVENTS} GROUP BY user_id, tick HAVING bool_or(value < 1 OR value > 400)",
    "envelope_accepted": f"SELECT event_type, count(*) AS n FROM {EVENTS} e WHERE NOT EXISTS (SELECT 1 FROM {EVENTS} b WHERE b.user_id = e.user_id AND b.tick = e.tick AND (b.value < 1 OR b.value > 400)) GROUP BY event_type",
    "ingress_filter": "SELECT 'shop-' || event_type AS service, count(*) AS spans FROM events WHERE user_id % 4 = 2 AND event_type <> 'signup' GROUP BY event_type",
    "unit_homogeneity": f"SELECT event_type, tick, count(*) AS n, CASE WHEN bool_and(value > 450) OR bool_and(value <= 450) THEN round(avg(value), 6) END AS mean, CASE WHEN bool_and(value > 450) OR bool_and(value <= 450) THEN 'ok' ELSE 'mixed units' END AS status FROM {EVENTS} GROUP BY event_type, tick",
    "normalised_key_guard": "SELECT event_id, (event_type = 'error' AND user_id % 5 = 1) OR (event_type = 'signup' AND user_id % 5 = 2) AS leaks FROM events",
}
QUERIES = {name: (globals()[name], sql) for name, sql in ORACLES.items()}
#: Earlier names of queries that are now built on these operators.
QUERIES |= {old: QUERIES[new] for old, new in (("audit_chain", "audit_chain_build"), ("audit_chain_verify", "audit_chain_breaks"), ("graph_dependents", "graph_dependents_all"))}
