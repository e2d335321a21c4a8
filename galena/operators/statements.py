"""The declarative operators, each as one statement over the test tables.

Events stand for telemetry: an event is an observation or a server span of the service
``event_type`` with latency ``value``, failed if its type is 'error', called by segment
``user_id % 3``.  Ticks are buckets of six hours.  Empty populations give NULL and a status,
never zero.
"""

TICK = "CAST(floor({us} / 21600000000) AS BIGINT)"
OBS = f"(SELECT *, {{us}} AS us, {TICK} AS tick FROM {{events}})"
#: Edges of a caller and a service per tick: calls, p95 and the rise over the first sufficient tick.
EDGES = f"""(
  SELECT caller, event_type, tick, calls, p95, first_value(CASE WHEN calls >= 3 THEN p95 END) OVER (PARTITION BY caller, event_type ORDER BY CASE WHEN calls >= 3 THEN 0 ELSE 1 END, tick) AS base
  FROM (SELECT user_id % 3 AS caller, event_type, tick, count(*) AS calls, {{p95:value}} AS p95 FROM {OBS} o GROUP BY user_id % 3, event_type, tick) e)"""
SCORED = f"""(
  SELECT concat('seg', CAST(caller AS VARCHAR(9)), '-', event_type) AS stream, tick,
         CASE WHEN calls < 3 OR base IS NULL THEN NULL ELSE least(1.0e0, greatest(0.0e0, p95 - base) / greatest(5.0e0, base)) END AS score
  FROM {EDGES} s)"""
#: Breach at 0.5e0 and above, clear at 0.2e0 and below or without a value, else hold.
CLASSED = f"""(SELECT *, CASE WHEN score >= 0.5e0 THEN 'breach' WHEN score IS NULL OR score <= 0.2e0 THEN 'clear' ELSE 'hold' END AS class FROM {SCORED} c)"""
RUNS = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY stream ORDER BY tick) - row_number() OVER (PARTITION BY stream, class ORDER BY tick) AS BIGINT) AS grp FROM {CLASSED} r)"""
LENGTHS = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY stream, class, grp ORDER BY tick) AS BIGINT) AS run FROM {RUNS} l)"""
EPISODES = f"""(
  SELECT stream, tick, score, class, run, {{last:CASE WHEN class = 'breach' AND run >= 2 THEN 'OPEN' WHEN class = 'clear' AND run >= 2 THEN 'CLOSED' END}}
         OVER (PARTITION BY stream ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state
  FROM {LENGTHS} h)"""
CONTEXTS = "(SELECT * FROM (VALUES (1, 78912, 78920, 2.5e0, 1.0e0), (2, 78918, 78940, 1.5e0, 0.5e0), (3, 78930, 78931, 0.5e0, 1.0e0)) AS x(context_id, valid_from, valid_to, multiplier, trust))"
EDGE_SET = "(SELECT * FROM (VALUES ('view', 'click'), ('click', 'purchase'), ('purchase', 'error')) AS x(service, dependency))"
#: Every change, in its own hour and the next, once for each salt of the events.
CHANGE_HOURS = f"(SELECT event_type AS service, us, CAST(floor(us / 3600000000) AS BIGINT) + later AS hour, salt FROM {OBS} c CROSS JOIN (SELECT * FROM (VALUES (0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3)) AS x(later, salt)) s WHERE event_type = 'signup')"
VERSIONS = "(SELECT user_id AS id, event_id AS revision, CASE WHEN event_type = 'purchase' THEN 'CLOSED' ELSE 'OPEN' END AS state, value FROM {events})"
#: Events in order of arrival, in blocks of bounded length: what came before a block is one row for each block.
ARRIVALS = f"(SELECT event_id, event_type, us, event_id + (event_id * 5) % 7 AS place, CAST(floor((event_id + (event_id * 5) % 7) / 4096.0e0) AS BIGINT) AS block FROM {OBS} o)"
DAYS = "(SELECT event_type, CAST(floor(tick / 4.0e0) AS BIGINT) AS day, count(*) AS n, sum(value) AS total, max(value) AS peak FROM " + OBS + " d GROUP BY event_type, CAST(floor(tick / 4.0e0) AS BIGINT))"

STATEMENTS: dict[str, str] = {
    # aggregates
    "feature_window": f"SELECT event_type, tick, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi, {{newest:value}} AS newest FROM {OBS} o GROUP BY event_type, tick",
    "ingress_rate": f"SELECT event_type, CAST(ceil({{us}} / 21600000000) AS BIGINT) - 1 AS tick, count(DISTINCT event_id) AS spans, round(count(DISTINCT event_id) / 21600.0e0, 9) AS rate FROM {{events}} GROUP BY event_type, CAST(ceil({{us}} / 21600000000) AS BIGINT) - 1",
    "anchored_rate_zero_fill": f"SELECT t.event_type, b.tick, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM {{events}}) t CROSS JOIN (SELECT DISTINCT tick FROM {OBS} o) b LEFT JOIN (SELECT event_type, tick, count(*) AS n FROM {OBS} o GROUP BY event_type, tick) c ON c.event_type = t.event_type AND c.tick = b.tick",
    "source_entropy": f"SELECT event_type, tick, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(n) >= 6 THEN round(greatest(0.0e0, -sum(n * 1.0e0 / total * log2(n * 1.0e0 / total))), 6) END AS entropy, CASE WHEN sum(n) >= 6 THEN 'ok' ELSE 'insufficient' END AS status FROM (SELECT *, sum(n) OVER (PARTITION BY event_type, tick) AS total FROM (SELECT event_type, tick, user_id, count(*) AS n FROM {OBS} o GROUP BY event_type, tick, user_id) u) w GROUP BY event_type, tick",
    "auth_failure_ratio": f"SELECT tick, count(*) AS n, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 1.0e0 / count(*), 6) AS ratio FROM {OBS} o GROUP BY tick",
    "conversion_ratio": f"SELECT tick, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views, round(least(1.0e0, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) * 1.0e0 / nullif(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 0)), 6) AS ratio FROM {OBS} o GROUP BY tick",
    "capped_ratio": f"SELECT user_id, tick, round(CASE WHEN den = 0 THEN CASE WHEN num = 0 THEN NULL ELSE 3.0e0 END ELSE least(3.0e0, num * 1.0e0 / den) END, 6) AS ratio FROM (SELECT user_id, tick, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS num, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS den FROM {OBS} o GROUP BY user_id, tick) r",
    "interarrival_cv": f"SELECT event_type, CAST(floor(tick / 4.0e0) AS BIGINT) AS day, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(stddev_pop(gap) / nullif(avg(gap), 0), 6) END AS cv FROM (SELECT event_type, tick, (us - lag(us) OVER (PARTITION BY event_type, CAST(floor(tick / 4.0e0) AS BIGINT) ORDER BY us, event_id)) / 1e6 AS gap FROM {OBS} o) g GROUP BY event_type, CAST(floor(tick / 4.0e0) AS BIGINT)",
    "warmup_median": f"SELECT event_type, count(*) AS n, round(median(value), 6) AS base FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS k FROM {OBS} o) w WHERE k <= 30 GROUP BY event_type",
    "noisy_or": f"SELECT user_id, round(1 - exp(sum(ln(1 - least(value, 490.0e0) / 1000.0e0))), 6) AS score FROM {{events}} GROUP BY user_id",
    "regression_slope": f"SELECT event_type, tick, round(regr_slope(value, (us - tick * 21600000000) / 1e6), 6) AS slope FROM {OBS} o GROUP BY event_type, tick HAVING count(*) >= 3",
    "ingest_counters": f"SELECT count(*) AS arrived, count(DISTINCT event_id) AS accepted, count(*) - count(DISTINCT event_id) AS duplicates FROM (SELECT event_id FROM {{events}} UNION ALL SELECT event_id FROM {{events}} WHERE event_id % 10 = 0) a",
    "rows_by_source": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type",
    "coverage_sets": "SELECT user_id, count(DISTINCT event_type) AS kinds, {listed:event_type} AS seen FROM {events} GROUP BY user_id",
    "status_rollup": f"SELECT state, class, count(*) AS ticks, count(DISTINCT stream) AS streams FROM {EPISODES} e GROUP BY state, class",
    "slo_availability_p95": f"SELECT tick, count(*) AS n, round(1 - sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 1.0e0 / count(*), 6) AS availability, round({{p95:value}}, 6) AS p95, {{p95:value}} > 150 AS slow FROM {OBS} o GROUP BY tick",
    "histogram_quantile": "SELECT event_type, CAST(min(upper) AS BIGINT) AS p95_bucket FROM (SELECT event_type, upper, sum(n) OVER (PARTITION BY event_type ORDER BY upper) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM (SELECT event_type, ceil(value / 25) * 25 AS upper, count(*) AS n FROM {events} GROUP BY event_type, ceil(value / 25) * 25) b) c WHERE upto >= 0.95e0 * total GROUP BY event_type",
    "run_bounds": f"SELECT m.user_id, m.anchor, min(o.us) AS first_us, count(*) AS inside FROM (SELECT user_id, max(us) AS anchor FROM {OBS} a WHERE event_type = 'signup' GROUP BY user_id) m JOIN {OBS} o ON o.user_id = m.user_id AND o.us > m.anchor AND o.us <= m.anchor + 259200000000 GROUP BY m.user_id, m.anchor",
    "worst_feature_pick": f"SELECT stream, tick, score FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY score DESC, tick) AS k FROM {SCORED} s WHERE score IS NOT NULL) r WHERE k = 1",
    "primary_series": f"SELECT tick, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY n DESC, event_type) AS k FROM (SELECT tick, event_type, count(*) AS n FROM {OBS} o GROUP BY tick, event_type) c) r WHERE k = 1",
    # windows
    "late_in_arrival_order": f"SELECT event_id, event_type, coalesce(us < greatest(within, b.before) - 3600000000, us < coalesce(within, b.before) - 3600000000, false) AS late FROM (SELECT event_id, event_type, us, block, max(us) OVER (PARTITION BY event_type, block ORDER BY place, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS within FROM {ARRIVALS} a) l JOIN (SELECT event_type, block, max(newest) OVER (PARTITION BY event_type ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT event_type, block, max(us) AS newest FROM {ARRIVALS} m GROUP BY event_type, block) g) b USING (event_type, block)",
    "run_length": f"SELECT stream, tick, class, run FROM {LENGTHS} r",
    "episode_hysteresis": f"SELECT stream, tick, round(score, 6) AS score, class, run, coalesce(state, 'NONE') AS state FROM {EPISODES} e",
    "episode_intervals": f"SELECT stream, grp, min(tick) AS opened, max(tick) AS last_tick, count(*) AS ticks, round(max(score), 6) AS peak FROM (SELECT *, CAST(row_number() OVER (PARTITION BY stream ORDER BY tick) - row_number() OVER (PARTITION BY stream, state ORDER BY tick) AS BIGINT) AS grp FROM {EPISODES} e) g WHERE state = 'OPEN' GROUP BY stream, grp",
    "running_peak": f"SELECT stream, tick, round(max(score) OVER (PARTITION BY stream ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS peak FROM {SCORED} s",
    "trend_deadband": f"SELECT stream, tick, CASE WHEN before IS NULL OR score IS NULL THEN 'UNKNOWN' WHEN score - before > 0.05e0 THEN 'RISING' WHEN score - before < -0.05e0 THEN 'FALLING' ELSE 'STEADY' END AS trend FROM (SELECT *, lag(score) OVER (PARTITION BY stream ORDER BY tick) AS before FROM {SCORED} s) l",
    "rank_margin": f"SELECT tick, stream, round(score - coalesce(runner_up, 0), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY score DESC, stream) AS k, lead(score) OVER (PARTITION BY tick ORDER BY score DESC, stream) AS runner_up FROM {SCORED} s WHERE score IS NOT NULL) r WHERE k = 1",
    "rolling_rate_breaker": f"SELECT event_id, user_id, recent, recent >= 5 AS tripped FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM {OBS} o) r",
    "tail_window": f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY us DESC, event_id DESC) AS k FROM {OBS} o) t WHERE k <= 24 GROUP BY event_type",
    "offset_gap_check": "SELECT user_id, event_id, event_id - before - 1 AS missing FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM {events}) g WHERE event_id <> before + 1",
    "revision_number": f"SELECT id, revision, CAST(row_number() OVER (PARTITION BY id ORDER BY revision) AS BIGINT) AS number FROM {VERSIONS} v",
    "edge_p95_rise": f"SELECT caller, event_type, tick, calls, round(p95, 6) AS p95, CASE WHEN calls >= 3 AND base IS NOT NULL THEN round(greatest(0.0e0, p95 - base) / greatest(5.0e0, base), 6) END AS rise, CASE WHEN calls >= 3 AND base IS NOT NULL THEN 'ok' ELSE 'insufficient' END AS status FROM {EDGES} e",
    # sources, sinks, reads
    "dedup_first_seen": f"SELECT event_id, event_type, arrival FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS k FROM (SELECT event_id, event_type, event_id * 2 AS arrival FROM {{events}} UNION ALL SELECT event_id, event_type, event_id * 2 + 99 AS arrival FROM {{events}} WHERE event_id % 10 = 0) a) d WHERE k = 1",
    "latest_version": f"SELECT id, max(revision) AS revision, max_by(state, revision) AS state, max_by(value, revision) AS value FROM {VERSIONS} v GROUP BY id",
    "upsert_keep_newest": f"SELECT id, max(revision) AS revision, max_by(state, revision) AS state FROM (SELECT id, revision, state FROM {VERSIONS} v WHERE revision % 2 = 0 UNION ALL SELECT id, revision, state FROM {VERSIONS} v WHERE revision % 2 = 1) u GROUP BY id",
    "insert_once_antijoin": f"SELECT n.event_id, n.event_type FROM {{events}} n LEFT ANTI JOIN (SELECT event_id FROM {{events}} WHERE event_id % 3 = 0) old ON old.event_id = n.event_id",
    "range_scan_limit": f"SELECT event_id, value FROM {OBS} o WHERE event_type = 'view' AND tick BETWEEN 78912 AND 78932 ORDER BY us, event_id LIMIT 100",
    "recent_topk": f"SELECT id, revision FROM (SELECT id, max(revision) AS revision FROM {VERSIONS} v GROUP BY id) l ORDER BY revision DESC, id LIMIT 20",
    "keyset_page": "SELECT event_id, event_type FROM {events} WHERE event_id > 100 ORDER BY event_id LIMIT 50",
    "latest_open_join": f"SELECT c.c_custkey, v.revision, v.state FROM {{customer}} c JOIN (SELECT id, max(revision) AS revision, max_by(state, revision) AS state FROM {VERSIONS} v GROUP BY id) v ON v.id = c.c_custkey WHERE v.state IN ('OPEN') ORDER BY v.revision DESC, c.c_custkey LIMIT 1",
    "content_hash_id": "SELECT event_id, {sha:concat_ws('|', CAST(event_id AS VARCHAR(20)), event_type, CAST(user_id AS VARCHAR(20)), props)} AS id FROM {events}",
    "validate_dead_letter": "SELECT event_id, CASE WHEN value < 0.05e0 THEN 'value too small' WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error') THEN 'unknown type' WHEN value > 450 THEN 'value too large' END AS reason, {sha:props} AS payload_sha256 FROM {events} WHERE value < 0.05e0 OR value > 450 OR event_type NOT IN ('view', 'click', 'purchase', 'signup', 'error')",
    # filters
    "rpc_outcome_classify": "SELECT event_id, CASE WHEN event_type = 'error' AND value < 20 THEN 'ambiguous' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS outcome FROM {events}",
    "url_path_extract": "SELECT page_id, {regex:url~^https?://([^/@#?]+)/} AS host, {regex:url~^https?://[^/@#?]+(/[^?#]*)} AS path FROM {pages}",
    "log_line_admission": "SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'blank' WHEN length(text) > 2000 THEN 'too long' ELSE 'ok' END AS status FROM {documents}",
    # joins
    "context_interval_join": f"SELECT o.event_id, count(c.context_id) AS contexts, round(coalesce(sum(CASE WHEN c.multiplier > 1 AND c.trust > 0 THEN o.value * (c.multiplier - 1) * c.trust END), 0), 6) AS lift FROM {OBS} o LEFT JOIN {CONTEXTS} c ON o.tick >= c.valid_from AND o.tick < c.valid_to GROUP BY o.event_id",
    "change_pressure": f"SELECT o.event_id, count(*) AS changes, round(max((1 - (o.us - c.us) / 3.6e9) * CASE WHEN o.event_type = c.service THEN 1.0e0 ELSE 0.4e0 END), 6) AS pressure FROM {OBS} o JOIN {CHANGE_HOURS} c ON c.hour = CAST(floor(o.us / 3600000000) AS BIGINT) AND c.salt = (o.event_id % 4 + 4) % 4 AND c.us <= o.us AND c.us > o.us - 3600000000 GROUP BY o.event_id",
    "change_pressure_all": f"SELECT o.event_id, count(*) AS changes, round(max((1 - (o.us - c.us) / 3.6e9) * CASE WHEN o.event_type = c.service THEN 1.0e0 ELSE 0.4e0 END), 6) AS pressure FROM {OBS} o JOIN {CHANGE_HOURS} c ON c.hour = CAST(floor(o.us / 3600000000) AS BIGINT) AND c.salt = (o.event_id % 4 + 4) % 4 AND c.us <= o.us AND c.us > o.us - 3600000000 GROUP BY o.event_id",
    "asof_capacity": f"SELECT event_id, user_id, value, {{last:CASE WHEN event_type = 'purchase' THEN value END}} OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capacity FROM {OBS} o",
    "interval_overlap_join": f"SELECT a.event_type AS kind, a.day AS day_a, b.day AS day_b FROM {DAYS} a JOIN {DAYS} b ON a.event_type = b.event_type AND a.day < b.day + 2 AND b.day < a.day + 2 AND a.day <> b.day",
    "unrelated_episode_antijoin": f"SELECT DISTINCT s.stream, s.tick FROM {SCORED} s LEFT ANTI JOIN {CONTEXTS} c ON s.tick >= c.valid_from AND s.tick < c.valid_to WHERE s.score >= 0.5e0",
    "committed_edge_semijoin": f"SELECT e.caller, e.event_type, e.tick FROM {EDGES} e LEFT SEMI JOIN {EDGE_SET} t ON t.dependency = e.event_type",
    "rule_lookup_join": f"SELECT t.service, t.dependency, count(*) AS calls, round(avg(o.value), 6) AS mean FROM {{events}} o JOIN {EDGE_SET} t ON t.dependency = o.event_type GROUP BY t.service, t.dependency",
    "episodes_as_of": f"SELECT d.id, t.decided, v.revision, v.state, CASE WHEN v.revision IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT DISTINCT user_id AS id FROM {{events}}) d CROSS JOIN (SELECT DISTINCT (CAST(floor(tick / 4.0e0) AS BIGINT) + 1) * 86400000000 AS decided FROM {OBS} o) t LEFT JOIN (SELECT user_id AS id, event_id AS revision, CASE WHEN event_type = 'purchase' THEN 'CLOSED' ELSE 'OPEN' END AS state, us, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS until FROM {OBS} w) v ON v.id = d.id AND v.us <= t.decided AND (v.until IS NULL OR t.decided < v.until)",
    "episodes_at_decision": f"SELECT d.id, t.decided, v.revision, v.state, CASE WHEN v.revision IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT DISTINCT user_id AS id FROM {{events}}) d CROSS JOIN (SELECT DISTINCT (CAST(floor(tick / 4.0e0) AS BIGINT) + 1) * 86400000000 AS decided FROM {OBS} o) t LEFT JOIN (SELECT user_id AS id, event_id AS revision, CASE WHEN event_type = 'purchase' THEN 'CLOSED' ELSE 'OPEN' END AS state, us, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS until FROM {OBS} w) v ON v.id = d.id AND v.us <= t.decided AND (v.until IS NULL OR t.decided < v.until)",
    "region_rollup": "SELECT r.r_name, n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name, n.n_name",
    # sets
    "set_difference": "SELECT user_id FROM {events} WHERE event_type = 'signup' EXCEPT SELECT user_id FROM {events} WHERE value > 400",
    "set_difference_by_type": "SELECT user_id FROM {events} WHERE event_type = 'signup' EXCEPT SELECT user_id FROM {events} WHERE value > 400",
    "set_intersection": "SELECT user_id FROM {events} WHERE event_type = 'signup' INTERSECT SELECT user_id FROM {events} WHERE event_type = 'purchase'",
    "union_sources": "SELECT source, count(*) AS n FROM (SELECT 'documents' AS source FROM {documents} UNION ALL SELECT 'pages' AS source FROM {pages} UNION ALL SELECT 'turns' AS source FROM {conversations}) u GROUP BY source",
    "conflicting_ids": "SELECT id, count(DISTINCT state) AS contents FROM " + VERSIONS + " v GROUP BY id HAVING count(DISTINCT state) > 1",
    "ordered_distinct_all": "SELECT user_id, {listed:CAST(event_id AS VARCHAR(20))} AS refs FROM {events} GROUP BY user_id",
    "ordered_distinct": "SELECT user_id, {listed:CAST(event_id AS VARCHAR(20))} AS refs FROM {events} GROUP BY user_id",
}
#: How DuckDB spells the two join types.
DUCK_JOINS = {"LEFT ANTI JOIN": "ANTI JOIN", "LEFT SEMI JOIN": "SEMI JOIN"}
