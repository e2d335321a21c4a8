"""Detectors, episodes and incidents, each as one statement over the test tables.

The views are those of ``statements``.  Here a call is slow, and counts as failed, above 150.
A detector reports every evaluated window with its status, so that quiet windows are visible.
"""

from .statements import CONTEXTS, EDGE_SET, EPISODES, OBS, SCORED, VERSIONS

RATES = f"(SELECT event_type, tick, count(*) AS n FROM {OBS} o GROUP BY event_type, tick)"
#: Rates with the median of the first 30 ticks of their stream as the frozen baseline.
BASED = f"""(
  SELECT r.event_type, r.tick, r.n, b.base, greatest(1.5e0, 0.1e0 * b.base) AS tol
  FROM {RATES} r JOIN (SELECT event_type, median(n) AS base FROM (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY tick) AS k FROM {RATES} x) w WHERE k <= 30 GROUP BY event_type) b
    ON b.event_type = r.event_type)"""
#: Two ratios per tick in long form; a window of fewer than six rows is insufficient.
RATIOS = f"""(
  SELECT metric, tick, n, CASE WHEN n >= 6 THEN CASE WHEN metric = 'failure' THEN bad ELSE good END * 1.0e0 / n END AS ratio
  FROM (SELECT tick, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad, count(*) FILTER (WHERE event_type = 'purchase') AS good FROM {OBS} o GROUP BY tick) t
  CROSS JOIN (SELECT * FROM (VALUES ('failure'), ('conversion')) AS m(metric)) m)"""
#: metric, direction in which a change is bad, floor of the baseline, trigger, deformation of score 1
RATIO_RULES = "(SELECT * FROM (VALUES ('failure', 1, 0.01e0, 0.5e0, 2.0e0), ('conversion', -1, 0.05e0, 0.3e0, 1.0e0)) AS x(metric, direction, least_base, trigger, full_at))"
DEFORMED = f"""(
  SELECT r.metric, r.tick, r.n, r.ratio, b.base, u.trigger, greatest(0.0e0, u.direction * (r.ratio - b.base)) / greatest(b.base, u.least_base) AS deformation, u.full_at, b.first_tick
  FROM {RATIOS} r JOIN {RATIO_RULES} u ON u.metric = r.metric
  LEFT JOIN (SELECT metric, min(tick) AS first_tick, min_by(ratio, tick) AS base FROM {RATIOS} f WHERE ratio IS NOT NULL GROUP BY metric) b ON b.metric = r.metric)"""
#: Calls of an edge with the first three of it as the baseline, which aren't counted again.
FIRST_CALLS = f"(SELECT * FROM (SELECT event_id, user_id % 3 AS caller, event_type, value, row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY us, event_id) AS k FROM {OBS} o) f WHERE k <= 3)"
CALLS = f"(SELECT user_id % 3 AS caller, event_type, tick, us, value, value > 150 AS failed FROM {OBS} o LEFT ANTI JOIN {FIRST_CALLS} f ON f.event_id = o.event_id)"
EDGE_BASE = f"(SELECT caller, event_type, {{p95:value}} AS base, count(*) FILTER (WHERE value > 150) / 3.0e0 AS base_err FROM {FIRST_CALLS} b GROUP BY caller, event_type)"
RISES = f"""(
  SELECT c.caller, c.event_type, c.tick, count(*) AS calls, greatest(0.0e0, {{p95:c.value}} - max(b.base)) / greatest(5.0e0, max(b.base)) AS latency_rise,
         greatest(0.0e0, count(*) FILTER (WHERE c.failed) * 1.0e0 / count(*) - max(b.base_err)) / greatest(0.01e0, max(b.base_err)) AS error_rise,
         min(c.us) FILTER (WHERE c.failed OR c.value > 1.5e0 * b.base) AS onset_us
  FROM {CALLS} c JOIN {EDGE_BASE} b ON b.caller = c.caller AND b.event_type = c.event_type GROUP BY c.caller, c.event_type, c.tick)"""
#: Openings of episodes: a tick that is OPEN after one that isn't.
OPENINGS = f"(SELECT stream, tick, score FROM (SELECT *, lag(state) OVER (PARTITION BY stream ORDER BY tick) AS before FROM {EPISODES} e) o WHERE state = 'OPEN' AND coalesce(before, 'NONE') <> 'OPEN')"
#: axis, claimed service, weight
CLAIMS = "(SELECT * FROM (VALUES ('demand', 'view', 0.6e0), ('demand', 'click', 0.4e0), ('business', 'purchase', 0.8e0), ('business', 'signup', 0.5e0), ('fault', 'error', 0.9e0), ('fault', 'purchase', 0.3e0)) AS x(axis, service, weight))"
AXES = f"""(
  SELECT c.axis, s.tick, count(s.score) AS covered, CASE WHEN count(s.score) > 0 THEN round(1 - exp(sum(ln(1 - 0.999e0 * c.weight * CASE WHEN s.score < 0.05e0 THEN 0.0e0 ELSE s.score END))), 6) END AS score
  FROM (SELECT *, substr(stream, 6) AS service FROM {SCORED} x) s JOIN {CLAIMS} c ON c.service = s.service GROUP BY c.axis, s.tick)"""
PIVOT = f"(SELECT tick, max(CASE WHEN axis = 'demand' THEN score END) AS demand, max(CASE WHEN axis = 'business' THEN score END) AS business, max(CASE WHEN axis = 'fault' THEN score END) AS fault FROM {AXES} a GROUP BY tick)"
#: order, class, axis that is lit, axis that is calm; lit from 0.5, calm below 0.3
VERDICTS = "(SELECT * FROM (VALUES (1, 'FAULT', 'fault', 'demand'), (2, 'SURGE', 'demand', 'fault'), (3, 'BUSINESS', 'business', 'fault'), (4, 'MIXED', 'fault', 'none')) AS x(rule_no, class, lit, calm))"
FITS = f"""(
  SELECT p.tick, v.rule_no, v.class, CASE v.lit WHEN 'fault' THEN p.fault WHEN 'demand' THEN p.demand ELSE p.business END AS lit_score, CASE v.calm WHEN 'fault' THEN p.fault WHEN 'demand' THEN p.demand ELSE 0.0e0 END AS calm_score
  FROM {PIVOT} p CROSS JOIN {VERDICTS} v)"""

STATEMENTS: dict[str, str] = {
    # detectors
    "residual_symptom": f"SELECT event_type, tick, n, round(n - base, 6) AS residual, round(least(1.0e0, (n - base - tol) / tol), 6) AS score FROM {BASED} b WHERE n - base > tol",
    "ratio_deformation": f"SELECT metric, tick, n, round(deformation, 6) AS deformation, CASE WHEN deformation >= trigger THEN round(least(1.0e0, deformation / full_at), 6) END AS score FROM {DEFORMED} d WHERE ratio IS NOT NULL",
    "ratio_window_status": f"SELECT metric, tick, CASE WHEN ratio IS NULL THEN 'INSUFFICIENT' WHEN tick = first_tick THEN 'WARMING' WHEN deformation >= trigger THEN 'BREACH' ELSE 'CLEAR' END AS status FROM {DEFORMED} d",
    "volume_drop": f"SELECT b.event_type, b.tick, round((b.base - b.n) / b.base, 6) AS fall, CASE WHEN (b.base - b.n) / b.base >= 0.5e0 THEN round(least(1.0e0, (b.base - b.n) / b.base / 0.9e0), 6) END AS score FROM {BASED} b WHERE b.base >= 1",
    "stream_silence": f"SELECT user_id, last_us, (newest - last_us) / 1e6 AS age, CASE WHEN newest - last_us >= 259200000000 THEN last_us + 259200000000 END AS onset_us, CASE WHEN newest - last_us >= 259200000000 THEN round(least(1.0e0, (newest - last_us) / 604800000000.0e0), 6) END AS score FROM (SELECT user_id, max(us) AS last_us FROM {OBS} o GROUP BY user_id) u CROSS JOIN (SELECT max(us) AS newest FROM {OBS} m) n",
    "liveness_status": f"SELECT t.event_type, k.tick, CASE WHEN b.n IS NULL THEN 'HOLD' WHEN (b.base - b.n) / b.base >= 0.5e0 THEN 'BREACH' ELSE 'CLEAR' END AS status FROM (SELECT DISTINCT event_type FROM {{events}}) t CROSS JOIN (SELECT DISTINCT tick FROM {RATES} r) k LEFT JOIN {BASED} b ON b.event_type = t.event_type AND b.tick = k.tick",
    "edge_degradation": f"SELECT caller, event_type, tick, calls, round(latency_rise, 6) AS latency_rise, round(error_rise, 6) AS error_rise, CASE WHEN calls < 5 THEN NULL WHEN latency_rise >= 0.5e0 OR error_rise >= 1 THEN round(least(1.0e0, greatest(latency_rise / 2, error_rise / 5)), 6) END AS score, onset_us, CASE WHEN calls < 5 THEN 'INSUFFICIENT' WHEN latency_rise >= 0.5e0 OR error_rise >= 1 THEN 'BREACH' ELSE 'CLEAR' END AS status FROM {RISES} r",
    "log_burst": f"SELECT event_type, tick, n, round(greatest(0.0e0, n - base) / greatest(0.01e0, base), 6) AS deformation, CASE WHEN n >= 5 AND (n - base) / greatest(0.01e0, base) >= 2 THEN round(least(1.0e0, (n - base) / greatest(0.01e0, base) / 10), 6) END AS score FROM {BASED} b",
    "log_window_status": f"SELECT event_type, tick, CASE WHEN n < 5 THEN 'INSUFFICIENT' WHEN first_ok = tick THEN 'WARMING' WHEN n >= 3 * first_n THEN 'BREACH' ELSE 'CLEAR' END AS status FROM (SELECT *, min(CASE WHEN n >= 5 THEN tick END) OVER (PARTITION BY event_type) AS first_ok, first_value(n) OVER (PARTITION BY event_type ORDER BY CASE WHEN n >= 5 THEN 0 ELSE 1 END, tick) AS first_n FROM {RATES} r) w",
    "log_template_mask": "SELECT source, template, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT source, doc_id, {mask:line} AS template FROM (SELECT source, doc_id, {lines:text} AS line FROM {documents}) l) t WHERE length(template) > 0 GROUP BY source, template",
    "saturation_verify": f"SELECT user_id, day, count(*) AS points, round(max(used) / 500.0e0, 6) AS peak_ratio, round(avg(CASE WHEN used > before THEN 1.0e0 WHEN before IS NOT NULL THEN 0.0e0 END), 6) AS rising, CASE WHEN max(used) / 500.0e0 >= 0.8e0 THEN round(least(1.0e0, (max(used) / 500.0e0 - 0.8e0) / 0.15e0), 6) END AS score FROM (SELECT *, lag(used) OVER (PARTITION BY user_id, day ORDER BY us, event_id) AS before FROM (SELECT user_id, us, event_id, CAST(floor(tick / 4.0e0) AS BIGINT) AS day, sum(value) OVER (PARTITION BY user_id, CAST(floor(tick / 4.0e0) AS BIGINT) ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {OBS} o) u) w GROUP BY user_id, day",
    "resource_series_islands": f"SELECT user_id, island, count(*) AS points, min(us) AS first_us, max(us) AS last_us FROM (SELECT user_id, us, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {OBS} o) i GROUP BY user_id, island",
    "resource_capability_audit": f"SELECT user_id, newest, CASE WHEN n < 3 THEN 'TOO_FEW' WHEN purchases = 0 THEN 'NO_CAPACITY' WHEN errors = 0 THEN 'NO_USE' WHEN lo < 0.05e0 THEN 'TOO_SMALL' ELSE 'CAPABLE' END AS reason FROM (SELECT user_id, count(*) AS n, max_by(event_type, event_id) AS newest, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE event_type = 'error') AS errors, min(value) AS lo FROM {{events}} GROUP BY user_id) f",
    # episodes
    "episode_openings": f"SELECT stream, tick, round(score, 6) AS score FROM {OPENINGS} o",
    "episode_timeline": f"SELECT id, revision, state, valid_from, lead(valid_from) OVER (PARTITION BY id ORDER BY revision) AS valid_to FROM (SELECT user_id AS id, event_id AS revision, us AS valid_from, CASE WHEN event_type = 'purchase' THEN 'CLOSED' ELSE 'OPEN' END AS state FROM {OBS} o) v",
    "latest_episode": f"SELECT stream, max(tick) AS tick, max_by(state, tick) AS state, max_by(class, tick) AS class FROM {EPISODES} e GROUP BY stream",
    "tick_spine": f"SELECT DISTINCT tick, tick % 2 = 0 AS half_day, tick % 4 = 0 AS day, tick % 28 = 0 AS week FROM {OBS} o",
    "query_restart_plan": f"SELECT event_type, event_id, CASE WHEN coalesce(within, t.before) IS NULL OR us - coalesce(within, t.before) > 7200000000 THEN 'REANCHOR' ELSE 'CONTINUE' END AS plan FROM (SELECT event_type, event_id, us, tick, lag(us) OVER (PARTITION BY event_type, tick ORDER BY us, event_id) AS within FROM {OBS} o) p JOIN (SELECT event_type, tick, lag(newest) OVER (PARTITION BY event_type ORDER BY tick) AS before FROM (SELECT event_type, tick, max(us) AS newest FROM {OBS} m GROUP BY event_type, tick) g) t USING (event_type, tick)",
    # incidents
    "incident_segments": f"SELECT segment, island, min(tick) AS opened, max(tick) AS last_opened, count(*) AS episodes FROM (SELECT segment, stream, tick, count(CASE WHEN before IS NULL OR tick - before > 2 THEN 1 END) OVER (PARTITION BY segment ORDER BY tick, stream ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT substr(stream, 1, 4) AS segment, stream, tick, lag(tick) OVER (PARTITION BY substr(stream, 1, 4) ORDER BY tick, stream) AS before FROM {OPENINGS} o) g) i GROUP BY segment, island",
    "incident_lifecycle": f"SELECT tick, open_streams, CASE WHEN open_streams > 0 THEN 'OPEN' WHEN coalesce(recent, 0) > 0 THEN 'MONITORING' ELSE 'RESOLVED' END AS state FROM (SELECT tick, open_streams, sum(open_streams) OVER (ORDER BY tick ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS recent FROM (SELECT tick, count(*) FILTER (WHERE state = 'OPEN') AS open_streams FROM {EPISODES} e GROUP BY tick) t) r",
    "incident_severity": f"SELECT tick, impact, CASE WHEN impact >= 0.9e0 THEN 'CRITICAL' WHEN impact >= 0.6e0 THEN 'MAJOR' WHEN impact > 0 THEN 'MINOR' ELSE 'NONE' END AS severity FROM (SELECT tick, round(1 - exp(sum(ln(1 - 0.5e0 * coalesce(score, 0.0e0)))), 6) AS impact FROM {SCORED} s GROUP BY tick) i",
    "axis_scores": f"SELECT axis, tick, covered, score, CASE WHEN covered = 0 THEN 'INSUFFICIENT' ELSE 'SCORED' END AS status FROM {AXES} a",
    "incident_signature": f"SELECT tick, demand, business, fault FROM {PIVOT} p WHERE demand IS NOT NULL AND business IS NOT NULL AND fault IS NOT NULL",
    "verdict_rules": f"SELECT tick, coalesce(min_by(class, rule_no) FILTER (WHERE lit_score >= 0.5e0 AND calm_score < 0.3e0), CASE WHEN count(lit_score) = 0 THEN 'INSUFFICIENT' ELSE 'NO_EVIDENCE' END) AS verdict FROM {FITS} f GROUP BY tick",
    "verdict_distribution": f"SELECT tick, class, round(CASE WHEN total = 0 THEN 0.25e0 ELSE weight / total END, 6) AS share FROM (SELECT *, sum(weight) OVER (PARTITION BY tick) AS total FROM (SELECT tick, class, coalesce(lit_score * (1 - calm_score), 0.0e0) AS weight FROM {FITS} f) w) s",
    "origin_ranking": f"SELECT tick, service, round(rating, 6) AS rating, coalesce(rating - runner_up >= 0.05e0 - 1e-9, true) AS decided FROM (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY rating DESC, service) AS k, lead(rating) OVER (PARTITION BY tick ORDER BY rating DESC, service) AS runner_up FROM (SELECT s.tick, s.service, 0.65e0 * s.share + 0.35e0 * coalesce(d.n, 0) / 3.0e0 AS rating FROM (SELECT tick, substr(stream, 6) AS service, count(*) FILTER (WHERE score >= 0.5e0) / 3.0e0 AS share FROM {SCORED} x GROUP BY tick, substr(stream, 6)) s LEFT JOIN (SELECT dependency, count(*) AS n FROM {EDGE_SET} e GROUP BY dependency) d ON d.dependency = s.service WHERE s.share > 0) r) k WHERE k = 1",
    "verification_checks": f"SELECT o.stream, o.tick, count(x.context_id) > 0 AS explained, coalesce(min(x.valid_from) <= o.tick, false) AS causal FROM {OPENINGS} o LEFT JOIN {CONTEXTS} x ON o.tick >= x.valid_from AND o.tick < x.valid_to GROUP BY o.stream, o.tick",
    "policy_decision": f"SELECT stream, tick, CASE WHEN peak IS NULL THEN 'WAIT' WHEN covered THEN 'HOLD' WHEN peak >= 0.8e0 THEN 'ACT' WHEN peak >= 0.5e0 THEN 'ASK' ELSE 'WATCH' END AS decision FROM (SELECT s.stream, s.tick, max(s.score) OVER (PARTITION BY s.stream ORDER BY s.tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS peak, c.tick IS NOT NULL AS covered FROM {SCORED} s LEFT JOIN (SELECT DISTINCT k.tick FROM {RATES} k JOIN {CONTEXTS} x ON k.tick >= x.valid_from AND k.tick < x.valid_to) c ON c.tick = s.tick) p",
    "feed_freshness": f"SELECT u.id AS user_id, CASE WHEN u.last_us IS NULL THEN 'NEVER' WHEN n.newest - u.last_us <= 86400000000 THEN 'WATCHING' ELSE 'STALE' END AS freshness FROM (SELECT c.c_custkey AS id, max(o.us) AS last_us FROM {{customer}} c LEFT JOIN {OBS} o ON o.user_id = c.c_custkey GROUP BY c.c_custkey) u CROSS JOIN (SELECT max(us) AS newest FROM {OBS} m) n",
    "confidence_nudge": f"SELECT id, revision, round(0.7e0 + least(0.05e0, greatest(0.0e0, (value - 100) / 1000)), 6) AS confidence FROM {VERSIONS} v",
    "incident_card": f"SELECT segment, count(*) AS episodes, min(tick) AS opened, round(max(score), 6) AS peak, max_by(stream, tick * 10 + length(stream) % 10) AS newest FROM (SELECT substr(stream, 1, 4) AS segment, min(stream) AS stream, tick, max(score) AS score FROM {OPENINGS} o GROUP BY substr(stream, 1, 4), tick) c GROUP BY segment",
}
