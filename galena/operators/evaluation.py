"""Models, calibration, forecasts and grading, each as one statement over the test tables.

A score is ``value / 500``; what it should find are errors.  Labels are the daily intervals of
six hours in which a service peaks.  Quantile envelopes are conditional quantiles of strata
(service, quarter of the day, weekend), which grow with the data only as counts do.
"""

from .detection import OPENINGS
from .statements import CONTEXTS, OBS

SCORES = f"(SELECT event_id, event_type, tick, CAST(floor(tick / 4.0e0) AS BIGINT) AS day, value / 500.0e0 AS score, event_type = 'error' AS hit, user_id, value FROM {OBS} o)"
#: Quarter of the day and weekend (day 0 was a Thursday), and whether a context lifts the tick.
STRATA = f"(SELECT o.event_id, o.event_type, o.tick, o.value, o.tick % 4 AS quarter, (CAST(floor(o.tick / 4.0e0) AS BIGINT) + 3) % 7 >= 5 AS weekend, o.tick >= 78912 AND o.tick < 78940 AS lifted FROM {OBS} o)"
AWARE = f"(SELECT event_type, quarter, weekend, lifted, count(*) AS n, {{q:value~0.1}} AS q10, {{q:value~0.5}} AS q50, {{q:value~0.9}} AS q90 FROM {STRATA} s GROUP BY event_type, quarter, weekend, lifted)"
BLIND = f"(SELECT event_type, quarter, weekend, {{q:value~0.5}} AS q50 FROM {STRATA} s GROUP BY event_type, quarter, weekend)"
COUNTS = f"(SELECT event_type, tick, count(*) AS n FROM {OBS} o GROUP BY event_type, tick)"
#: Forecast: the centred trend of seven ticks, and the mean deviation from it of each quarter of the day.
TREND = f"(SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY tick ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend, row_number() OVER (PARTITION BY event_type ORDER BY tick) AS k, count(*) OVER (PARTITION BY event_type) AS total FROM {COUNTS} c)"
FORECAST = f"""(
  SELECT t.event_type, t.tick, t.n, greatest(0.0e0, l.level + p.profile) AS forecast
  FROM {TREND} t
  JOIN (SELECT event_type, median(trend) AS level FROM {TREND} a WHERE k <= 0.8e0 * total AND k > 0.6e0 * total GROUP BY event_type) l ON l.event_type = t.event_type
  JOIN (SELECT event_type, tick % 4 AS quarter, avg(n - trend) AS profile FROM {TREND} b WHERE k <= 0.8e0 * total GROUP BY event_type, tick % 4) p ON p.event_type = t.event_type AND p.quarter = t.tick % 4
  WHERE t.k > 0.8e0 * t.total)"""
#: Conformal p-values of odd rows against the even rows of the same stream and day, ties counted in.
CONFORMAL = f"""(
  SELECT event_id, event_type, day, (1 + above) * 1.0e0 / (1 + cal) AS p
  FROM (SELECT *, count(CASE WHEN event_id % 2 = 0 THEN 1 END) OVER (PARTITION BY event_type, day ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above,
               count(CASE WHEN event_id % 2 = 0 THEN 1 END) OVER (PARTITION BY event_type, day) AS cal FROM {SCORES} s) c
  WHERE event_id % 2 = 1)"""
BINS = f"(SELECT least(9, CAST(floor(score * 10) AS BIGINT)) AS bin, count(*) AS n, avg(score) AS confidence, avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END) AS accuracy FROM {SCORES} s GROUP BY least(9, CAST(floor(score * 10) AS BIGINT)))"
#: One labelled interval per service and day: from the tick of the peak value, two ticks long.
LABELS = f"(SELECT event_type, day, max_by(tick, value) AS valid_from, max_by(tick, value) + 2 AS valid_to FROM {SCORES} s GROUP BY event_type, day)"
FOUND = f"(SELECT substr(stream, 6) AS service, stream, tick FROM {OPENINGS} o)"
GRADED = f"(SELECT l.event_type, l.day, l.valid_from, min(f.tick) AS found FROM {LABELS} l LEFT JOIN {FOUND} f ON f.service = l.event_type AND f.tick >= l.valid_from AND f.tick < l.valid_to GROUP BY l.event_type, l.day, l.valid_from)"
KINDS = f"(SELECT event_type, count(*) AS labelled, count(found) AS matched, CASE WHEN count(*) > 0 THEN count(found) * 1.0e0 / count(*) END AS recall FROM {GRADED} g GROUP BY event_type)"

STATEMENTS: dict[str, str] = {
    # features and envelopes
    "temporal_features": f"SELECT event_id, round(sin(2 * pi() * (us % 86400000000) / 86400000000.0e0), 6) AS tod_sin, round(cos(2 * pi() * (us % 86400000000) / 86400000000.0e0), 6) AS tod_cos, (CAST(floor(us / 86400000000) AS BIGINT) + 3) % 7 AS weekday, (CAST(floor(us / 86400000000) AS BIGINT) + 3) % 7 >= 5 AS weekend FROM {OBS} o",
    "event_features": f"SELECT o.event_id, count(c.context_id) AS event_count, round(coalesce(sum(greatest(0.0e0, c.multiplier - 1) * c.trust), 0), 6) AS event_lift, coalesce(max(c.trust), 0.0e0) AS trust_max FROM {OBS} o LEFT JOIN {CONTEXTS} c ON o.tick >= c.valid_from AND o.tick < c.valid_to GROUP BY o.event_id",
    "quantile_envelope": f"SELECT event_type, quarter, weekend, lifted, n, round(q10, 6) AS q10, round(greatest(q10, q50), 6) AS q50, round(greatest(q10, q50, q90), 6) AS q90 FROM {AWARE} a",
    "blind_twin_gap": f"SELECT a.event_type, a.quarter, a.weekend, a.lifted, round(a.q50 - b.q50, 6) AS gap FROM {AWARE} a JOIN {BLIND} b ON b.event_type = a.event_type AND b.quarter = a.quarter AND b.weekend = a.weekend",
    "envelope_decompose": f"SELECT s.event_id, round(greatest(0.0e0, a.q50 - b.q50), 6) AS event_part, round(a.q50 - greatest(0.0e0, a.q50 - b.q50), 6) AS base_part, round(s.value - a.q50, 6) AS residual FROM {STRATA} s JOIN {AWARE} a ON a.event_type = s.event_type AND a.quarter = s.quarter AND a.weekend = s.weekend AND a.lifted = s.lifted JOIN {BLIND} b ON b.event_type = s.event_type AND b.quarter = s.quarter AND b.weekend = s.weekend",
    "envelope_metrics": f"SELECT s.event_type, count(*) AS n, round(avg(CASE WHEN s.value <= a.q90 THEN 1.0e0 ELSE 0.0e0 END), 6) AS coverage, round(avg(CASE WHEN s.value BETWEEN a.q10 AND a.q90 THEN 1.0e0 ELSE 0.0e0 END), 6) AS inside, round(avg(greatest(0.9e0 * (s.value - a.q90), -0.1e0 * (s.value - a.q90))), 6) AS pinball FROM {STRATA} s JOIN {AWARE} a ON a.event_type = s.event_type AND a.quarter = s.quarter AND a.weekend = s.weekend AND a.lifted = s.lifted GROUP BY s.event_type",
    "time_split": f"SELECT event_id, event_type, k <= floor(total * 0.8e0) AS training FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, tick ORDER BY us, event_id) AS k, count(*) OVER (PARTITION BY event_type, tick) AS total FROM {OBS} o) s",
    "regular_grid_check": f"SELECT event_type, count(*) AS ticks, max(tick) - min(tick) + 1 AS span, count(*) = max(tick) - min(tick) + 1 AS regular FROM {COUNTS} c GROUP BY event_type",
    "seasonal_forecast": f"SELECT event_type, tick, n, round(forecast, 6) AS forecast FROM {FORECAST} f",
    "forecast_metrics": f"SELECT event_type, round(avg(abs(n - forecast)), 6) AS mae, round(sqrt(avg((n - forecast) * (n - forecast))), 6) AS rmse, round(sqrt(avg((n - forecast) * (n - forecast))) / avg(n), 6) AS nrmse, round(avg(forecast - n), 6) AS bias FROM {FORECAST} f GROUP BY event_type",
    # calibration
    "roc_auc": f"SELECT day, round((sum(CASE WHEN hit THEN mid ELSE 0.0e0 END) - count(*) FILTER (WHERE hit) * (count(*) FILTER (WHERE hit) + 1) / 2.0e0) / nullif(count(*) FILTER (WHERE hit) * count(*) FILTER (WHERE NOT hit), 0), 6) AS auc FROM (SELECT day, hit, rank() OVER (PARTITION BY day ORDER BY score) + (count(*) OVER (PARTITION BY day, score) - 1) / 2.0e0 AS mid FROM {SCORES} s) r GROUP BY day",
    "conformal_pvalue": f"SELECT event_id, event_type, round(p, 6) AS p, round(1 - p, 6) AS confidence FROM {CONFORMAL} c",
    "conformal_threshold": f"SELECT event_type, day, min(score) AS threshold FROM (SELECT event_type, day, score, row_number() OVER (PARTITION BY event_type, day ORDER BY score DESC, event_id) AS k, count(*) OVER (PARTITION BY event_type, day) AS cal FROM {SCORES} s WHERE event_id % 2 = 0) t WHERE k <= greatest(1.0e0, floor(0.2e0 * (cal + 1))) GROUP BY event_type, day",
    "conformal_coverage": f"SELECT alpha, count(*) AS n, round(avg(CASE WHEN p <= alpha THEN 1.0e0 ELSE 0.0e0 END), 6) AS found, round(abs(avg(CASE WHEN p <= alpha THEN 1.0e0 ELSE 0.0e0 END) - alpha), 6) AS error FROM {CONFORMAL} c CROSS JOIN (SELECT * FROM (VALUES (0.05e0), (0.1e0), (0.2e0)) AS x(alpha)) a GROUP BY alpha",
    "reliability_curve": f"SELECT s.bin, coalesce(b.n, 0) AS n, round(b.confidence, 6) AS confidence, round(b.accuracy, 6) AS accuracy FROM (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) AS x(bin)) s LEFT JOIN {BINS} b ON b.bin = s.bin",
    "expected_calibration_error": f"SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM {BINS} b",
    "drift_ks": f"SELECT event_type, day, round(max(abs(seen * 1.0e0 / nullif(total, 0) - old_seen * 1.0e0 / nullif(old_total, 0))), 6) AS d FROM (SELECT event_type, day, sum(fresh) OVER (PARTITION BY event_type, day ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen, sum(1 - fresh) OVER (PARTITION BY event_type, day ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS old_seen, sum(fresh) OVER (PARTITION BY event_type, day) AS total, sum(1 - fresh) OVER (PARTITION BY event_type, day) AS old_total FROM (SELECT event_type, day, value, 1 AS fresh FROM {SCORES} a UNION ALL SELECT event_type, day + 1 AS day, value, 0 AS fresh FROM {SCORES} b) u) w GROUP BY event_type, day",
    "seed_leakage_intersect": f"SELECT DISTINCT event_type, user_id FROM {SCORES} a WHERE event_id % 2 = 0 INTERSECT SELECT DISTINCT event_type, user_id FROM {SCORES} b WHERE event_id % 2 = 1",
    # grading
    "binary_metrics": f"SELECT day, tp, fp, fn, round(tp * 1.0e0 / nullif(tp + fp, 0), 6) AS precision_, round(tp * 1.0e0 / nullif(tp + fn, 0), 6) AS recall, round(fp * 1.0e0 / nullif(fp + tn, 0), 6) AS fpr FROM (SELECT day, count(*) FILTER (WHERE hit AND score >= 0.1e0) AS tp, count(*) FILTER (WHERE NOT hit AND score >= 0.1e0) AS fp, count(*) FILTER (WHERE hit AND score < 0.1e0) AS fn, count(*) FILTER (WHERE NOT hit AND score < 0.1e0) AS tn FROM {SCORES} s GROUP BY day) c",
    "label_ticks": f"SELECT c.event_type, c.tick, count(l.day) > 0 AS labelled FROM {COUNTS} c LEFT JOIN {LABELS} l ON l.event_type = c.event_type AND c.tick >= l.valid_from AND c.tick < l.valid_to GROUP BY c.event_type, c.tick",
    "detection_latency": f"SELECT event_type, day, found - valid_from AS latency FROM {GRADED} g",
    "symptom_scores": f"SELECT g.event_type, count(*) AS labelled, count(g.found) AS matched, round(count(g.found) * 1.0e0 / count(*), 6) AS recall, percentile_disc(0.95) WITHIN GROUP (ORDER BY g.found - g.valid_from) AS p95 FROM {GRADED} g GROUP BY g.event_type",
    "decision_windows": f"SELECT event_type, min(valid_from) AS opened, max(valid_to) AS closed, count(*) AS labels FROM {LABELS} l GROUP BY event_type",
    "decision_grades": f"SELECT f.stream, f.tick, count(l.day) > 0 AS handled FROM {FOUND} f LEFT JOIN {LABELS} l ON l.event_type = f.service AND f.tick >= l.valid_from AND f.tick < l.valid_to GROUP BY f.stream, f.tick",
    "decision_accuracy": f"SELECT count(*) AS decisions, count(day) AS right_ones, round(count(day) * 1.0e0 / nullif(count(*), 0), 6) AS accuracy FROM (SELECT f.stream, f.tick, max(l.day) AS day FROM {FOUND} f LEFT JOIN {LABELS} l ON l.event_type = f.service AND f.tick >= l.valid_from AND f.tick < l.valid_to GROUP BY f.stream, f.tick) d",
    "gate_failures": f"SELECT t.event_type, round(k.recall, 6) AS recall, t.floor_ FROM (SELECT * FROM (VALUES ('view', 0.5e0), ('click', 0.1e0), ('error', 0.9e0), ('refund', 0.5e0)) AS x(event_type, floor_)) t LEFT JOIN {KINDS} k ON k.event_type = t.event_type WHERE k.recall IS NULL OR k.recall < t.floor_",
    "negative_control": f"SELECT t.event_type, count(f.tick) AS outside FROM (SELECT DISTINCT event_type FROM {{events}}) t LEFT JOIN (SELECT x.service, x.tick FROM {FOUND} x LEFT ANTI JOIN {LABELS} l ON l.event_type = x.service AND x.tick >= l.valid_from AND x.tick < l.valid_to) f ON f.service = t.event_type GROUP BY t.event_type",
    "episode_characterization": f"SELECT t.event_type, count(f.tick) AS episodes, min(f.tick) AS first_tick, max(f.tick) AS last_tick FROM (SELECT DISTINCT event_type FROM {{events}}) t LEFT JOIN {FOUND} f ON f.service = t.event_type GROUP BY t.event_type",
    "run_overlap_rows": f"SELECT l.event_type, l.day, count(*) AS overlapping, count(*) FILTER (WHERE c.tick < l.valid_from + 1) AS inherited FROM {LABELS} l JOIN {COUNTS} c ON c.event_type = l.event_type AND c.tick < l.valid_to AND c.tick + 1 > l.valid_from GROUP BY l.event_type, l.day",
    "kpi_headline": f"SELECT CASE WHEN count(*) = 5 THEN 'OK' ELSE 'INCOMPLETE' END AS status, round(min(recall), 6) AS least_recall, CAST(sum(matched) AS BIGINT) AS matched FROM {KINDS} k",
    # reads and feeds
    "json_filter_group_min": f"SELECT {{k}} AS k, min(us) AS first_us, count(*) AS n FROM {OBS} o WHERE event_type = 'view' GROUP BY {{k}}",
    "context_from_fixtures": "SELECT o_orderkey AS fixture, o_orderdate AS kickoff, CASE WHEN o_orderpriority LIKE '1%' THEN 2.5e0 ELSE 1.5e0 END AS multiplier FROM {orders} WHERE o_orderstatus <> 'P'",
    "change_feed_normalize": "SELECT event_id AS change_id, CASE event_type WHEN 'signup' THEN 'rollout' WHEN 'purchase' THEN 'flag' WHEN 'error' THEN 'ledger' END AS feed, CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'ok' ELSE 'refused' END AS status FROM {events}",
    "offsets_to_intervals": f"SELECT o.event_id, a.start_us + o.off AS from_us, least(a.start_us + o.off + 3600000000, a.start_us + 2592000000000) AS to_us FROM (SELECT event_id, event_type, event_id % 1000 * 1000000 AS off FROM {{events}}) o JOIN (SELECT event_type, min(us) AS start_us FROM {OBS} m GROUP BY event_type) a ON a.event_type = o.event_type",
    "dataset_fingerprint": "SELECT lang, count(*) AS n, {xor:h} AS mixed, CAST(sum(h % 1000003) AS BIGINT) AS total FROM (SELECT lang, {digits:x} AS h FROM (SELECT lang, {sha:concat_ws('|', CAST(doc_id AS VARCHAR(20)), source, text)} AS x FROM {documents}) d) f GROUP BY lang",
    "forbidden_attribute_guard": "SELECT event_id, {k} AS k, CASE WHEN {k} IN (13, 66) THEN 'forbidden' ELSE 'ok' END AS status FROM {events}",
}
