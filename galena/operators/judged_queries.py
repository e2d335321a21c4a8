"""Queries of ratios, judgement and monitors, each with SQL of its own that follows the definition.

Events, ticks and segments are those of ``queries``.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from . import decompose, grading, judgement, monitors, policy, ratios, selection, sequences
from .queries import EVENTS, HOUR, _events

DAY = 24 * HOUR
#: Metric, whether a fall is bad, floor of the baseline, trigger, deformation of score 1.
RATIO_RULES = [
    ("source_entropy", True, 0.25, 0.3, 0.7),
    ("auth_failure", False, 0.01, 1.0, 5.0),
    ("syn_ack", False, 0.1, 0.5, 2.0),
    ("rpc_amplification", False, 0.05, 1.0, 5.0),
    ("path_entropy", True, 0.25, 0.3, 0.7),
    ("conversion", True, 0.01, 0.3, 0.8),
    ("interarrival_variation", True, 0.1, 0.4, 0.8),
    ("crowd_coherence", True, 0.1, 0.4, 0.8),
]
#: The classes of verdict in order.
VERDICT_RULES = [
    judgement.Rule("COMBINATION", lit=("SECURITY", "RELIABILITY")),
    judgement.Rule("CODE_CONFIG_FAULT", lit=("RELIABILITY", "CHANGE_CONFIG"), calm=("SECURITY",)),
    judgement.Rule("ATTACK", lit=("SECURITY",), calm=("RELIABILITY",)),
    judgement.Rule("OPERATIONAL_FAULT", lit=("RELIABILITY",), calm=("SECURITY",), absent=("CHANGE_CONFIG",)),
    judgement.Rule("EXPECTED_EVENT", calm=("SECURITY", "RELIABILITY"), forbids=("RESIDUAL_EXCEED",)),
]
THRESHOLDS = {"SECURITY": 0.5, "RELIABILITY": 0.5, "CHANGE_CONFIG": 0.5, "BUSINESS_IMPACT": 0.5}
SUBTYPES = [judgement.Subtype("CAPACITY_SHORTAGE", "OPERATIONAL_FAULT", requires=("SATURATION",))]
DEPENDENCIES = [("view", "click"), ("click", "purchase"), ("purchase", "error"), ("signup", "click")]


def _measures(spark, sf_dir):
    """Eight ratios of each segment and tick; a tick with a value above 400 is ambiguous."""
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    key = ["segment", "tick"]
    are = lambda kind: F.sum((F.col("event_type") == kind).cast("double"))
    counts = e.groupBy(*key).agg(F.count("*").alias("n"), F.max("value").alias("peak"), are("error").alias("errors"), are("purchase").alias("bought"), are("click").alias("clicks"), are("view").alias("views"), are("signup").alias("signups"))
    capped = lambda a, b: F.least(F.lit(20.0), F.col(a) / F.greatest(F.col(b), F.lit(1.0)))
    simple = {"auth_failure": F.col("errors") / F.col("n"), "syn_ack": capped("clicks", "views"), "rpc_amplification": capped("signups", "bought"), "conversion": F.col("bought") / F.col("n")}
    apart = F.col("us") - F.lag("us").over(Window.partitionBy(*key).orderBy("us", "event_id"))
    gaps = e.select(*key, apart.alias("gap")).groupBy(*key).agg(F.count("gap").alias("gaps"), F.when((F.count("gap") >= 5) & (F.avg("gap") > 0), F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0))).alias("interarrival_variation"))
    hours = e.groupBy(*key, F.floor(F.col("us") / HOUR).alias("hour")).agg(are("view").alias("x"), are("click").alias("y"))
    entropies = {m: selection.entropy(e, key, c, 6).select(*key, F.col("entropy").alias(m)) for m, c in (("source_entropy", "user_id"), ("path_entropy", "k"))}
    wide = counts.withColumns(simple).join(gaps, key)
    wide = wide.join(selection.coherence(hours, key, "x", "y", 5).select(*key, F.col("coherence").alias("crowd_coherence")), key)
    for one in entropies.values():
        wide = wide.join(one, key)
    each = F.explode(F.array(*(F.struct(F.lit(r[0]).alias("metric"), F.col(r[0]).alias("value")) for r in RATIO_RULES)))
    return wide.withColumn("m", each).select(F.concat(F.lit("seg"), "segment").alias("stream"), "m.metric", "tick", F.round("m.value", 6).alias("value"), "n", (F.col("peak") > 400).alias("ambiguous"))


def ratio_rules_status(spark, sf_dir):
    got = ratios.deformed(_measures(spark, sf_dir), spark.createDataFrame(RATIO_RULES, ratios.RULE))
    return got.withColumns({"deformation": F.round("deformation", 5), "score": F.round("score", 5)})


def _assessments(spark, sf_dir):
    """Four axes of each segment and tick: shares of events as scores, kinds of symptom from large values."""
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    n = lambda test: F.sum(F.expr(test).cast("long"))
    got = e.groupBy((F.col("tick") * 3 + F.col("segment")).alias("id")).agg(
        F.count("*").alias("n"), *(n(f"event_type = '{t}'").alias(t) for t in ("view", "click", "purchase", "error", "signup")), n("value > 60").alias("dear"),
        n("event_type = 'error' AND value > 20").alias("ratio"), n("event_type = 'error' AND value > 120").alias("burst"), n("value > 150").alias("full"), n("event_type = 'click' AND value > 100").alias("edge"),
        n("event_type = 'signup' AND k < 20").alias("config"), n("event_type = 'purchase' AND value > 90").alias("residual"),
    )
    score = lambda needs, x, by: F.when(F.col(needs) > 0, F.least(F.lit(1.0), by * F.col(x) / F.col("n")))
    kinds = lambda **of: F.filter(F.array(*(F.when(F.col(c) > 0, k) for k, c in of.items())), lambda k: k.isNotNull())
    axes = {
        "SECURITY": (score("signup", "error", 2.0), kinds(RATIO_DEFORM="ratio", LOG_BURST="burst")),
        "RELIABILITY": (score("purchase", "dear", 1.6), kinds(SATURATION="full", EDGE_DEGRADED="edge")),
        "CHANGE_CONFIG": (score("view", "signup", 2.0), kinds(CONFIG_CHANGE="config")),
        "BUSINESS_IMPACT": (score("click", "purchase", 2.0), kinds(RESIDUAL_EXCEED="residual")),
    }
    each = F.array(*(F.struct(F.lit(a).alias("axis"), s.alias("score"), k.alias("kinds")) for a, (s, k) in axes.items()))
    return got.select("id", F.explode(each).alias("a")).select("id", "a.*")


def _fused(spark, sf_dir):
    return judgement.fuse(_assessments(spark, sf_dir), VERDICT_RULES, THRESHOLDS, SUBTYPES)


def verdict_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("id", "status", "verdict", "subtype", F.round("confidence", 6).alias("confidence"), F.array_join("kinds", ",").alias("kinds"), F.array_join("rejected", "; ").alias("rejected"))


def verdict_shares(spark, sf_dir):
    return _fused(spark, sf_dir).select("id", F.explode("shares").alias("s")).select("id", "s.verdict", F.round("s.share", 6).alias("share"))


def _episodes(events, above=60):
    e = events.where(F.col("value") > above).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    callee = F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "error", "ghost", ""))), F.col("k") % 6 + 1)
    return e.select(F.col("user_id").alias("incident"), F.col("event_type").alias("service"), F.when(F.col("k") % 4 < 3, "EDGE_DEGRADED").otherwise("LATENCY").alias("kind"), F.concat(F.lit("dependency."), callee).alias("signal"), F.col("us").alias("opened"))


def origin_collapse(spark, sf_dir):
    """Incidents are users, episodes their events above 60; of the six callees that a signal may name, one is unknown and one empty."""
    got = judgement.origins(_episodes(_events(spark, sf_dir)), spark.createDataFrame(DEPENDENCIES, "service string, dependency string"))
    return got.select("incident", "rank", "service", *(F.round(c, 6).alias(c) for c in ("score", "onset", "reach", "accusation")), "origin")


SERVICES = ["view", "click", "purchase", "error", "signup"]
LIVE = ("OPEN", "MITIGATING", "MONITORING")
#: The ladder of actions, what it needs to act, and the floors of attention.
ACTION_RULES = [
    policy.ActionRule("resolved-incident-needs-nothing", "SUPPRESS", states=("RESOLVED",)),
    policy.ActionRule("contain-a-verified-attack", "AUTO_CONTAIN_THEN_ESCALATE", verdicts=("ATTACK", "COMBINATION"), confirmed=True, confidence=0.7),
    policy.ActionRule("hand-over-an-unverified-attack", "ESCALATE_TO_HUMAN", verdicts=("ATTACK", "COMBINATION")),
    policy.ActionRule("remediate-a-verified-fault", "ACT", verdicts=("OPERATIONAL_FAULT", "CODE_CONFIG_FAULT"), confirmed=True, confidence=0.75),
    policy.ActionRule("hand-over-a-fault-we-cannot-confirm", "ESCALATE_TO_HUMAN", verdicts=("OPERATIONAL_FAULT", "CODE_CONFIG_FAULT")),
    policy.ActionRule("tell-someone-what-we-cannot-name", "ALERT", statuses=("INSUFFICIENT",)),
    policy.ActionRule("nothing-is-happening", "SUPPRESS", statuses=("NO_EVIDENCE",)),
    policy.ActionRule("context-explains-the-surge", "SUPPRESS", verdicts=("EXPECTED_EVENT",)),
    policy.ActionRule("anything-unrecognised-goes-to-a-person", "ESCALATE_TO_HUMAN"),
]
FLOORS = [
    policy.Floor("measured-user-impact-is-never-silent", "ALERT", LIVE, impact=0.2),
    policy.Floor("a-live-incident-that-matters-is-never-silent", "ALERT", LIVE, severity="MEDIUM"),
    policy.Floor("critical-severity-reaches-a-person", "ESCALATE_TO_HUMAN", LIVE, severity="CRITICAL"),
]
ATTENTION = {"SUPPRESS": 0, "ALERT": 1, "ACT": 2, "ESCALATE_TO_HUMAN": 2, "AUTO_CONTAIN_THEN_ESCALATE": 2}


def incident_verification(spark, sf_dir):
    """Incidents like those of ``origin_collapse``, of events above 150, against the services that a user has twelve events of, and a similarity by their mean value."""
    events = _events(spark, sf_dir)
    topology = spark.createDataFrame(DEPENDENCIES, "service string, dependency string")
    episodes = _episodes(events, 150)
    origins = judgement.origins(episodes, topology)
    incidents = origins.groupBy("incident").agg(F.max(F.when(F.col("origin"), F.col("service"))).alias("origin"))
    coverage = events.groupBy(F.col("user_id").alias("incident"), F.col("event_type").alias("service")).agg(F.count("*").alias("n")).where("n >= 12")
    matches = events.groupBy(F.col("user_id").alias("incident")).agg((1 - F.abs(F.avg("value") - 50) / 100).alias("similarity"))
    services = spark.createDataFrame([(s,) for s in SERVICES], "service string")
    return policy.verified(incidents, episodes, topology, services, coverage, matches, 20, 12 * HOUR)


def policy_ladder(spark, sf_dir):
    """A tick of six hours of a user is one of an incident; its verdict comes from the event with the highest k."""
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = F.max_by("event_type", F.struct("k", "event_id"))
    verdict = F.when(kind == "error", "ATTACK").when(kind == "click", "OPERATIONAL_FAULT").when(kind == "view", "EXPECTED_EVENT")
    top = F.max("value")
    ticks = e.groupBy(F.col("user_id").alias("incident"), F.col("tick").alias("at")).agg(
        F.when(top > 150, "CRITICAL").when(top > 80, "HIGH").when(top > 40, "MEDIUM").otherwise("LOW").alias("severity"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("value") / 100)).alias("impact"),
        F.max(F.when(F.col("value") > 10, F.col("event_type"))).alias("origin"), F.count_distinct("event_type").alias("services"),
        verdict.alias("verdict"), F.when(verdict.isNotNull(), F.round(0.4 + F.least(F.lit(1.0), top / 100) * 0.6, 3)).alias("confidence"),
        (F.max("k") % 4 > 0).alias("confirmed"), F.max("k").alias("k"),
    )
    state = F.when(F.col("at") % 7 == 0, "RESOLVED").when(F.col("at") % 7 == 6, "MONITORING").otherwise("OPEN")
    status = F.when(F.col("verdict").isNotNull(), "DECIDED").when(F.col("k") % 2 == 0, "INSUFFICIENT").otherwise("NO_EVIDENCE")
    got = policy.decided(
        ticks.withColumns({"state": state, "status": status}), ACTION_RULES, FLOORS, policy.Guards(0.75, 3, "ESCALATE_TO_HUMAN"), ("LOW", "MEDIUM", "HIGH", "CRITICAL"),
        ATTENTION, ("ACT", "AUTO_CONTAIN_THEN_ESCALATE"), ("SUPPRESS", "ALERT"),
    )
    return got.withColumns({c: F.array_join(c, ",") for c in ("guards", "floors", "approvals")})


def policy_governed(spark, sf_dir):
    """A purchase is a decision on its service and segment; a signup opens a window of an hour on its segment."""
    e = _events(spark, sf_dir)
    action = F.when(F.col("value") > 60, "ACT").when(F.col("value") > 30, "ESCALATE_TO_HUMAN").when(F.col("value") > 10, "ALERT").otherwise("SUPPRESS")
    asked = F.array_compact(F.array(F.when(F.col("value") > 100, "severity"), F.when(F.col("user_id") % 10 == 0, "services")))
    place = F.concat(F.lit("seg"), "segment")
    decisions = e.where("event_type = 'purchase'").select(F.col("event_id").alias("decision_id"), F.col("us").alias("at"), F.array("event_type", place).alias("services"), F.col("segment").cast("string").alias("class"), action.alias("action"), asked.alias("approvals"))
    freeze = F.col("value") > 50
    windows = e.where("event_type = 'signup'").select(
        F.col("event_id").alias("window_id"), F.col("us").alias("start"), (F.col("us") + HOUR).alias("end"), F.when(freeze, "CHANGE_FREEZE").otherwise("MAINTENANCE").alias("kind"),
        F.when(freeze, F.array(place)).otherwise(F.array(F.lit("purchase"), place)).alias("window_services"), F.array(F.lit("0"), F.lit("1")).alias("classes"), F.lit("ALERT").alias("most"),
    )
    critical = e.where("event_type = 'purchase' AND value > 5").groupBy(place.alias("service")).agg(F.max("value").alias("most")).where("most > 400").select("service")
    got = policy.governed(decisions, windows, critical, ATTENTION, HOUR, ("ACT",), ("SUPPRESS", "ALERT"), ("ESCALATE_TO_HUMAN",), "ESCALATE_TO_HUMAN")
    return got.withColumn("approvals", F.array_join("approvals", ","))


def drift_ks_windows(spark, sf_dir):
    e = _events(spark, sf_dir)
    series = e.select(F.col("event_type").alias("stream"), F.col("us").alias("at"), F.col("event_id").alias("id"), "value")
    return monitors.ks_windows(series, DAY).withColumn("distance", F.round("distance", 6))


FEATURES = ["n", "mean", "peak", "errors", "bought"]


def isolation_forest_score(spark, sf_dir):
    """How isolated each user's tick is by number, mean and peak of its events and shares of errors and purchases."""
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("double"))
    rows = _events(spark, sf_dir).groupBy("user_id", "tick").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"), share("error").alias("errors"), share("purchase").alias("bought"))
    rows = rows.withColumn("id", F.struct("user_id", "tick"))
    scored = monitors.isolation_scores(rows, monitors.isolation_trees(rows, FEATURES), FEATURES)
    return scored.select("id.user_id", "id.tick", F.round("score", 9).alias("score"))


def sequence_pca_error(spark, sf_dir):
    """Eight events of a user with gaps of at most three days: value, gap and whether it is an error; sequences with no value above 150 are normal."""
    e = _events(spark, sf_dir)
    apart = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    steps = e.select(F.col("user_id").alias("stream"), F.col("us").alias("at"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("value"), (F.least(apart, F.lit(3 * DAY)) / DAY).alias("gap"), (F.col("event_type") == "error").cast("double").alias("error"))
    found = sequences.sequences(steps, ["value", "gap", "error"], 3 * DAY)
    calm = ~F.exists(F.filter("vector", lambda x, i: i % 3 == 0), lambda x: x > 1.5)
    return sequences.reconstruction_error(found, calm, 6).select("stream", "session", "part", "first_id", F.round("error", 6).alias("error"))


def decomposition_residuals(spark, sf_dir):
    """Breaches above the band of the decomposition."""
    return decompose.query(spark, sf_dir).where("score > 0 AND residual > 0")


def kind_scores(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    found = e.select(F.col("event_type").alias("kind"), F.when(F.col("value") > 60, F.col("event_id")).alias("symptom"), F.when(F.col("k") < 50, F.col("event_id")).alias("label"), (F.col("value") - 60).alias("latency"))
    return grading.kind_scores(found).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def reference_windows(spark, sf_dir):
    """Decisions are purchases; they refer to the events before and after theirs, which are labels if they are errors."""
    e = _events(spark, sf_dir)
    decisions = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.array(F.col("event_id") - 1, F.col("event_id") + 1).alias("refs"))
    labels = e.where("event_type = 'error'").select(F.col("event_id").alias("label"), F.col("us").alias("start"), (F.col("us") + HOUR).alias("end"))
    return grading.reference_windows(decisions, labels).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


def range_scan_page(spark, sf_dir):
    """The first 100 purchases of three days in order of time; the page is the feature."""
    e = _events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "us", "value")
    start = 1_704_153_600_000_000
    return grading.range_page(e, "us", start, start + 3 * DAY, [F.asc("us"), F.asc("event_id")], 100, 7 * DAY)


def offset_drift_check(spark, sf_dir):
    """Shipping of an order was asked to begin 30 days after it and to end after 90; more than 40 days off either is too much."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    shipped = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    days = lambda c: F.datediff(c, "o_orderdate").cast("long")
    found = orders.join(shipped, "id").select("id", days("first").alias("start"), days("last").alias("end"), F.lit(30).alias("wanted_start"), F.lit(90).alias("wanted_end"))
    return monitors.offset_drift(found, 40)


E_K = f"(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {EVENTS})"
_ASSESSED = f"""a AS (SELECT tick * 3 + segment AS id,
  CASE WHEN bool_or(event_type = 'signup') THEN least(1.0, 2.0 * sum((event_type = 'error')::INT) / count(*)) END AS s, CASE WHEN bool_or(event_type = 'purchase') THEN least(1.0, 1.6 * sum((value > 60)::INT) / count(*)) END AS r,
  CASE WHEN bool_or(event_type = 'view') THEN least(1.0, 2.0 * sum((event_type = 'signup')::INT) / count(*)) END AS c,
  bool_or(event_type = 'error' AND value > 20) AS ratio, bool_or(event_type = 'error' AND value > 120) AS burst, bool_or(value > 150) AS sat, bool_or(event_type = 'click' AND value > 100) AS edge,
  bool_or(event_type = 'signup' AND k < 20) AS config, bool_or(event_type = 'purchase' AND value > 90) AS residual FROM {E_K} GROUP BY tick, segment),
f AS (
  SELECT id, 1 AS no, 'COMBINATION' AS verdict, CASE WHEN coalesce(s, 0) < 0.5 THEN 'SECURITY not lit' WHEN coalesce(r, 0) < 0.5 THEN 'RELIABILITY not lit' END AS unmet, coalesce(s, 0.5) * coalesce(r, 0.5) AS support, concat_ws(',', CASE WHEN edge THEN 'EDGE_DEGRADED' END, CASE WHEN burst THEN 'LOG_BURST' END, CASE WHEN ratio THEN 'RATIO_DEFORM' END, CASE WHEN sat THEN 'SATURATION' END) AS kinds, ratio OR burst OR sat OR edge OR config OR residual AS present FROM a
  UNION ALL SELECT id, 2, 'CODE_CONFIG_FAULT', CASE WHEN coalesce(r, 0) < 0.5 THEN 'RELIABILITY not lit' WHEN coalesce(c, 0) < 0.5 THEN 'CHANGE_CONFIG not lit' WHEN coalesce(s, 1) >= 0.5 THEN 'SECURITY not calm' END, coalesce(r, 0.5) * coalesce(c, 0.5) * (1 - coalesce(s, 0.5)), concat_ws(',', CASE WHEN config THEN 'CONFIG_CHANGE' END, CASE WHEN edge THEN 'EDGE_DEGRADED' END, CASE WHEN sat THEN 'SATURATION' END), ratio OR burst OR sat OR edge OR config OR residual FROM a
  UNION ALL SELECT id, 3, 'ATTACK', CASE WHEN coalesce(s, 0) < 0.5 THEN 'SECURITY not lit' WHEN coalesce(r, 1) >= 0.5 THEN 'RELIABILITY not calm' END, coalesce(s, 0.5) * (1 - coalesce(r, 0.5)), concat_ws(',', CASE WHEN burst THEN 'LOG_BURST' END, CASE WHEN ratio THEN 'RATIO_DEFORM' END), ratio OR burst OR sat OR edge OR config OR residual FROM a
  UNION ALL SELECT id, 4, 'OPERATIONAL_FAULT', CASE WHEN coalesce(r, 0) < 0.5 THEN 'RELIABILITY not lit' WHEN coalesce(s, 1) >= 0.5 THEN 'SECURITY not calm' WHEN coalesce(c, 0) >= 0.5 THEN 'CHANGE_CONFIG lit' END, coalesce(r, 0.5) * (1 - coalesce(s, 0.5)) * (1 - coalesce(c, 0.5)), concat_ws(',', CASE WHEN edge THEN 'EDGE_DEGRADED' END, CASE WHEN sat THEN 'SATURATION' END), ratio OR burst OR sat OR edge OR config OR residual FROM a
  UNION ALL SELECT id, 5, 'EXPECTED_EVENT', CASE WHEN residual THEN 'refuted' WHEN coalesce(s, 1) >= 0.5 THEN 'SECURITY not calm' WHEN coalesce(r, 1) >= 0.5 THEN 'RELIABILITY not calm' END, CASE WHEN residual THEN 0 ELSE (1 - coalesce(s, 0.5)) * (1 - coalesce(r, 0.5)) END, '', ratio OR burst OR sat OR edge OR config OR residual FROM a),
g AS (SELECT *, CASE WHEN sum(support) OVER (PARTITION BY id) > 0 THEN support / sum(support) OVER (PARTITION BY id) ELSE 0.2 END AS share, CASE WHEN present THEN min(CASE WHEN unmet IS NULL THEN no END) OVER (PARTITION BY id) END AS winner FROM f)"""


def _ratio(metric: str, value: str, source: str = EVENTS, n: str = "count(*)", peak: str = "max(value)") -> str:
    return f"SELECT segment, tick, '{metric}' AS metric, round({value}, 6) AS value, {n} AS n, {peak} > 400 AS ambiguous FROM {source} GROUP BY segment, tick"


_HOURLY = f"(SELECT segment, tick, us // 3600000000 AS hour, sum((event_type = 'view')::INT) AS x, sum((event_type = 'click')::INT) AS y, count(*) AS c, max(value) AS v FROM {EVENTS} GROUP BY segment, tick, hour)"
_GAPS = f"(SELECT *, us - lag(us) OVER (PARTITION BY segment, tick ORDER BY us, event_id) AS gap FROM {EVENTS})"
ORACLES = {
    "ratio_rules_status": "WITH m AS (" + " UNION ALL ".join([
        _ratio("source_entropy", "CASE WHEN count(*) >= 6 THEN entropy(user_id) END"),
        _ratio("path_entropy", "CASE WHEN count(*) >= 6 THEN entropy(k) END", E_K),
        _ratio("auth_failure", "avg((event_type = 'error')::INT)"),
        _ratio("conversion", "avg((event_type = 'purchase')::INT)"),
        _ratio("syn_ack", "least(20.0, sum((event_type = 'click')::INT) / greatest(sum((event_type = 'view')::INT), 1))"),
        _ratio("rpc_amplification", "least(20.0, sum((event_type = 'signup')::INT) / greatest(sum((event_type = 'purchase')::INT), 1))"),
        _ratio("interarrival_variation", "CASE WHEN count(gap) >= 5 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END", _GAPS),
        _ratio("crowd_coherence", "CASE WHEN count(*) >= 5 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN least(1.0, greatest(0.0, covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)))) END", _HOURLY, "CAST(sum(c) AS BIGINT)", "max(v)"),
    ]) + f"""), r(metric, way, floor_, trigger_, full_) AS (VALUES {", ".join(f"('{m}', {-1 if falls else 1}, {floor}, {trigger}, {full})" for m, falls, floor, trigger, full in RATIO_RULES)}),
u AS (SELECT *, n >= 6 AND NOT ambiguous AND value IS NOT NULL AS usable FROM m),
b AS (SELECT DISTINCT ON (segment, metric) segment, metric, tick AS first_tick, value AS base FROM u WHERE usable ORDER BY segment, metric, tick),
d AS (SELECT u.*, b.first_tick, r.trigger_, r.full_, greatest(0, r.way * (value - base)) / greatest(base, floor_) AS deformation FROM u JOIN r USING (metric) LEFT JOIN b USING (segment, metric))
SELECT 'seg' || segment AS stream, metric, tick, CASE WHEN NOT usable THEN 'INSUFFICIENT' WHEN tick = first_tick THEN 'WARMING' WHEN deformation >= trigger_ THEN 'BREACH' ELSE 'CLEAR' END AS status,
  CASE WHEN usable THEN round(deformation, 5) END AS deformation, CASE WHEN usable AND deformation >= trigger_ THEN round(least(1.0, deformation / full_), 5) END AS score FROM d""",
    "verdict_fusion": f"""WITH {_ASSESSED}
SELECT id, CASE WHEN NOT bool_or(present) THEN 'NO_EVIDENCE' WHEN max(winner) IS NULL THEN 'INSUFFICIENT' ELSE 'DECIDED' END AS status, max(verdict) FILTER (WHERE no = winner) AS verdict,
  CASE WHEN bool_or(no = winner AND verdict = 'OPERATIONAL_FAULT' AND kinds LIKE '%SATURATION%') THEN 'CAPACITY_SHORTAGE' END AS subtype,
  round(max(0.4 + 0.3 * share + 0.3 * least(1, (CASE WHEN kinds = '' THEN 0 ELSE 1 + length(kinds) - length(replace(kinds, ',', '')) END) / 3)) FILTER (WHERE no = winner), 6) AS confidence,
  max(kinds) FILTER (WHERE no = winner) AS kinds, string_agg(verdict || ': ' || coalesce(unmet, 'outranked'), '; ' ORDER BY no) FILTER (WHERE no <> winner) AS rejected FROM g GROUP BY id""",
    "verdict_shares": f"WITH {_ASSESSED} SELECT id, verdict, round(share, 6) AS share FROM g WHERE present",
    "origin_collapse": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS i, event_type AS s, us AS t, CASE WHEN k % 4 < 3 THEN (['view', 'click', 'purchase', 'error', 'ghost', NULL])[k % 6 + 1] END AS callee FROM {E_K} WHERE value > 60),
edges(a, b) AS (VALUES {", ".join(map(str, DEPENDENCIES))}), up(a, b) AS (SELECT a, b FROM edges UNION SELECT up.a, edges.b FROM up JOIN edges ON edges.a = up.b),
o AS (SELECT i, s, min(t) AS t FROM (SELECT i, s, t FROM e UNION ALL SELECT i, callee, t FROM e WHERE EXISTS (SELECT 1 FROM edges WHERE a = e.s AND b = e.callee)) GROUP BY i, s),
x AS (SELECT o.i, o.s, CASE WHEN z.hi > z.lo THEN 1 - (o.t - z.lo) / (z.hi - z.lo) ELSE 1 END AS onset,
  CASE WHEN z.n > 1 THEN (SELECT count(*) FROM o p JOIN up ON up.a = p.s WHERE p.i = o.i AND up.b = o.s AND p.s <> o.s) / (z.n - 1) ELSE 1 END AS reach,
  CASE WHEN z.edges > 0 THEN greatest(0, (SELECT count(*) FROM e WHERE e.i = o.i AND e.callee = o.s) - (SELECT count(*) FROM e WHERE e.i = o.i AND e.s = o.s AND e.callee IS NOT NULL)) / z.edges ELSE 0 END AS accusation
  FROM o JOIN (SELECT i, min(t) AS lo, max(t) AS hi, count(*) AS n, (SELECT count(callee) FROM e WHERE e.i = o.i) AS edges FROM o GROUP BY i) z ON z.i = o.i),
y AS (SELECT *, 0.3 * onset + 0.35 * reach + 0.35 * accusation AS score FROM x)
SELECT i AS incident, CAST(row_number() OVER w AS INTEGER) AS rank, s AS service, round(score, 6) AS score, round(onset, 6) AS onset, round(reach, 6) AS reach, round(accusation, 6) AS accusation,
  row_number() OVER w = 1 AND coalesce(score - lead(score) OVER w >= 0.05 - 1e-9, true) AS origin FROM y WINDOW w AS (PARTITION BY i ORDER BY round(score, 12) DESC, s)""",
    "drift_ks_windows": f"""WITH s AS (SELECT event_type AS stream, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS place FROM {EVENTS} WHERE value IS NOT NULL),
p AS (SELECT a.stream, a.place, a.event_id, b.value, b.place > a.place - 30 AS fresh FROM s a JOIN s b ON b.stream = a.stream AND b.place BETWEEN a.place - 99 AND a.place WHERE a.place >= 99),
d AS (SELECT *, abs(sum(fresh::INT) OVER w / 30 - sum((NOT fresh)::INT) OVER w / 70) AS d FROM p WINDOW w AS (PARTITION BY stream, place ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT stream, place, event_id AS id, round(max(d), 6) AS distance, max(d) > sqrt(-ln(0.005) / 30) AS alarm FROM d GROUP BY stream, place, event_id""",
    "offset_drift_check": "SELECT l_orderkey AS id, min(l_shipdate::DATE - o_orderdate::DATE) - 30 AS start_drift, max(l_shipdate::DATE - o_orderdate::DATE) - 90 AS end_drift, greatest(abs(min(l_shipdate::DATE - o_orderdate::DATE) - 30), abs(max(l_shipdate::DATE - o_orderdate::DATE) - 90)) > 40 AS exceeded FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey",
}
ORIGIN_SQL = ORACLES["origin_collapse"].replace("value > 60", "value > 150")
ORACLES["incident_verification"] = f"""WITH oc AS ({ORIGIN_SQL}), ev AS (SELECT user_id AS i, event_type AS s, us AS t, CASE WHEN k % 4 < 3 THEN (['view', 'click', 'purchase', 'error', 'ghost', NULL])[k % 6 + 1] END AS callee FROM {E_K} WHERE value > 150),
topo(a, b) AS (VALUES {", ".join(map(str, DEPENDENCIES))}),
inc AS (SELECT incident, max(service) FILTER (WHERE origin) AS origin FROM oc GROUP BY incident),
t AS (SELECT incident, origin, (SELECT min(t) FROM ev WHERE i = incident AND (s = origin OR callee = origin)) AS own, (SELECT min(t) FROM ev WHERE i = incident AND s <> origin AND callee IS DISTINCT FROM origin) AS other,
  NOT EXISTS (SELECT 1 FROM oc WHERE oc.incident = inc.incident AND (SELECT count(*) FROM events e WHERE e.user_id = oc.incident AND e.event_type = oc.service) < 12) AS covered,
  NOT EXISTS (SELECT 1 FROM ev WHERE i = incident AND callee IS NOT NULL AND NOT EXISTS (SELECT 1 FROM topo WHERE a = ev.s AND b = ev.callee)) AS dependencies,
  (SELECT abs(avg(value) - 50) / 100 <= 0.1 FROM events WHERE user_id = incident) AS memory FROM inc),
c AS (SELECT incident, coalesce(own <= coalesce(other, own) + {12 * HOUR}, false) AS temporal, covered, dependencies, memory FROM t)
SELECT incident, if(temporal, 'PASSED', 'FAILED') AS temporal, if(covered, 'PASSED', 'FAILED') AS covered, if(dependencies, 'PASSED', 'FAILED') AS dependencies, if(memory, 'PASSED', 'FAILED') AS memory, temporal AND covered AND dependencies AND memory AS confirmed FROM c"""
ORACLES["policy_ladder"] = f"""WITH t AS (
  SELECT user_id AS incident, tick AS at, max(value) AS top, CASE WHEN max(value) > 150 THEN 4 WHEN max(value) > 80 THEN 3 WHEN max(value) > 40 THEN 2 ELSE 1 END AS sev, max(value) FILTER (WHERE event_type = 'purchase') / 100 AS impact,
    max(event_type) FILTER (WHERE value > 10) AS origin, count(DISTINCT event_type) AS services, arg_max(event_type, k * 100000000 + event_id) AS kind, max(k) AS k, tick % 7 AS phase FROM {E_K} GROUP BY user_id, tick),
u AS (SELECT *, kind IN ('error', 'click', 'view') AS named, round(0.4 + least(1.0, top / 100) * 0.6, 3) AS confidence, k % 4 > 0 AS confirmed, (SELECT count(*) FROM t b WHERE b.incident = t.incident AND b.at < t.at AND b.phase = 0) AS epoch FROM t),
p AS (SELECT DISTINCT ON (x.incident, x.at) x.*, y.at AS evidence_at, CASE WHEN y.named THEN y.kind END AS peak, y.confidence AS peak_confidence, y.k AS peak_k FROM u x JOIN u y ON y.incident = x.incident AND y.epoch = x.epoch AND (y.at = x.at OR y.at < x.at AND y.named AND x.phase > 0)
  ORDER BY x.incident, x.at, y.named DESC, y.confidence DESC, y.at),
q AS (SELECT *, CASE WHEN phase = 0 THEN sev ELSE (SELECT max(sev) FROM u b WHERE b.incident = p.incident AND b.epoch = p.epoch AND b.at <= p.at) END AS worst FROM p),
r AS (SELECT *, CASE WHEN phase = 0 THEN 1 WHEN peak = 'error' THEN CASE WHEN confirmed AND peak_confidence >= 0.7 THEN 2 ELSE 3 END WHEN peak = 'click' THEN CASE WHEN confirmed AND peak_confidence >= 0.75 THEN 4 ELSE 5 END WHEN peak = 'view' THEN 8 WHEN peak_k % 2 = 0 THEN 6 ELSE 7 END AS no FROM q),
g AS (SELECT *, CASE WHEN no IN (2, 4) THEN concat_ws(',', CASE WHEN origin IS NULL THEN 'require_named_origin' END, CASE WHEN phase = 6 THEN 'require_active_incident' END, CASE WHEN peak_confidence < 0.75 THEN 'minimum_act_confidence' END, CASE WHEN services > 3 THEN 'maximum_affected_services' END) ELSE '' END AS guards FROM r),
h AS (SELECT *, CASE WHEN guards <> '' OR no IN (3, 5) THEN 'ESCALATE_TO_HUMAN' WHEN no = 2 THEN 'AUTO_CONTAIN_THEN_ESCALATE' WHEN no = 4 THEN 'ACT' WHEN no = 6 THEN 'ALERT' ELSE 'SUPPRESS' END AS first_action FROM g),
l AS (SELECT *, phase > 0 AND first_action = 'SUPPRESS' AND coalesce(impact, 0) >= 0.2 AS f1, phase > 0 AND first_action = 'SUPPRESS' AND coalesce(impact, 0) < 0.2 AND worst >= 2 AS f2, phase > 0 AND first_action IN ('SUPPRESS', 'ALERT') AND worst = 4 AS f3 FROM h),
z AS (SELECT *, CASE WHEN f3 THEN 'ESCALATE_TO_HUMAN' WHEN f1 OR f2 THEN 'ALERT' ELSE first_action END AS action FROM l)
SELECT incident, z.at, (['{"', '".join(r.name for r in ACTION_RULES)}'])[no] AS rule, action, evidence_at, guards, concat_ws(',', CASE WHEN f1 THEN '{FLOORS[0].name}' END, CASE WHEN f2 THEN '{FLOORS[1].name}' END, CASE WHEN f3 THEN '{FLOORS[2].name}' END) AS floors,
  CASE WHEN action IN ('SUPPRESS', 'ALERT') THEN '' ELSE concat_ws(',', CASE WHEN guards <> '' THEN guards END, CASE WHEN worst = 4 THEN 'severity' END, CASE WHEN services >= 3 THEN 'services' END) END AS approvals FROM z"""
ORACLES["policy_governed"] = f"""WITH d AS (SELECT *, CASE WHEN value > 60 THEN 'ACT' WHEN value > 30 THEN 'ESCALATE_TO_HUMAN' WHEN value > 10 THEN 'ALERT' ELSE 'SUPPRESS' END AS action FROM {EVENTS} e WHERE event_type = 'purchase'),
w AS (SELECT DISTINCT ON (d.event_id) d.event_id, s.event_id AS applied, s.value > 50 AS frozen FROM d JOIN {EVENTS} s ON s.event_type = 'signup' AND s.segment = d.segment AND d.us >= s.us AND d.us - s.us < {HOUR}
  AND CASE WHEN s.value > 50 THEN d.action = 'ACT' ELSE d.segment < 2 AND d.action IN ('ACT', 'ESCALATE_TO_HUMAN') END ORDER BY d.event_id, s.us, s.event_id),
c AS (SELECT segment FROM d GROUP BY segment HAVING max(value) > 400),
f AS (SELECT d.*, applied, frozen, CASE WHEN frozen THEN 'ESCALATE_TO_HUMAN' WHEN NOT frozen THEN 'ALERT' ELSE action END AS final FROM d LEFT JOIN w USING (event_id))
SELECT event_id AS decision_id, final AS action, applied, final = 'ESCALATE_TO_HUMAN' AS escalated, CASE WHEN final IN ('SUPPRESS', 'ALERT') THEN '' ELSE
  concat_ws(',', CASE WHEN value > 100 THEN 'severity' END, CASE WHEN user_id % 10 = 0 THEN 'services' END, CASE WHEN frozen THEN 'change_freeze' END, CASE WHEN segment IN (SELECT segment FROM c) THEN 'critical_service' END) END AS approvals FROM f"""
ORACLES |= {
    "kind_scores": f"""WITH o AS (SELECT event_type AS kind, value > 60 AS s, k < 50 AS l, value - 60 AS latency FROM {E_K}), h AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY latency) AS i, count(*) OVER (PARTITION BY kind) AS c FROM o WHERE s AND l)
SELECT o.kind, count(*) FILTER (WHERE s AND l) AS hits, count(*) FILTER (WHERE s AND NOT l) AS false_alarms, count(*) FILTER (WHERE l AND NOT s) AS missed, round(count(*) FILTER (WHERE s AND l) / nullif(count(*) FILTER (WHERE s), 0), 6) AS precision,
  round(count(*) FILTER (WHERE s AND l) / nullif(count(*) FILTER (WHERE l), 0), 6) AS recall, (SELECT latency FROM h WHERE h.kind = o.kind AND i = ceil(c * 0.5)) AS p50, (SELECT latency FROM h WHERE h.kind = o.kind AND i = ceil(c * 0.95)) AS p95 FROM o GROUP BY o.kind""",
    "reference_windows": f"""SELECT p.event_id AS id, min(x.us) AS start, max(x.us) + {HOUR} AS end, concat_ws(',', CASE WHEN NOT coalesce(bool_or(x.event_id < p.event_id), false) THEN p.event_id - 1 END, CASE WHEN NOT coalesce(bool_or(x.event_id > p.event_id), false) THEN p.event_id + 1 END) AS missing
FROM {EVENTS} p LEFT JOIN {EVENTS} x ON x.event_type = 'error' AND abs(x.event_id - p.event_id) = 1 WHERE p.event_type = 'purchase' GROUP BY p.event_id""",
    "range_scan_page": f"SELECT event_id, us, value, (SELECT count(*) FROM {EVENTS} WHERE event_type = 'purchase' AND us BETWEEN 1704153600000000 AND 1704412800000000) > 100 AS truncated FROM {EVENTS} WHERE event_type = 'purchase' AND us BETWEEN 1704153600000000 AND 1704412800000000 ORDER BY us, event_id LIMIT 100",
}
QUERIES = {name: (globals()[name], sql) for name, sql in ORACLES.items()} | {f.__name__: (f, None) for f in (isolation_forest_score, sequence_pca_error, decomposition_residuals)}
