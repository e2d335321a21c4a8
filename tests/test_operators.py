"""Operators on tables, windows and thresholds of their own: worked cases, nulls, ties and errors."""

import hashlib

import pytest
from pyspark.sql import functions as F

from galena.operators import chains, graph, ingest, intervals, lifecycle, memory, selection

POLICY = "kind string, breach double, clear double, open_after int, close_after int, gap string"


def told(spark, scores, gap="skip", n=2, m=2):
    rows = [("s", "k", i, None if x is None or x == "gap" else float(x), x != "gap") for i, x in enumerate(scores)]
    rows += [("other", "unknown", 0, 1.0, True)]
    df = spark.createDataFrame(rows, "stream string, kind string, tick long, score double, sufficient boolean")
    got = lifecycle.transitions(df, spark.createDataFrame([("k", 0.5, 0.2, n, m, gap)], POLICY)).orderBy("tick").collect()
    assert {r.stream for r in got} <= {"s"}
    return got


def test_episode_opens_after_a_run_and_closes_after_a_run(spark):
    got = told(spark, [0.6, 0.9, 0.7, 0.1, 0.6, None, 0.2])
    assert [r.action for r in got] == ["PENDING", "OPENED", "SUSTAINED", "CLEARING", "SUSTAINED", "CLEARING", "CLOSED"]
    assert [r.phase for r in got] == ["PENDING", "ACTIVE", "ACTIVE", "CLEARING", "ACTIVE", "CLEARING", "CLOSED"]
    assert [(r.opened, r.breaches, r.revision, r.peak) for r in got][1:] == [(0, 2, 1, 0.9), (0, 3, 2, 0.9), (0, 3, 2, 0.9), (0, 4, 3, 0.9), (0, 4, 3, 0.9), (0, 4, 4, 0.9)]


def test_dead_band_breaks_both_runs(spark):
    assert [r.action for r in told(spark, [0.6, 0.3, 0.6, 0.6, 0.1, 0.3, 0.1, 0.1])] == ["PENDING", "HELD", "PENDING", "OPENED", "CLEARING", "HELD", "CLEARING", "CLOSED"]


def test_gap_is_skipped_or_holds(spark):
    assert [r.action for r in told(spark, [0.6, "gap", 0.6])] == ["PENDING", "OPENED"]
    assert [r.action for r in told(spark, [0.6, "gap", 0.6], gap="hold")] == ["PENDING", "HELD", "PENDING"]


def test_second_episode_starts_anew(spark):
    df = spark.createDataFrame([("s", "k", i, x, True) for i, x in enumerate([0.9, 0.1, 0.5, 0.6])], "stream string, kind string, tick long, score double, sufficient boolean")
    got = sorted(tuple(r) for r in lifecycle.lifecycle(df, spark.createDataFrame([("k", 0.5, 0.2, 1, 1, "skip")], POLICY)).collect())
    assert got == [("s", 1, 0, 0, 1, 1, 2, 0.9), ("s", 2, 2, 2, None, 2, 2, 0.6)]


def test_nearest_rank(spark):
    for n in (1, 2, 19, 20, 21, 100):
        values = spark.range(1, n + 1).select((F.col("id") * 10).alias("v"))
        assert values.agg(selection.nearest_rank("v", 0.95)).first()[0] == 10 * -(-95 * n // 100)


def test_contexts_as_of_needs_unique_ids(spark):
    at = spark.createDataFrame([(1, 10), (2, 25), (3, None)], "decision_id long, at long")
    kind = "context_id long, valid_from long, valid_to long"
    some = spark.createDataFrame([(7, 0, 20), (5, 0, 11), (8, 10, 10), (9, 11, 30)], kind)
    for width in (1, 7, 1000):
        got = {r.decision_id: r.contexts for r in intervals.contexts_as_of(at, some, width).collect()}
        assert got == {1: [5, 7], 2: [9], 3: []}
    with pytest.raises(Exception, match="in force twice"):
        intervals.contexts_as_of(at, some.unionByName(spark.createDataFrame([(7, 5, 12)], kind)), 5).collect()


def test_overlaps_are_found_once_whatever_the_width(spark):
    left = spark.createDataFrame([(1, 0, 10, "a"), (2, 5, 30, "a"), (3, 7, 7, "a")], "l_id long, l_start long, l_end long, s string")
    right = spark.createDataFrame([(1, 9, 20, "a"), (2, 10, 40, "a"), (3, 0, 99, "b")], "r_id long, r_start long, r_end long, s string")
    for width in (1, 4, 500):
        assert sorted((r.l_id, r.r_id) for r in intervals.overlapping(left, right, width, ["s"]).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_freeze_hands_over_and_maintenance_caps(spark):
    kind = "decision_id long, at long, services array<string>, class string, action string"
    decisions = spark.createDataFrame([(1, 5, ["a"], "X", "ACT"), (2, 5, ["a"], "X", "HOLD"), (3, 5, ["a", "b"], "X", "HOLD"), (4, 50, ["a"], "X", "ACT"), (5, 5, ["c"], "X", "WATCH")], kind)
    windows = spark.createDataFrame([(1, 0, 10, "MAINTENANCE", ["a"], ["X"], "ASK"), (2, 2, 10, "CHANGE_FREEZE", ["a"], [], None), (3, 0, 10, "MAINTENANCE", ["c"], ["X"], "ASK")], "window_id long, start long, end long, kind string, window_services array<string>, classes array<string>, most string")
    got = {r.decision_id: (r.applied, r.final) for r in intervals.suppressed(decisions, windows, {"WATCH": 0, "ASK": 1, "HOLD": 2, "ACT": 3}, 10).collect()}
    assert got == {1: (1, "ASK"), 2: (1, "ASK"), 3: (None, "HOLD"), 4: (None, "ACT"), 5: (None, "WATCH")}


def test_neighbours(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.1]), (3, [0.1, 0.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = memory.signature_knn(df, df, 2, k=2, floor=0.9).collect()
    assert sorted((r.id, r.rank, r.neighbour) for r in got if r.id in (1, 4)) == [(1, 1, 5), (1, 2, 2)]
    assert memory.signature_knn(df, df, 2, k=9, floor=0.0).where("id = 4").count() == 4
    verdicts = {r.id: r.confidence for r in memory.nudged(spark.createDataFrame([(1, 0.5), (4, 0.5), (5, 0.99)], "id long, confidence double"), memory.signature_knn(df, df, 2)).collect()}
    assert verdicts == {1: 0.55, 4: 0.5, 5: 1.0}


def test_chain_breaks_where_it_was_changed(spark):
    rows = [(c, i, f"e{c}{i}") for c in range(3) for i in range(50)]
    built = chains.build_chains(spark.createDataFrame(rows, "chain long, seq long, content string")).cache()
    first = built.where("chain = 0 AND seq = 0").first()
    assert first.previous_hash == chains.GENESIS and first.entry_hash == hashlib.sha256((chains.GENESIS + "|0|e00").encode()).hexdigest()
    breaks = lambda df: {r.chain: r.first_break for r in chains.verify_chains(df).collect()}
    assert breaks(built) == {0: None, 1: None, 2: None}
    assert breaks(built.withColumn("content", F.when((F.col("chain") == 1) & (F.col("seq") == 7), "x").otherwise(F.col("content")))) == {0: None, 1: 7, 2: None}
    assert breaks(built.where("NOT (chain = 2 AND seq = 20)")) == {0: None, 1: None, 2: 21}
    relinked = built.withColumn("entry_hash", F.when((F.col("chain") == 0) & (F.col("seq") == 9), F.sha2("content", 256)).otherwise(F.col("entry_hash")))
    assert breaks(relinked)[0] == 9


def test_reach_has_no_cap(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(13)] + [(13, 13)], "source long, target long")
    got = {(r.source, r.target): r.hops for r in graph.reach(path).collect()}
    assert got == {(i, j): j - i for i in range(14) for j in range(i + 1, 14)}
    assert graph.reach(path, directed=False).where("source = 13 AND target = 0").first().hops == 13
    assert graph.reach(path.limit(0)).count() == 0


def test_one_bad_point_rejects_its_envelope(spark):
    points = spark.createDataFrame([(1, 5.0, "a"), (1, -1.0, "b"), (2, 3.0, "c"), (None, 2.0, "d")], "envelope long, value double, payload string")
    good, dead = ingest.split_envelopes(points, ["envelope"], F.when(F.col("value") < 0, "negative"), "payload")
    assert sorted(r.payload for r in good.collect()) == ["c", "d"]
    assert [tuple(r) for r in dead.collect()] == [(1, "negative", 2, hashlib.sha256(b"a\nb").hexdigest())]


def test_admission(spark):
    df = spark.createDataFrame([({"Fault_Label": "x"}, "root/1"), ({"label": "x"}, "rooted"), (None, "root")], "a map<string,string>, agent string")
    assert [r[0] for r in df.select(ingest.leaks(F.col("a"), ["faultlabel"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(ingest.of_user_agent(F.col("agent"), "root")).collect()] == [True, False, True]
    gauges = spark.createDataFrame([("gauge", "By", {"namespace": "n", "container": "c", "pod_uid": u}) for u in ("1", "", None)] + [("sum", "By", {"namespace": "n", "container": "c", "pod_uid": "1"})], "signal_kind string, unit string, attributes map<string,string>")
    assert ingest.container_gauges(gauges, "n").count() == 1
    mixed = spark.createDataFrame([("a", "ms", 1.0), ("a", "s", 2.0), ("b", "ms", 3.0)], "k string, unit string, value double")
    assert {r.k: (r.mean, r.status) for r in ingest.unit_checked(mixed, ["k"]).collect()} == {"a": (None, "mixed units"), "b": (3.0, "ok")}


def test_measures(spark):
    df = spark.createDataFrame([("a", x) for x in "xxyy"] + [("b", "x")], "k string, v string")
    assert {r.k: (r.entropy, r.status) for r in selection.entropy(df, ["k"], "v", 2).collect()} == {"a": (1.0, "ok"), "b": (None, "insufficient")}
    xy = spark.createDataFrame([("up", 1.0, 2.0), ("up", 2.0, 4.0), ("down", 1.0, 2.0), ("down", 2.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 3.0)], "k string, x double, y double")
    assert {r.k: r.coherence for r in selection.coherence(xy, ["k"], "x", "y", 2).collect()} == {"up": 1.0, "down": 0.0, "flat": None}
    windows = spark.createDataFrame([("a", 1, 0.5), ("a", 3, 0.9), ("b", 1, 0.5), ("b", 3, 0.6)], "service string, tick long, availability double")
    actions = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (2, "a", 9)], "action_id long, service string, tick long")
    assert {r.action_id: (r.services, r.delta) for r in selection.restored(windows, actions).collect()} == {1: (2, 0.1), 2: (0, None)}
