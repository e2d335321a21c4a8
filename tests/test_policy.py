"""Worked cases of verification and of the ladder of actions."""

import pytest

from galena.operators import policy
from galena.operators.judged_queries import ACTION_RULES, ATTENTION, FLOORS

EPISODE = "incident long, service string, kind string, signal string, opened long"
TICK = "incident long, at long, state string, severity string, impact double, origin string, services long, verdict string, confidence double, status string, confirmed boolean"


def checked(spark, incidents, episodes, seen=(), matches=(), size=50):
    make = spark.createDataFrame
    got = policy.verified(
        make(incidents, "incident long, origin string"), make(episodes, EPISODE), make([("web", "cart"), ("cart", "db")], "service string, dependency string"), make([("web",), ("cart",), ("db",)], "service string"),
        make(list(seen), "incident long, service string"), make(list(matches), "incident long, similarity double"), size, 30,
    )
    return {r.incident: (r.temporal, r.covered, r.dependencies, r.memory, r.confirmed) for r in got.collect()}


def test_verification(spark):
    episodes = [(1, "web", "x", "p95", 100), (1, "cart", "EDGE_DEGRADED", "dependency.db", 130), (2, "web", "x", "p95", 99), (2, "cart", "EDGE_DEGRADED", "dependency.db", 130), (3, "db", "EDGE_DEGRADED", "dependency.web", 5), (4, "ghost", "x", None, 5)]
    seen = [(1, "web"), (1, "cart"), (1, "db"), (2, "web"), (2, "cart"), (3, "db"), (4, "ghost")]
    got = checked(spark, [(1, "db"), (2, "db"), (3, "db"), (4, None), (5, "db")], episodes, seen, [(1, 0.5), (1, 0.95), (2, 0.8)])
    assert got == {
        1: ("PASSED", "PASSED", "PASSED", "PASSED", True),
        2: ("FAILED", "FAILED", "PASSED", "FAILED", False),
        3: ("PASSED", "PASSED", "FAILED", "FAILED", False),
        4: ("FAILED", "PASSED", "FAILED", "FAILED", False),
        5: ("FAILED", "PASSED", "PASSED", "FAILED", False),
    }
    assert checked(spark, [(1, "db")], episodes, seen, size=19)[1][3:] == ("BOOTSTRAP", True)
    assert checked(spark, [], []) == {}


def ladder(spark, rows):
    got = policy.decided(spark.createDataFrame(rows, TICK), ACTION_RULES, FLOORS, policy.Guards(0.75, 3, "ESCALATE_TO_HUMAN"), ("LOW", "MEDIUM", "HIGH", "CRITICAL"), ATTENTION, ("ACT", "AUTO_CONTAIN_THEN_ESCALATE"), ("SUPPRESS", "ALERT"))
    return [r for r in sorted(got.collect(), key=lambda r: (r.incident, r.at))]


def test_peaks_hold_until_resolved(spark):
    got = ladder(spark, [
        (1, 1, "OPEN", "LOW", None, "db", 1, None, None, "INSUFFICIENT", None),
        (1, 2, "OPEN", "HIGH", None, "db", 1, "OPERATIONAL_FAULT", 0.8, "DECIDED", True),
        (1, 3, "OPEN", "LOW", None, "db", 4, "ATTACK", 0.8, "DECIDED", True),
        (1, 4, "OPEN", "LOW", None, None, 1, "ATTACK", 0.9, "DECIDED", False),
        (1, 5, "RESOLVED", "LOW", None, None, 1, None, None, "NO_EVIDENCE", False),
        (1, 6, "OPEN", "LOW", None, None, 1, None, None, "NO_EVIDENCE", False),
    ])
    assert [r.action for r in got] == ["ALERT", "ACT", "ESCALATE_TO_HUMAN", "ESCALATE_TO_HUMAN", "SUPPRESS", "SUPPRESS"]
    assert [r.evidence_at for r in got] == [1, 2, 2, 4, 5, 6]
    assert got[2].guards == ["maximum_affected_services"] and got[2].approvals == ["maximum_affected_services", "services"]
    assert got[3].rule == "hand-over-an-unverified-attack" and got[3].guards == []


def test_floors_raise_attention_in_turn(spark):
    calm = ("EXPECTED_EVENT", 0.9, "DECIDED", True)
    got = ladder(spark, [(1, 1, "OPEN", "LOW", 0.2, None, 1, *calm), (2, 1, "MONITORING", "CRITICAL", None, None, 1, *calm), (3, 1, "OPEN", None, None, None, None, *calm)])
    assert [(r.action, r.floors) for r in got] == [("ALERT", [FLOORS[0].name]), ("ESCALATE_TO_HUMAN", [FLOORS[1].name, FLOORS[2].name]), ("SUPPRESS", [])]
    assert got[1].approvals == ["severity"] and ladder(spark, []) == []
    with pytest.raises(ValueError):
        policy.decided(spark.createDataFrame([], TICK), ACTION_RULES[:-1], (), policy.Guards(0.7, 3, "x"), ("LOW",), {}, ("ACT",), ())


def test_windows_and_critical_services_ask_for_signatures(spark):
    decisions = spark.createDataFrame([
        (1, 5, ["a"], "X", "ACT", ["severity"]), (2, 5, ["b"], "X", "ACT", None), (3, 5, ["c"], "X", "ACT", []), (4, 5, ["m"], "X", "ACT", ["severity"]),
        (5, 5, ["a"], "X", "ALERT", ["severity"]), (6, 50, ["a", "b"], "X", "ACT", []), (7, 5, None, "X", "ESCALATE_TO_HUMAN", []),
    ], "decision_id long, at long, services array<string>, class string, action string, approvals array<string>")
    windows = spark.createDataFrame([(1, 0, 10, "CHANGE_FREEZE", ["a"], [], None), (2, 0, 10, "MAINTENANCE", ["m"], ["X"], "ALERT")], "window_id long, start long, end long, kind string, window_services array<string>, classes array<string>, most string")
    critical = spark.createDataFrame([("b",), ("m",)], "service string")
    got = policy.governed(decisions, windows, critical, ATTENTION, 10, ("ACT",), ("SUPPRESS", "ALERT"), ("ESCALATE_TO_HUMAN",), "ESCALATE_TO_HUMAN")
    assert sorted(map(tuple, got.collect())) == [
        (1, "ESCALATE_TO_HUMAN", 1, ["severity", "change_freeze"], True), (2, "ACT", None, ["critical_service"], False), (3, "ACT", None, [], False), (4, "ALERT", 2, [], False),
        (5, "ALERT", None, [], False), (6, "ACT", None, ["critical_service"], False), (7, "ESCALATE_TO_HUMAN", None, [], True),
    ]
