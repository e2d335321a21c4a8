"""Operators on intervals of which very many hold at one time: what meets is not copied, shuffled or compared pair by pair."""

import random

from pyspark.sql import functions as F

from galena.operators import guards, intervals


def top_down(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contexts_are_lists_without_a_shuffle_of_pairs(spark):
    rng = random.Random(1)
    decisions = [(i, rng.randint(-5, 120)) for i in range(150)] + [(900, None)]
    contexts = [(i, a, a + rng.randint(0, 60)) for i in range(200) for a in [rng.randint(0, 100)]] + [(None, 0, 99)]
    got = intervals.contexts_as_of(spark.createDataFrame(decisions, "decision_id long, at long"), spark.createDataFrame(contexts, "context_id long, valid_from long, valid_to long"), 16)
    plan = top_down(got)
    assert plan.index("Join") < plan.index("Aggregate"), "met pairs are aggregated again"
    want = {d: [c for a, c in sorted((a, c) for c, a, b in contexts if c is not None and at is not None and a <= at < b)] for d, at in decisions}
    assert {r.decision_id: r.contexts for r in got.collect()} == want


def test_the_breaker_counts_without_meeting_every_recent_action(spark):
    rng = random.Random(2)
    actions = [(i, rng.randint(0, 90), rng.choice(["a", "b", None]), rng.choice([None, 0.0, 0.01, 0.9])) for i in range(300)] + [(None, 30, "a", 0.0)]
    asks = [(i, rng.randint(-20, 130)) for i in range(200)] + [(900, None)]
    got = guards.breaker(spark.createDataFrame(asks, "ask_id long, at long"), spark.createDataFrame(actions, "id long, us long, service string, improvement double"), 13, 45, 2, 0.2)
    want = {}
    for ask, at in asks:
        recent = [a for a in actions if at is not None and at - 13 < a[1] <= at]
        n, weak = sum(a[0] is not None for a in recent), []
        for service in "ab":
            last = sorted((a for a in recent if a[2] == service and a[3] is not None), key=lambda a: (a[1], -1 if a[0] is None else a[0]))[-2:]
            if len(last) == 2 and max(a[3] for a in last) < 0.2:
                weak.append(service)
        want[ask] = (n, "RATE" if n >= 45 else "INEFFECTIVE" if weak else None, weak[0] if weak and n < 45 else None)
    assert {r.ask_id: (r.recent, r.tripped, r.service) for r in got.collect()} == want
    assert {w[1] for w in want.values()} == {"RATE", "INEFFECTIVE", None}
    # actions meet no asking row in a join, only the services that offer anything do
    assert "at#" not in "".join(line for line in top_down(got).splitlines() if "Join" in line)


def test_the_first_window_in_force_is_found_without_meeting_all(spark):
    rng = random.Random(3)
    services, actions, rank = ["a", "b", "c"], ["WATCH", "ASK", "HOLD", "ACT"], {"WATCH": 0, "ASK": 1, "HOLD": 2, "ACT": 3}
    some = lambda: rng.sample(services, rng.randint(0, 3))
    decisions = [(i, rng.choice([None, *range(-5, 70)]), some(), rng.choice(["X", "Y", None]), rng.choice(actions)) for i in range(300)]
    windows = [(i, a, a + rng.choice([0, 1, 3, 20]), rng.choice(["MAINTENANCE", "CHANGE_FREEZE"]), some(), ["X"], rng.choice(["WATCH", "ASK", None])) for i in range(120) for a in [rng.randint(0, 60)]]
    got = intervals.suppressed(
        spark.createDataFrame(decisions, "decision_id long, at long, services array<string>, class string, action string"),
        spark.createDataFrame(windows, "window_id long, start long, end long, kind string, window_services array<string>, classes array<string>, most string"), rank, 8,
    )
    want = {}
    for i, at, asked, what, action in decisions:
        changes = []
        for w, a, b, kind, named, classes, most in windows:
            if at is not None and a <= at < b and set(asked) & set(named):
                if kind == "CHANGE_FREEZE" and action == "ACT":
                    changes.append((a, w, kind, "ASK"))
                elif kind != "CHANGE_FREEZE" and what in classes and set(asked) <= set(named) and most and rank[action] > rank[most]:
                    changes.append((a, w, kind, most))
        first = min(changes, default=(None, None, None, action))
        want[i] = first[1:]
    assert {r.decision_id: (r.applied, r.applied_kind, r.final) for r in got.collect()} == want
    assert sum(w[0] is not None for w in want.values()) > 50
    assert "at#" not in "".join(line for line in top_down(got).splitlines() if "Join" in line), "decisions meet windows by time in a join"


def test_pairs_with_a_service_in_common_are_not_shuffled_to_tell_them_apart(spark):
    rng = random.Random(4)
    make = lambda n: [(i, a, a + rng.randint(0, 12), [rng.choice(["a", "b", "c", None]) for _ in range(3)]) for i in range(n) for a in [rng.randint(0, 60)]]
    left, right = make(80), make(90)
    frame = lambda rows, s: spark.createDataFrame(rows, f"{s}_id long, {s}_start long, {s}_end long, services array<string>")
    got = intervals.meetings(frame(left, "l"), frame(right, "r"), 7)
    want = sorted((i, j) for i, a, b, s in left for j, c, d, t in right if a < b and c < d and a < d and c < b and (set(s) & set(t)) - {None})
    assert sorted((r.l_id, r.r_id) for r in got.collect()) == want
    assert len(want) > 100 and "Aggregate" not in top_down(got)


def test_pressure_of_changes_by_running_values(spark):
    from galena import catalog

    rng = random.Random(5)
    rows = [(i, rng.randint(-40, 90), rng.choice(["a", "b", "c", None])) for i in range(300)]
    changes = [(rng.choice(["a", "b", None]), rng.randint(-40, 90)) for _ in range(60)]
    got = intervals.pressed(spark.createDataFrame(rows, "event_id long, us long, service string"), spark.createDataFrame(changes, "service string, us long"), 11)
    want = {}
    for i, us, service in rows:
        near = [(1 - (us - c) / 11) * (1.0 if s is not None and s == service else 0.4) for s, c in changes if us - 11 < c <= us]
        if near:
            want[i] = (len(near), max(near))
    assert {r.event_id: (r.changes, r.pressure) for r in got.collect()} == want
    for name in ("change_pressure", "change_pressure_all"):
        assert "Join" not in top_down(catalog.QUERIES[name][0](spark, "/root/testdata/sf0.001"))
