"""Resource series against the rules told tick by tick, and one service for each reason of the audit."""

import random

import pytest

from galena.operators import resources

SAMPLES = "service string, tick long, us long, id long, signal string, value double, instance string, supported boolean"


def told(rows, least, keep):
    out = {}
    for service in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == service]
        pod = cap = None
        points = []
        for tick in range(min(r[1] for r in mine), max(r[1] for r in mine) + 1):
            here = [r for r in mine if r[1] == tick]
            fine = [r for r in here if r[7] and r[6] and r[6].strip()]
            pods = {r[6] for r in fine}
            caps, uses = [r for r in fine if r[4] == "capacity"], [r for r in fine if r[4] == "used"]
            reason = None
            if len(pods) > 1:
                pod, cap, points, reason = None, None, [], "SEVERAL_INSTANCES"
            else:
                if pods and pods != {pod}:
                    (pod,), cap, points = pods, None, []
                if len(fine) < len(here):
                    reason = "UNCLEAR"
                elif caps and (len({r[5] for r in caps}) > 1 or caps[0][5] <= 0):
                    cap, reason = None, "CAPACITIES_DIFFER"
                elif caps and cap is not None and caps[0][5] != cap:
                    cap, reason = None, "CAPACITY_CHANGED"
                else:
                    cap = caps[0][5] if caps else cap
                    if len({(r[2], r[5]) for r in uses}) > 1:
                        reason = "USES_DIFFER"
                    elif not uses or cap is None:
                        reason = "MISSING"
                    elif not 0 <= uses[0][5] <= cap:
                        reason = "OUT_OF_RANGE"
                    elif points and uses[0][2] <= points[-1]:
                        reason = "NOT_AFTER"
            points = [] if reason else [*points, uses[0][2]][-keep:]
            status = "INSUFFICIENT" if reason else "WARMING" if len(points) < least else "EVALUATED"
            out[service, tick] = (status, reason, pod, cap, len(points), points[0] if points else None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_series_by_the_rules(spark, seed):
    """Runs of capacities and of times out of order of every length: each refusal depends on whether the one before was one."""
    rng = random.Random(seed)
    rows = []
    for service in range(60):
        calm = service % 3
        pod, cap, at = "p1", 10.0, 0
        for tick in range(40):
            if rng.random() < 0.04:
                continue
            pod = rng.choice(["p1", "p2"]) if rng.random() < 0.05 else pod
            cap = rng.choice([10.0, 20.0, 30.0]) if rng.random() < (0.1, 0.5, 0.9)[calm] else cap
            at = tick * 10 + rng.randint(0, 9) if rng.random() < (0.9, 0.6, 0.4)[calm] else at - rng.randint(0, 15)
            for signal, value in (("capacity", cap), ("used", rng.choice([1.0, 5.0, 9.0]))):
                if signal == "capacity" and rng.random() < 0.3 or signal == "used" and rng.random() < 0.05:
                    continue
                odd = rng.random()
                value = -1.0 if odd < 0.01 else 99.0 if odd < 0.02 else value
                rows.append((f"s{service}", tick, at, len(rows), signal, value, None if odd > 0.99 else " " if odd > 0.98 else pod, odd < 0.97))
                if odd > 0.93:
                    rows.append((f"s{service}", tick, at, len(rows), signal, value + rng.choice([0.0, 1.0]), rng.choice([pod, pod, "p9"]), True))
    got = {(r.service, r.tick): tuple(r)[2:] for r in resources.windows(spark.createDataFrame(rows, SAMPLES).repartition(3), 3, 5).collect()}
    assert got == told(rows, 3, 5)
    assert {r[1] for r in got.values()} == {None, "SEVERAL_INSTANCES", "UNCLEAR", "CAPACITIES_DIFFER", "CAPACITY_CHANGED", "USES_DIFFER", "MISSING", "OUT_OF_RANGE", "NOT_AFTER"}
    assert {r[0] for r in got.values()} == {"INSUFFICIENT", "WARMING", "EVALUATED"}


def test_each_reason_of_the_audit(spark):
    use = lambda at, v, pod="a", ok=True: (at, "used", v, pod, ok)
    cap = lambda at, v, pod="a", ok=True: (at, "capacity", v, pod, ok)
    fine = [use(1, 1.0), use(2, 2.0), use(3, 3.0), cap(1, 9.0)]
    cases = {
        "MISSING_CONTAINER_INSTANCE_IDENTITY": [*fine, use(4, 1.0, None)], "MISSING_USED_AND_CAPACITY": [], "MISSING_USED": [cap(1, 9.0)], "MISSING_FIXED_CAPACITY": [*fine, use(9, 1.0, "b")],
        "UNSUPPORTED_METRIC_SEMANTICS": [*fine, use(4, 1.0, "a", False)], "INVALID_CAPACITY": [*fine, cap(4, 0.0)], "NON_CONSTANT_CAPACITY": [*fine, cap(2, 8.0)], "CONFLICTING_USED_TIMESTAMP": [*fine, use(3, 4.0)],
        "NEGATIVE_USED": [*fine, use(4, -1.0)], "USED_EXCEEDS_CAPACITY": [*fine, use(4, 9.5)], "INSUFFICIENT_SERIES_POINTS": [*fine[1:], use(3, 3.0)], "QUALIFIED": [*fine, use(3, 3.0), cap(2, 9.0), use(0, 99.0, "0")],
    }
    assert list(cases) == [name for name, _ in resources.REASONS]
    rows = [(name, 0, at, i, signal, value, pod, ok) for name, of in cases.items() for i, (at, signal, value, pod, ok) in enumerate(of)]
    got = {r.service: r for r in resources.audit(spark.createDataFrame(rows, SAMPLES), spark.createDataFrame([(n,) for n in cases], "service string"), 3).collect()}
    assert {s: r.reason for s, r in got.items()} == {n: n for n in cases}
    assert tuple(got["QUALIFIED"])[2:] == ("a", 3, 2, 9.0, 1, 3) and got["MISSING_FIXED_CAPACITY"].instance == "b"
