"""Interval anti joins and snapshots by brute force, and plans without nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from galena.operators import absence, absence_queries, intervals

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width,salts", [(10, 8), (1, 1), (1000, 3)])
def test_absence_over_all_buckets(spark, width, salts):
    rng = random.Random(width)
    span = lambda: (a := rng.randint(-60, 60), a + rng.choice([-1, 0, 1, 3, 25, 90]))
    left = [(i % 70, *span(), rng.choice("abc")) for i in range(100)]
    right = [(*span(), rng.choice("ab")) for _ in range(12)] + [(5, 6, "b")] * 300 + [(5, 7, "b"), (None, 4, "a"), (0, 9, None)]
    a, b = spark.createDataFrame(left, "l_id int, l_start long, l_end long, k string"), spark.createDataFrame(right, "r_start long, r_end long, k string")
    meets = {i for i, s, e, k in left for x, y, j in right if k == j and x is not None and s < e and x < y and s < y and x < e}
    assert {r.l_id for r in intervals.overlapped(a, b, width, ["k"], salts).collect()} == meets
    assert sorted(tuple(r) for r in intervals.without_overlap(a, b, width, ["k"], salts).select("l_id", "l_start", "l_end", "k").collect()) == sorted(r for r in left if r[0] not in meets)
    assert intervals.without_overlap(a, b.limit(0), width, ["k"]).count() == len(left)


@pytest.mark.parametrize("width", [1, 7, 500])
def test_snapshots_at_any_time(spark, width):
    rng = random.Random(width)
    versions = [(i, r, rng.randint(0, 60), f"{i}-{r}") for i in range(12) for r in range(1, 7)] + [(99, 1, 70, "late"), (98, 1, 5, "x"), (98, 1, 5, "x")]
    times = [*range(-3, 66, 3), 20, 20]
    got = intervals.snapshots(spark.createDataFrame(versions, "id int, revision int, effective long, state string"), spark.createDataFrame([(t,) for t in times], "at long"), width).collect()
    want = set()
    for t in set(times):
        latest = {}
        for i, r, at, state in versions:
            if at <= t and (i not in latest or r > latest[i][0]):
                latest[i] = (r, state)
        want |= {(t, i, *v) for i, v in latest.items()}
    assert {(r.at, r.id, r.revision, r.state) for r in got} == want and len(got) == len(want)


def test_a_service_without_a_near_target_is_unrelated(spark):
    episodes = spark.createDataFrame([(1, "a", 0, 10), (2, "b", 0, 10), (3, "c", 0, 10), (4, "a", 20, 30), (5, "a", 0, 10)], "id int, service string, start long, end long")
    targets = spark.createDataFrame([("a", 9, 12)], "service string, start long, end long")
    hops = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", "a", 2), ("a", "c", 2), ("b", "c", 1), ("c", "b", 1)], "source string, target string, hops int")
    matches = spark.createDataFrame([(5,)], "id int")
    ids = lambda most: sorted(r.id for r in absence.unrelated_episodes(episodes, matches, targets, hops, most, 10).collect())
    assert (ids(0), ids(1), ids(2)) == ([2, 3, 4], [3, 4], [4])


def test_windows_without_a_class_answer_nothing(spark):
    judged = spark.createDataFrame([(1, 0, 10, ["a", "b"], "ACT"), (2, 0, 10, ["c"], "ACT"), (3, 0, 10, ["c"], "ASK"), (4, 0, 10, [], "ACT")], "id int, start long, end long, services array<string>, action string")
    windows = spark.createDataFrame([(9, 20, "b", "FAULT"), (0, 9, "c", None), (10, 12, "c", "FAULT")], "start long, end long, service string, class string")
    assert sorted(r.id for r in absence.false_acts(judged, windows, 5).collect()) == [2, 4]


@pytest.mark.parametrize("name", [*absence_queries.QUERIES, *absence_queries.INSTEAD])
def test_no_nested_loops(spark, name):
    run = absence_queries.INSTEAD.get(name) or absence_queries.QUERIES[name][0]
    plan = run(spark, SF)._jdf.queryExecution().optimizedPlan().toString() + run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name != "episode_snapshots":  # there the last time, one row, is joined to all versions
        assert "BroadcastNestedLoopJoin" not in plan
    assert run(spark, SF).where(F.lit(True)).count() >= 0
