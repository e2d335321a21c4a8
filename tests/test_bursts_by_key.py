"""Bursts of templates count keys of texts; the texts are named again where a template breaches."""

from galena.operators import bursts


def test_texts_are_not_carried_through_the_counts(spark):
    rows = [("s", t * 10 + i, f"{t}:{i}", f"get item {i} of store" if i % 2 else "plain words") for t in range(4) for i in range(6)]
    rows += [("s", 45, f"x{i}", f"error {i} at disk") for i in range(9)]
    got = bursts.log_bursts(spark.createDataFrame(rows, "service string, us long, id string, line string"), 10, floor=0.01)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("leader_key") and "tick#" in plan and "line_key" not in plan, "lines are counted again where the result is read"
    found = {r.tick: (r.status, r.records, r.leader, r.n) for r in got.collect()}
    assert found == {0: ("WARMING", 6, None, None), 1: ("WARMING", 6, None, None), 2: ("WARMING", 6, None, None), 3: ("CLEAR", 6, None, None), 4: ("BREACH", 9, "error <*> at disk", 9)}
