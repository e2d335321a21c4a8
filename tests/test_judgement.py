"""Worked cases of ratios, fusion, origins and monitors, and monitors against brute force."""

import numpy as np
import pytest

from galena.operators import judgement, monitors, ratios

KINDS = "id long, axis string, score double, kinds array<string>"
RULES = [judgement.Rule("BOTH", lit=("A", "B")), judgement.Rule("ONE", lit=("A",), calm=("B",)), judgement.Rule("QUIET", calm=("A", "B"), forbids=("LOUD",))]


def fused(spark, rows, **more):
    df = spark.createDataFrame(rows, KINDS)
    return {r.id: r for r in judgement.fuse(df, RULES, {"A": 0.5, "B": 0.5}, [judgement.Subtype("S", "ONE", requires=("x",))], **more).collect()}


def test_ratio_windows(spark):
    rules = spark.createDataFrame([("m", True, 0.25, 0.3, 0.7)], ratios.RULE)
    values = [(1, 2.0, 5, False), (2, 2.0, 9, True), (3, None, 9, False), (4, 1.0, 6, False), (5, 0.8, 9, None), (6, 0.65, 9, False), (7, 0.1, 9, False), (8, 3.0, 9, False)]
    df = spark.createDataFrame([("s", "m", *v) for v in values] + [("s", "other", 1, 1.0, 9, False)], "stream string, metric string, tick long, value double, n long, ambiguous boolean")
    got = {r.tick: (r.status, r.score and round(r.score, 6)) for r in ratios.deformed(df, rules).collect()}
    assert got == {1: ("INSUFFICIENT", None), 2: ("INSUFFICIENT", None), 3: ("INSUFFICIENT", None), 4: ("WARMING", None), 5: ("CLEAR", None), 6: ("BREACH", 0.5), 7: ("BREACH", 1.0), 8: ("CLEAR", None)}
    assert ratios.deformed(df.limit(0), rules).count() == 0


def test_fusion(spark):
    got = fused(spark, [(1, "A", 0.9, ["x", "y"]), (1, "B", 0.2, ["z"]), (2, "A", 0.9, ["x"]), (2, "B", None, []), (3, "A", 0.1, None), (3, "B", 0.1, ["LOUD"]), (4, "A", 0.9, []), (5, "A", 0.5, ["y"]), (5, "B", 0.5, ["y"]), (6, "A", 0.0, ["y"]), (6, "B", 0.0, None)])
    assert [(i, r.status, r.verdict, r.subtype) for i, r in sorted(got.items())] == [(1, "DECIDED", "ONE", "S"), (2, "INSUFFICIENT", None, None), (3, "INSUFFICIENT", None, None), (4, "NO_EVIDENCE", None, None), (5, "DECIDED", "BOTH", None), (6, "DECIDED", "QUIET", None)]
    share = 0.72 / (0.18 + 0.72 + 0.08)
    assert got[1].confidence == pytest.approx(0.4 + 0.3 * share + 0.3 * 2 / 3)
    assert got[1].kinds == ["x", "y"] and got[1].rejected == ["BOTH: B not lit", "QUIET: A not calm"]
    assert got[5].rejected == ["ONE: B not calm", "QUIET: A not calm"]
    assert got[3].shares[2].share == 0 and sum(s.share for s in got[3].shares) == pytest.approx(1)


def test_fusion_of_impossible_rules_is_even_and_an_axis_comes_once(spark):
    rows = [(1, "A", 0.0, ["LOUD"]), (1, "B", 0.0, [])]
    assert [s.share for s in fused(spark, rows)[1].shares] == pytest.approx([1 / 3] * 3)
    with pytest.raises(Exception, match="(?i)duplicat"):
        fused(spark, rows + [(1, "A", 0.5, [])])
    assert fused(spark, []) == {}


EPISODE = "incident long, service string, kind string, signal string, opened long"
EDGES = [("web", "cart"), ("cart", "db"), ("web", "ads")]


def found(spark, rows):
    got = judgement.origins(spark.createDataFrame(rows, EPISODE), spark.createDataFrame(EDGES, "service string, dependency string"))
    return {(r.incident, r.service): r for r in got.collect()}


def test_origin_is_deepest_and_earliest(spark):
    got = found(spark, [(1, "web", "LATENCY", "p95", 20), (1, "cart", "EDGE_DEGRADED", "dependency.db", 10), (1, "cart", "LATENCY", "p95", 15)])
    db = got[1, "db"]
    assert (db.rank, db.onset, db.reach, db.accusation, db.origin) == (1, 1.0, 1.0, 1.0, True)
    assert (got[1, "web"].onset, got[1, "web"].reach, got[1, "cart"].reach, got[1, "cart"].accusation) == (0.0, 0.0, 0.5, 0.0)


def test_uncommitted_edges_name_nobody_but_count(spark):
    got = found(spark, [(1, "web", "EDGE_DEGRADED", "dependency.db", 5), (1, "web", "EDGE_DEGRADED", "dependency.", 5), (2, "ads", "x", "y", 1), (2, "cart", "x", "y", 1), (3, "ads", None, None, None)])
    assert sorted(got) == [(1, "web"), (2, "ads"), (2, "cart"), (3, "ads")]
    assert got[1, "web"].origin and got[1, "web"].accusation == 0
    assert not got[2, "ads"].origin and not got[2, "cart"].origin
    assert found(spark, []) == {}


def test_ks_windows_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(s, int(rng.integers(0, 500)), i, float(np.round(rng.normal(1 if i > 300 else 0), 1))) for i in range(600) for s in "ab"[: 2 if i % 3 == 0 else 1]]
    df = spark.createDataFrame(rows + [("a", 3, 9999, None)], "stream string, at long, id long, value double")
    wanted = {}
    for s in "ab":
        of = sorted((at, i, v) for t, at, i, v in rows if t == s)
        for p in range(19, len(of)):
            w = np.array([v for _, _, v in of[p - 19 : p + 1]])
            d = max(abs((w[:13] <= x).mean() - (w[13:] <= x).mean()) for x in w)
            wanted[s, p] = (of[p][1], round(d, 9))
    for block in (25, 4096):
        got = {(r.stream, r.place): (r.id, round(r.distance, 9)) for r in monitors.ks_windows(df, 100, 20, 7, 0.005, block).collect()}
        assert got == wanted
    assert monitors.ks_windows(df.limit(0), 100).count() == 0


def test_isolation_finds_the_odd_rows_and_is_repeatable(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(2000, 2)))] + [(5000 + i, 9.0 + i, -9.0) for i in range(5)] + [(7000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    trees = monitors.isolation_trees(df, ["x", "y"], 50, 128)
    first, again = ({r.id: r.score for r in monitors.isolation_scores(d, monitors.isolation_trees(d, ["x", "y"], 50, 128), ["x", "y"]).collect()} for d in (df, df.repartition(7)))
    assert first == pytest.approx(again, nan_ok=True) and first.pop(7000) is None
    assert sorted(first, key=first.get)[-5:] and set(sorted(first, key=first.get)[-5:]) == set(range(5000, 5005))
    sizes = {(r.tree, r.node): r.size for r in trees.collect()}
    assert all(n == sizes[t, 2 * k] + sizes[t, 2 * k + 1] for (t, k), n in sizes.items() if (t, 2 * k) in sizes)
    empty = df.limit(0)
    assert monitors.isolation_scores(empty, monitors.isolation_trees(empty, ["x", "y"]), ["x", "y"]).count() == 0


def test_offset_drift(spark):
    df = spark.createDataFrame([(1, 5, 9, 4, 8), (2, 5, 9, 5, 12), (3, None, 9, 5, 9)], "id long, start long, end long, wanted_start long, wanted_end long")
    assert sorted(map(tuple, monitors.offset_drift(df, 2).collect())) == [(1, 1, 1, False), (2, 0, -3, True), (3, None, 0, False)]
