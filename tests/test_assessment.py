"""Axes, states, severity, falls, silences and feeds on worked cases: nulls, ties, repeats, errors and empty tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from galena.operators import assessment, ingest
from galena.operators.assessment_queries import BANDS, CLAIMS, CRITICALITY, FALLBACK
from galena.sources import feeds

ACTIVE = "run int, tick long, service string, kind string, signal string, peak double"
COVERAGE = "run int, tick long, kind string"


def axes(spark, coverage, active):
    got = assessment.assessed(["run"], spark.createDataFrame(coverage, COVERAGE), spark.createDataFrame(active, ACTIVE), CLAIMS, CRITICALITY)
    return {(r.run, r.tick, r.axis): r for r in got.collect()}


def test_axes_are_scored_from_claimed_episodes_only(spark):
    got = axes(spark, [(1, 1, "DROP"), (1, 1, "RATIO_DEFORM"), (1, 2, None), (1, 3, "DROP"), (1, 4, "DROP"), (1, 3, "DROP")], [
        (1, 1, "click", "DROP", "rate", 1.0), (1, 1, "ghost", "DROP", "rate", 0.5), (1, 1, "view", "RATIO_DEFORM", "source_entropy", 0.04), (1, 1, "view", "OTHER", None, 1.0), (1, 1, "view", "DROP", None, None),
        (1, 2, "view", "DROP", None, 1.0), (1, 3, "click", "DROP", "rate", 0.9), (1, 4, None, "DROP", None, 0.2),
    ])
    assert len(got) == 4 * 4
    reliability, business, security = ([got[1, t, a] for t in (1, 2, 3, 4)] for a in ("RELIABILITY", "BUSINESS_IMPACT", "SECURITY"))
    assert [r.status for r in reliability] == ["SCORED", "INSUFFICIENT", "SCORED", "SCORED"]
    assert [round(r.score, 6) for r in reliability] == [round(1 - 0.3 * 0.65, 6), 0, 0.63, 0.14]
    assert [r.trend for r in reliability] == ["UNKNOWN", "UNKNOWN", "FALLING", "FALLING"]
    assert reliability[0].services == ["click", "ghost"] and reliability[0].covered == ["DROP"] and reliability[0].contributing == ["DROP"]
    assert [round(r.score, 6) for r in business] == [0.56, 0, 0.504, 0] and business[0].services == ["click"]
    assert [r.trend for r in business] == ["UNKNOWN", "UNKNOWN", "FALLING", "FALLING"]
    assert [(r.status, r.score, r.contributing) for r in security] == [("SCORED", 0, []), ("INSUFFICIENT", 0, []), ("INSUFFICIENT", 0, []), ("INSUFFICIENT", 0, [])]
    assert {got[1, t, "CHANGE_CONFIG"].status for t in (1, 2, 3, 4)} == {"INSUFFICIENT"}
    assert axes(spark, [], []) == {}
    assert axes(spark, [(1, 1, "SATURATION")], [(1, 1, "a", "SATURATION", None, 1.5)])[1, 1, "RELIABILITY"].score == 1


def test_incident_is_watched_before_it_is_resolved(spark):
    rows = [(1, 0, True, 0), (1, 10, False, 12), (1, 15, False, 12), (1, 22, False, 12), (1, 30, True, 30), (1, 40, False, 30), (1, 49, False, 30), (1, 50, False, 30)]
    got = assessment.incident_states(spark.createDataFrame(rows, "incident int, at long, active boolean, last_activity long"), 10).orderBy("at").collect()
    assert [r.state for r in got] == ["OPEN", "MONITORING", "MONITORING", "RESOLVED", "OPEN", "MONITORING", "MONITORING", "RESOLVED"]


def test_severity_by_impact_or_criticality(spark):
    rows = spark.createDataFrame([(0.75, "low"), (0.5, None), (0.0, "critical"), (None, "critical"), (None, "low"), (None, None), (None, "odd")], "impact double, worst string")
    assert [r.s for r in rows.select(assessment.severity(F.col("impact"), F.col("worst"), BANDS, FALLBACK).alias("s")).collect()] == ["CRITICAL", "HIGH", "LOW", "HIGH", "LOW", "LOW", "LOW"]


def test_falls_need_a_rule_and_enough_expected(spark):
    rules = spark.createDataFrame([("a", 1.5, 0.5, 0.9)], "stream string, least double, trigger double, full double")
    rows = [("a", 1, 0.0, 10.0), ("a", 2, 5.0, 10.0), ("a", 3, 6.0, 10.0), ("a", 4, 12.0, 10.0), ("a", 5, 0.0, 1.0), ("a", 6, 0.0, None), ("b", 1, 0.0, 10.0), ("a", 7, None, 10.0)]
    got = {(r.stream, r.at): (r.fall, r.score) for r in assessment.drops(spark.createDataFrame(rows, "stream string, at long, observed double, expected double"), rules).collect()}
    assert got.pop(("a", 2)) == (0.5, pytest.approx(0.5 / 0.9))
    assert got.pop(("a", 7))[0] in (None, 0.0)
    assert got == {("a", 1): (1.0, 1.0), ("a", 3): (0.4, None), ("a", 4): (0.0, None), ("a", 5): (None, None), ("a", 6): (None, None), ("b", 1): (None, None)}


def test_silence_counts_from_the_later_of_expected_and_seen(spark):
    rules = spark.createDataFrame([("a", 120, 300)], "stream string, most_age long, full_age long")
    schema = "stream string, emitter int, expected_since long, last_seen long, watermark long"
    rows = [("a", 1, 0, None, 600), ("a", 2, 0, 450, 600), ("a", 3, 500, 100, 600), ("b", 4, 0, None, 600), ("a", 5, 0, 480, 600)]
    got = {r.emitter: (r.age, r.onset, r.score) for r in assessment.silences(spark.createDataFrame(rows, schema), rules).collect()}
    assert got == {1: (600, 120, 1.0), 2: (150, 570, 0.5), 3: (100, None, None), 4: (None, None, None), 5: (120, 600, 0.4)}
    with pytest.raises(PySparkException, match="after the watermark of a"):
        assessment.silences(spark.createDataFrame([("a", 1, 0, 601, 600)], schema), rules).collect()


def test_contexts_of_fixtures_and_calendar(spark):
    fixtures = spark.createDataFrame([(1, "SCHEDULED", 100), (2, "POSTPONED", 100), (3, None, 100), (4, "LIVE", None)], "fixture_id int, status string, kickoff long")
    assert sorted(map(tuple, feeds.fixture_windows(fixtures, ["SCHEDULED", "LIVE"], 15, 120).collect())) == [("fixture-1", 85, 220), ("fixture-4", None, None)]
    entries = spark.createDataFrame([(1, True, 0, 10), (2, False, 0, 10), (3, True, 5, 9), (4, True, 0, 5), (5, None, 0, 10)], "entry_id int, enabled boolean, valid_from long, valid_to long")
    assert sorted(r.context_id for r in feeds.calendar_windows(entries, F.lit(5)).collect()) == ["calendar-1", "calendar-3"]


def test_changes_are_refused_where_unmapped_or_in_conflict(spark):
    feed = spark.createDataFrame([("1", "R", "w", 5, "r1"), ("1", "R", "w", 5, "r1"), ("2", "R", "w", 5, None), ("2", "R", "w", 5, "r1"), ("3", "R", "other", 5, "r"), ("4", "F", "w", 5, None), ("5", "R", "w", None, None)], "change_id string, kind string, name string, ts long, revision string")
    accepted, refused = feeds.changes(feed, spark.createDataFrame([("R", "w", "web")], "kind string, name string, service string"))
    assert sorted(map(tuple, accepted.collect()), key=str) == [("1", "R", "web", 5, "r1"), ("5", "R", "web", None, None)]
    assert {r.change_id: r.reason for r in refused.collect()} == {"2": "conflict", "3": "unmapped", "4": "unmapped"}
    assert [df.count() for df in feeds.changes(feed.limit(0), spark.createDataFrame([], "kind string, name string, service string"))] == [0, 0]


def test_relative_intervals_must_lie_within_the_run(spark):
    relative = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 5, 6), ("a", 3, -1, 2), ("b", 4, 0, 1)], "run string, id int, offset long, length long")
    anchors = spark.createDataFrame([("a", 100, 10)], "run string, anchor long, duration long")
    assert sorted((r.id, r.start, r.end, r.problem) for r in feeds.absolute(relative, anchors, ["run"]).collect()) == [(1, 100, 110, None), (2, 105, 111, "out of bounds"), (3, 99, 101, "out of bounds"), (4, None, None, "no anchor")]


def test_latest_revision_and_its_conflicts(spark):
    rows = [("a", 1, "x", "OPEN"), ("a", 2, "x", "CLOSED"), ("a", 2, "x", "CLOSED"), ("b", 1, "x", "OPEN"), ("b", 3, "y", "OPEN"), ("c", 1, "x", "OPEN"), ("c", 1, "x", None), ("c", 2, "x", "CLOSED"), ("d", 1, None, None)]
    got = feeds.latest_revisions(spark.createDataFrame(rows, "episode_id string, revision int, opener string, state string"), ["opener"])
    assert sorted(map(tuple, got.collect())) == [("a", 2, "x", "CLOSED", None), ("b", 3, "y", "OPEN", "identity"), ("c", 2, "x", "CLOSED", "payload"), ("d", 1, None, None, None)]


def test_counters_of_what_came_in(spark):
    rows = [("k", "a", 100, 0, 0), ("k", "a", 100, 0, 1), ("k", "b", 95, 0, 2), ("k", "c", 131, 1, 3), ("k", "d", 91, 1, 4), ("k", "a", 5, 1, 5), ("k", "e", 109, 2, 6), ("k", "f", 112, 2, 7), ("k", "b", 500, 3, 8), ("z", "a", 1, 3, 9)]
    got = ingest.counters(spark.createDataFrame(rows, "key string, id string, us long, batch long, place long"), 10, 15)
    assert sorted(map(tuple, got.collect())) == [("k", 0, 3, 2, 1, 0, 0), ("k", 1, 3, 2, 1, 0, 2), ("k", 2, 2, 1, 0, 1, 0), ("k", 3, 1, 0, 1, 0, 37), ("z", 3, 1, 1, 0, 0, 0)]
