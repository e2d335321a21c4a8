"""Captures, replay and the bus on worked cases; runs, envelopes and the adaptive window against numpy."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from galena.operators import monitors, runs
from galena.sources import captures, otlp

BOUNDS = "topic string, partition int, start_offset long, end_offset long, problem string"


def messages(spark, rows):
    return spark.createDataFrame([(t, p, o, None if v is None else bytearray(v, "utf-8")) for t, p, o, v in rows], captures.RECORD)


def test_bounds_tell_what_changed_and_what_moved_backwards(spark):
    snap = lambda rows: spark.createDataFrame(rows, "topic string, partition int, offset long")
    got = captures.bounds_between(snap([("a", 0, 5), ("a", 1, 5), ("b", 0, 1)]), snap([("a", 0, 9), ("a", 1, 4), ("c", 0, 1)]))
    assert {(r.topic, r.partition): r.problem for r in got.collect()} == {("a", 0): None, ("a", 1): "moved backwards", ("b", 0): "partition changed", ("c", 0): "partition changed"}


def test_gaps_at_both_ends_across_blocks_and_without_any_record(spark):
    rows = [("a", 0, o, "x") for o in range(3, 12) if o not in (5, 9)] + [("a", 0, 4, "again"), ("a", 0, 6, None), ("a", 0, 40, "beyond"), ("z", 0, 1, "undeclared")]
    bounds = spark.createDataFrame([("a", 0, 2, 13, None), ("b", 0, 0, 3, None), ("c", 0, 7, 7, None), ("d", 0, 9, 1, "moved backwards")], BOUNDS)
    got = captures.capture_gaps(messages(spark, rows), bounds, block=4)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 2, 1, 2, 0), ("a", 0, 4, 1, 5, 1), ("a", 0, 8, 1, 9, 0), ("a", 0, 12, 1, 12, 0), ("b", 0, 0, 3, 0, 0)]
    assert captures.capture_gaps(messages(spark, []), bounds.limit(0)).count() == 0


def test_capture_is_read_back_and_alterations_are_told(spark, tmp_path):
    rows = [("a", p, o, f"{p}-{o}") for p in (0, 1) for o in range(4)] + [("a", 0, 9, "beyond")]
    bounds = spark.createDataFrame([("a", 0, 1, 4, None), ("a", 1, 0, 4, None)], BOUNDS)
    path = str(tmp_path / "capture")
    labels = spark.createDataFrame([(1,)], "label int")
    captures.write_capture(messages(spark, rows), bounds, path, labels)
    got = {(r.partition, r.offset, bytes(r.value).decode()) for r in captures.load_capture(spark, path).collect()}
    assert got == {(p, o, f"{p}-{o}") for p in (0, 1) for o in range(4) if (p, o) != (0, 0)}
    with pytest.raises(PySparkException):  # a capture is not written over
        captures.write_capture(messages(spark, rows), bounds, path)
    messages(spark, [("a", 1, 8, "smuggled")]).write.mode("append").parquet(f"{path}/records")
    with pytest.raises(PySparkException, match="unlisted a:1:8"):
        captures.load_capture(spark, path).collect()
    listed = captures.manifest(messages(spark, [("a", 0, o, v) for o, v in enumerate(["same", "long", "flip", "lost"])] + [("a", 0, 5, None)]))
    here = messages(spark, [("a", 0, 0, "same"), ("a", 0, 1, "longer"), ("a", 0, 2, "flop"), ("a", 0, 4, "new"), ("a", 0, 5, None)])
    assert {r.offset: r.problem for r in captures.checked(here, listed).collect()} == {0: None, 1: "size", 2: "checksum", 3: "missing", 4: "unlisted", 5: None}


def test_replay_takes_the_first_by_place_and_keeps_dead_letters(spark):
    def envelope(body):
        resource = {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}]}
        return json.dumps({"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": [{"timeUnixNano": "5000", "body": {"stringValue": body}}]}]}]})

    rows = [("logs", 1, 0, envelope("one")), ("logs", 0, 7, envelope("one")), ("logs", 0, 8, "{broken"), ("logs", 0, 9, None), ("logs", 2, 0, "{}"), ("logs", 0, 3, envelope("two"))]
    seen, dead = captures.replayed(messages(spark, rows), otlp.logs, "resourceLogs", ["service", "body"])
    assert sorted((r.body, r.partition, r.offset, r.us) for r in seen.collect()) == [("one", 0, 7, 5), ("two", 0, 3, 5)]
    assert {(r.partition, r.offset): r.sha256 for r in dead.collect()} == {(0, 8): hashlib.sha256(b"{broken").hexdigest(), (0, 9): None, (2, 0): hashlib.sha256(b"{}").hexdigest()}


def test_bus_round_trip_and_what_cannot_be_decoded(spark):
    sent = captures.bus_messages(spark.createDataFrame([("s", "x", 1, 2.5), ("s", "y", 2, None)], "service string, signal string, us long, value double"))
    broken = spark.createDataFrame([("k", "{"), ("k", '{"us": "text", "value": 1}'), ("k", None), ("k", "[1]")], "key string, value string")
    got = captures.bus_observations(sent.unionByName(broken), "service string, signal string, us long, value double", ["us", "value"]).collect()
    assert [tuple(r) for r in got if r.decoded] == [("s\x1fx", "s", "x", 1, 2.5, True)]
    assert len(got) == 6


def test_records_are_streamed_from_a_folder(spark, tmp_path):
    messages(spark, [("a", 0, 0, "x"), ("a", 0, 1, "y")]).write.parquet(str(tmp_path / "in"))
    query = captures.folder_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.offset for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


def test_completeness_of_planned_and_unplanned_keys(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("u",)], "k string")
    plan = spark.createDataFrame([("a", 1.0, 0, 2_000_000), ("a", 4.0, 2_000_000, 2_500_000), ("none", 1.0, 0, 1_000_000)], "k string, rate double, start long, end long")
    assert sorted(map(tuple, runs.completeness(rows, plan, ["k"]).collect())) == [("a", 2, 4.0, 0.5), ("none", 0, 1.0, 0.0), ("u", 1, 0.0, None)]


def test_transcripts_differ_by_counts_and_nulls_are_equal(spark):
    t = lambda rows: spark.createDataFrame(rows, "step long, what string")
    got = runs.transcript_diff(t([(0, "a"), (0, "a"), (1, None), (2, "new")]), t([(0, "a"), (1, None), (3, "old"), (3, "old")]))
    assert sorted(map(tuple, got.collect())) == [("added", 0, "a", 1), ("added", 2, "new", 1), ("missing", 3, "old", 2)]
    timed = spark.createDataFrame([(105, "a"), (99, "b")], "us long, what string")
    assert sorted(map(tuple, runs.transcript(timed, F.lit(100), "us", 5, ["what"]).collect())) == [(-1, "b"), (1, "a")]


def test_envelopes_back_off_to_coarser_strata(spark):
    rng = np.random.default_rng(1)
    rows = [("s", i % 2, bool(i % 2 and i % 50 < 2), float(rng.normal())) for i in range(400)] + [("few", 0, False, 1.0)] * 199 + [("s", 0, False, None)]
    df = spark.createDataFrame(rows, "signal string, part int, lifted boolean, value double")
    got = {(r.part, r.lifted): r for r in runs.envelopes(df, "signal", ["part", "lifted"], "value", least=20).collect()}
    assert set(got) == {(0, False), (1, False), (1, True)}
    want = lambda test: np.quantile([r[3] for r in rows[:400] if test(r)], [0.1, 0.5, 0.9])
    for cell, level, test in (((0, False), 2, lambda r: r[1] == 0), ((1, False), 2, lambda r: r[1] == 1 and not r[2]), ((1, True), 1, lambda r: r[1] == 1)):
        r = got[cell]
        assert r.level == level and np.allclose([r.q10, r.q50, r.q90], want(test))
        assert np.isclose(r.blind_q90, want(lambda x: x[1] == cell[0])[2]) and np.isclose(r.event_part, max(0, r.q90 - r.blind_q90))
    assert got[(1, True)].n == 8
    alone = {r.level for r in runs.envelopes(df, "signal", ["part", "lifted"], "value", least=201).collect()}
    assert alone == {0}


def test_window_holds_exactly_the_newest_values():
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(0, 1, 700), rng.normal(4, 2, 300), rng.normal(1e6, 1, 300)])
    window = monitors.AdaptiveWindow(0.002)
    for i, v in enumerate(values):
        window.add(float(v))
        if i % 32 == 31:
            window.shrink()
        sizes, means, variance = window.totals()
        kept = values[i + 1 - int(sizes.sum()) : i + 1]
        assert np.isclose(np.average(means, weights=sizes), kept.mean()) and np.isclose(variance, kept.var(), rtol=1e-6, atol=1e-6)
        assert all(len(level) <= 5 for level in window.levels)
    assert sizes.sum() <= 320


def test_adaptive_drift_fires_after_the_shift_only_whatever_the_partitions(spark):
    rng = np.random.default_rng(7)
    rows = [(s, i, i, float(rng.normal(3 if s == "moved" and i >= 300 else 0, 1))) for s in ("calm", "moved") for i in range(600)]
    rows += [("calm", 1000, 1000, None), ("calm", 1001, 1001, float("nan")), (None, 1, 1, 1.0), ("short", 0, 0, 1.0), ("level", 0, 0, 2.0)] + [("level", i, i, 2.0) for i in range(1, 64)]
    df = spark.createDataFrame(rows, "stream string, at long, id long, value double")
    got = [sorted(map(tuple, monitors.adaptive_drift(df.repartition(n)).collect())) for n in (1, 7)]
    assert got[0] == got[1]
    fired = [(s, place) for s, place, *_, alarm in got[0] if alarm]
    assert fired and {s for s, _ in fired} == {"moved"} and 300 <= min(p for _, p in fired) <= 340
    assert [r[:4] for r in got[0] if r[0] == "level"] == [("level", 31, 31, 32), ("level", 63, 63, 64)]
    assert monitors.adaptive_drift(df.limit(0)).count() == 0
