"""Separation, headline, bounds, offsets, counts and adjacency on worked cases and against brute force."""

import json

import numpy as np

from galena.operators import grading
from galena.sources import otlp


def test_separation_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(rng.integers(0, 6)), bool(rng.integers(0, 2))) for k in ("a", "b") for _ in range(60)] + [("one", 1.0, True), ("a", None, True), ("a", 3.0, None)]
    got = {r.k: r for r in grading.separation(spark.createDataFrame(rows, "k string, score double, positive boolean"), ["k"]).collect()}
    for key in "ab":
        pos, neg = ([s for k, s, p in rows[:120] if k == key and p is which] for which in (True, False))
        want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])
        assert np.isclose(got[key].auc, want) and got[key].n == 60 and np.isclose(got[key].gap, np.mean(pos) - np.mean(neg))
    assert (got["one"].auc, got["one"].positive_mean, got["one"].negative_mean, got["one"].gap) == (None, 1.0, None, None)


def test_headline_is_insufficient_without_labels_of_a_kind(spark):
    schema = "kind string, symptom int, label int, latency double"
    rows = [("a", 1, 1, 5.0), ("a", None, 2, None), ("b", 2, 3, 9.0), ("c", 1, 1, 99.0)]
    of = lambda rows, kinds: tuple(grading.headline(spark.createDataFrame(rows, schema), kinds).first())
    assert of(rows, ["a", "b"]) == ("OK", 0.5, "OK", 9.0, 2)
    assert of(rows, ["a", "none"]) == ("INSUFFICIENT", None, "OK", 5.0, 1)
    assert of([], ["a"]) == ("INSUFFICIENT", None, "INSUFFICIENT", None, 0)


def test_bounds_offsets_and_counts(spark):
    spans = spark.createDataFrame([("ok", 5, True), ("ok", 7, True), ("ok", 7, False), ("late", 9, True), ("late", 8, False), ("bare", 3, False), ("dark", 3, True)], "run string, at long, marker boolean")
    bounds = grading.run_bounds(spans, spark.createDataFrame([(r, 100) for r in ("ok", "late", "bare", "dark", "void")], "run string, duration long"))
    assert {r.run: (r.anchor, r.first, r.end, r.problem) for r in bounds.collect()} == {
        "ok": (7, 7, 107, None), "late": (9, 8, None, "anchor after first span"), "bare": (None, 3, None, "no marker"), "dark": (3, None, None, "no spans"), "void": (None, None, None, "no spans"),
    }
    episodes = spark.createDataFrame([("ok", "x", 10, None), ("ok", "x", 6, 12), ("late", "x", 10, 11)], "run string, kind string, opened long, closed long")
    assert sorted(map(tuple, grading.characterised(episodes, bounds, ["opened", "closed"]).collect())) == [("ok", "x", -1, 5), ("ok", "x", 3, None)]
    assert sorted(map(tuple, grading.counts_by_kind(episodes, bounds, ["x", "y"]).collect())) == [("ok", "x", 2), ("ok", "y", 0)]


def test_adjacency_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, str(rng.choice(list("abcd"))), int(rng.integers(0, 200))) for i in range(80)]
    hops = [("a", "b"), ("b", "a"), ("c", "c"), ("d", "a")]
    near = {frozenset(h) for h in hops}
    want = sorted((x[0], y[0], y[2] - x[2]) for x in rows for y in rows if 0 <= y[2] - x[2] <= 10 and (y[2] > x[2] or y[0] > x[0]) and (x[1] == y[1] or frozenset((x[1], y[1])) in near))
    got = grading.adjacent(spark.createDataFrame(rows, "id int, service string, opened long"), spark.createDataFrame(hops, "a string, b string"), 10)
    assert sorted(map(tuple, got.collect())) == want


def test_a_bad_span_rejects_its_envelope(spark):
    def envelope(*spans):
        resource = {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}]}
        return json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": [{"name": n, "startTimeUnixNano": a, "endTimeUnixNano": b}]} for n, a, b in spans]}]})

    raw = spark.createDataFrame([(envelope(("a", "1000", "3000"), ("b", "1000", "1000")),), (envelope(("c", "1000", "3000"), ("d", "2000", "1000")),), (envelope(("e", "1000", "2000"), ("f", None, "1000")),), ("{",), (None,), ("{}",)], "payload string")
    assert sorted(r.name for r in otlp.spans(raw).collect()) == ["a", "b"]
