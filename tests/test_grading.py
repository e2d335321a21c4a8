"""Worked cases of grades, pages and sequences; reconstruction against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.operators import grading, sequences


def test_kind_scores(spark):
    rows = [("a", i, i, float(i)) for i in range(1, 21)] + [("a", 50, None, 99.0), ("a", None, 60, 99.0), ("a", 70, 70, None), ("b", None, 1, None), ("c", None, None, 3.0)]
    got = {r.kind: tuple(r)[1:] for r in grading.kind_scores(spark.createDataFrame(rows, "kind string, symptom long, label long, latency double")).collect()}
    assert got == {"a": (21, 1, 1, 21 / 22, 21 / 22, 10.0, 19.0), "b": (0, 0, 1, None, 0.0, None, None), "c": (0, 0, 0, None, None, None, None)}


def test_reference_windows(spark):
    decisions = spark.createDataFrame([(1, [7, 8, 8]), (2, [9]), (3, []), (4, None), (5, [7, None])], "id long, refs array<long>")
    labels = spark.createDataFrame([(7, 10, 20), (8, 5, 12)], "label long, start long, end long")
    got = {r.id: (r.start, r.end, r.missing) for r in grading.reference_windows(decisions, labels).collect()}
    assert got == {1: (5, 20, []), 2: (None, None, [9]), 3: (None, None, []), 4: (None, None, []), 5: (10, 20, [])}


def test_pages_say_whether_more_follows(spark):
    df = spark.range(10).withColumn("at", 9 - F.col("id"))
    for size, wanted in ((3, [(9, True), (8, True), (7, True)]), (10, None), (11, None)):
        got = [(r.id, r.truncated) for r in grading.page(df, [F.asc("at")], size).collect()]
        assert got == (wanted or [(i, False) for i in range(9, -1, -1)])
    assert [(r.id, r.truncated) for r in grading.range_page(df, "at", 2, 4, [F.asc("at")], 3, 5).collect()] == [(7, False), (6, False), (5, False)]
    for bad in ((4, 2, 3), (0, 6, 3), (0, 1, 0), (0, 1, 10_001)):
        with pytest.raises(ValueError):
            grading.range_page(df, "at", bad[0], bad[1], [F.asc("at")], bad[2], 5)
    assert grading.page(df.limit(0), [F.asc("at")], 3).count() == 0


def test_sequences_stay_in_sessions(spark):
    rows = [("s", t, i, float(i)) for i, t in enumerate([0, 1, 2, 3, 4, 100, 101, 102, 250])] + [("t", 0, 99, None), ("t", 0, 98, 1.0)]
    got = sorted(tuple(r) for r in sequences.sequences(spark.createDataFrame(rows, "stream string, at long, id long, x double"), ["x"], 10, 2).collect())
    assert got == [("s", 1, 0, 0, [0.0, 1.0]), ("s", 1, 1, 2, [2.0, 3.0]), ("s", 2, 0, 5, [5.0, 6.0]), ("t", 1, 0, 98, [1.0, 0.0])]


def test_reconstruction_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 6)) + rng.normal(size=(200, 6)) * 0.1 + 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    got = {r.id: r.error for r in sequences.reconstruction_error(df, F.col("id") < 150, 2).collect()}
    mean = x[:150].mean(axis=0)
    axes = np.linalg.svd(x[:150] - mean, full_matrices=False)[2][:2]
    left = (x - mean) - (x - mean) @ axes.T @ axes
    assert [got[i] for i in range(200)] == pytest.approx((left**2).mean(axis=1), abs=1e-9)
