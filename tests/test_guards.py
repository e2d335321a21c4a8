"""Outcomes, paths and the breaker against their rules told case by case."""

import random

import pytest
from pyspark.sql import functions as F

from galena.operators import guards

PATHS = {
    "http://a/b": "/b", "https://a.b:80/c?d=e": "/c", "HTTP://a/": "/", "http://a": None, "http://a?x": None, "http:///b": None, "ftp://a/b": None, "http://u@a/b": None, "http://u:p@a/b": None,
    "http://a:0/b": None, "http://a:65535/b": "/b", "http://a:65536/b": None, "http://a:/b": "/b", "http://a:x/b": None, "http://a/b#c": None, "http://a/b#": "/b", " http://a/b": None, "http://a/b ": None, "": None, None: None, "/b": None, "http://[::1]:8/b": "/b",
}


def test_paths(spark):
    got = spark.createDataFrame([(u,) for u in PATHS], "u string").select("u", guards.http_path(F.col("u")).alias("p")).collect()
    assert {r.u: r.p for r in got} == PATHS


@pytest.mark.parametrize(
    "row,want",
    [(("3", 1, 5.0, "0", None), "ok"), (("3", 1, 5.0, "0", "1"), "ok"), (("3", 1, 5.0, "14", "2"), "failed"), (("3", 1, 5.0, "14", "1"), None), (("3", 1, 5.0, "0", "2"), None), (("3", 1, 5.0, "0", "x"), "ok"),
     (("2", 1, 5.0, "0", None), None), (("3", 2, 5.0, "0", None), None), (("3", 1, -1.0, "0", None), None), (("3", 1, 5.0, "256", None), None), (("3", 1, 5.0, None, None), None), (("3", 1, 5.0, "1.0", None), None), ((None, 1, 5.0, "0", None), None)],
)
def test_outcomes(spark, row, want):
    df = spark.createDataFrame([row], "k string, t int, l double, c string, s string")
    assert df.select(guards.rpc_outcome(*map(F.col, "ktlcs")).alias("o")).first().o == want


def test_breaker_by_the_rule(spark):
    rng = random.Random(3)
    actions = [(i, rng.randint(0, 400), rng.choice("abc"), rng.choice([None, 0.0, 0.04, 0.05, 0.3])) for i in range(60)]
    asked = [(i, rng.randint(-5, 450)) for i in range(80)] + [(100, actions[0][1]), (101, actions[0][1] + 50)]
    got = {r.ask_id: (r.recent, r.tripped, r.service) for r in guards.breaker(spark.createDataFrame(asked, "ask_id int, at long"), spark.createDataFrame(actions, "id int, us long, service string, improvement double"), 50, 9, 2).collect()}
    want = {}
    for ask, at in asked:
        recent = sorted((a for a in actions if at - 50 < a[1] <= at), key=lambda a: (a[1], a[0]))
        weak = [s for s in "abc" if len(t := [a[3] for a in recent if a[2] == s and a[3] is not None][-2:]) == 2 and max(t) < 0.05]
        want[ask] = (len(recent), "RATE", None) if len(recent) >= 9 else (len(recent), "INEFFECTIVE", weak[0]) if weak else (len(recent), None, None)
    assert got == want and {t for _, t, _ in got.values()} == {None, "RATE", "INEFFECTIVE"}
