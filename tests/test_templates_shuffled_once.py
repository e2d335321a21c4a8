"""Log templates: lines are shuffled to be counted and to be learned, and no more."""

import random

import pytest
from pyspark.sql import functions as F

from galena.operators import selection, templates


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines(spark, n=200):
    rng = random.Random(3)
    return spark.createDataFrame([("a", f"{rng.choice('xyz')}{i} put {rng.choice('pqr')} of {rng.choice('stu')}" if i % 2 else f"word{chr(97 + i % 26)}x own line of {chr(97 + i % 23)} here") for i in range(n)], "source string, line string")


def test_leaves_are_told_without_shuffling_lines(spark):
    got = templates.in_tree(templates.masked_lines(lines(spark), ["source"]), ["source"], children=3, part_lines=5)
    joins = [x for x in plan(got).splitlines() if "Join" in x]
    assert joins and all("strategy=broadcast" in x for x in joins), "lines are shuffled to meet first words"
    assert {r.child for r in got.collect()} == {"<*>", "wordax", "wordcx"} and got.where("parts > 1").count()


def test_lines_that_are_templates_meet_no_other(spark):
    rng = random.Random(4)
    own = [("a", " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x" for _ in range(6))) for _ in range(40)]
    got = templates.line_templates(lines(spark).unionByName(spark.createDataFrame(own, "source string, line string")), ["source"])
    top = got._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() == "Union" and "Join" not in top.children().apply(0).toString(), "every line is joined with its template"
    rows = got.collect()
    assert sum(r.template == r.leader for r in rows) > 20 and any(r.template != r.leader for r in rows)


def test_words_new_at_their_place_agree_with_nothing():
    rows = [(["a", "b", "c", "d"], 9), (["b", "a", "d", "c"], 8), (["a", "x", "c", "d"], 7), (["<*>", "q", "c", "d"], 6)]
    assert templates._learn(rows, 0.5) == [(["<*>", "<*>", "c", "d"], 22), (["b", "a", "d", "c"], 8)]


@pytest.mark.parametrize("line", ["", "a b", "a1 b", "1", "ab12c d", "x  7\ty", "\t9", "é3 ü", "a-b:80/c", "no\x0bnumbers\there", "  ", None, "1 2 3", "a 1"])
def test_masks_are_those_of_the_rule(spark, line):
    old = F.regexp_replace("line", r"\S*[0-9]\S*", "<*>")
    r = spark.createDataFrame([(line,)], "line string").select(old.alias("a"), selection.template(F.col("line")).alias("b"), F.regexp_replace(old, r"\s+", " ").alias("c"), templates.masked(F.col("line")).alias("d")).first()
    assert (r.a, r.c) == (r.b, r.d)
