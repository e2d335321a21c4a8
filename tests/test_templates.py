"""The template tree against its rules told line by line."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from galena.operators import templates


def learn(lines, similarity):
    held = []
    for words, n in lines:
        best = max(held, key=lambda t: (sum(a == b != "<*>" for a, b in zip(t[0], words)), t[0].count("<*>")), default=None)
        if best and sum(a == b != "<*>" for a, b in zip(best[0], words)) >= similarity * len(words):
            best[0] = [a if a == b else "<*>" for a, b in zip(best[0], words)]
            best[1] += n
        else:
            held.append([words, n])
    return held


def told(lines, similarity, children, part_lines):
    counts = Counter()
    for source, line in lines:
        line = re.sub(r"\S*[0-9]\S*", "<*>", line.strip(" ")) if line else ""
        if line:
            counts[source, re.sub(r"\s+", " ", line)] += 1
    words_of = {k: k[1].split(" ") for k in counts}
    firsts = defaultdict(Counter)
    for k, n in counts.items():
        if words_of[k][0] != "<*>":
            firsts[k[0], len(words_of[k])][words_of[k][0]] += n
    own = {node: {w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: children - 1]} for node, c in firsts.items()}
    leaves = defaultdict(list)
    for k, n in counts.items():
        words = words_of[k]
        leaves[k[0], len(words), words[0] if words[0] in own.get((k[0], len(words)), ()) else "<*>"].append((k[1], n))
    final = defaultdict(Counter)
    for (source, length, _), rows in leaves.items():
        parts, dealt, again = -(-len(rows) // part_lines), defaultdict(list), Counter()
        for line, n in sorted(rows, key=lambda r: (-r[1], r[0])):
            dealt[int(hashlib.md5(line.encode()).hexdigest()[:8], 16) % parts].append((line.split(" "), n))
        for some in dealt.values():
            for words, n in learn(some, similarity):
                again[" ".join(words)] += n
        for words, n in learn([(t.split(" "), n) for t, n in sorted(again.items(), key=lambda r: (-r[1], r[0]))], similarity):
            final[source, length][" ".join(words)] += n
    out = set()
    for (source, line), n in counts.items():
        words = line.split(" ")
        fits = [(t.split(" ").count("<*>"), -m, t) for t, m in final[source, len(words)].items() if all(b in ("<*>", a) for a, b in zip(words, t.split(" ")))]
        out.add((source, line, n, min(fits)[2]))
    return out


@pytest.mark.parametrize("similarity,children,part_lines", [(0.4, 100, 4096), (0.4, 3, 4096), (0.6, 100, 5), (0.25, 2, 3)])
def test_every_line_gets_the_template_of_the_rule(spark, similarity, children, part_lines):
    rng = random.Random(part_lines)
    words = ["get", "put", "user", "failed", "ok", "id7", "42", "disk", "<*>", "ärger"]
    lines = [(rng.choice("ab"), rng.choice(["", " ", "  "]).join(["", ""]) + " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) + rng.choice(["", " ", "\t"])) for _ in range(900)]
    lines += [("a", ""), ("a", "   "), ("b", None), ("b", "long " * 3000 + "7")]
    got = {tuple(r) for r in templates.line_templates(spark.createDataFrame(lines, "source string, line string"), ["source"], similarity, children, part_lines).select("source", "template", "n", "leader").collect()}
    assert got == told(lines, similarity, children, part_lines)
    assert len({r[3] for r in got}) < len(got)


def test_no_lines(spark):
    assert templates.line_templates(spark.createDataFrame([], "source string, line string"), ["source"]).count() == 0


def test_masks_stay_whole():
    assert templates._learn([(["a", "b", "c"], 3), (["a", "b", "d"], 2), (["x", "b", "e"], 1)], 0.4) == [(["a", "b", "<*>"], 5), (["x", "b", "e"], 1)]


def test_lines_are_mined_once_and_words_not_shuffled(spark):
    rows = spark.createDataFrame([("a", f"get item {w} of {v}") for w in "abcdef" for v in "xyz"], "source string, line string")
    got = templates.line_templates(rows, ["source"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "LogicalRDD" not in plan and plan.count("Relation") >= 2, "lines are masked or learned again for each use"
    dealt = templates.in_tree(templates.masked_lines(rows, ["source"]), ["source"])
    assert "array" not in dict(dealt.dtypes)["template"] and "words" not in dealt.columns
    assert {r.leader for r in got.collect()} == {"get item <*> of <*>"}
