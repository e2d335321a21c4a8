"""Grouped operators against worked cases and brute force."""

import itertools

import numpy as np

from galena import catalog
from galena.operators import grouped
from galena.sources import otlp

SF = "/root/testdata/sf0.01"  # the smallest tables have too few episodes


def test_incidents(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "service string, dependency string")
    rows = [("1", "a", 0), ("2", "c", 1), ("3", "b", 2), ("4", "d", 3), ("5", "a", 11), ("6", "a", 40)]
    got = {r.id: (r.incident, r.merged) for r in grouped.incident_clusters(spark.createDataFrame(rows, "id string, service string, opened long"), edges, 10).collect()}
    # 3 touches both 1 and 2; 5 is too late for the anchor of 1, 6 for all
    assert got == {"1": ("1", 0), "2": ("1", 0), "3": ("1", 1), "4": ("4", 0), "5": ("5", 0), "6": ("6", 0)}


def test_incidents_have_the_properties_of_the_rule(spark):
    """First members name incidents; adjacent episodes share one exactly while it can be joined; nothing else holds an incident together."""
    rng = np.random.default_rng(8)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "service string, dependency string")
    linked = {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "x")} | {(s, s) for s in "abcxyz"}
    rows = [(f"{i:03}", str(rng.choice(list("abcxyz"))), int(t)) for i, t in enumerate(np.sort(rng.integers(0, 900, 150)))]
    df = spark.createDataFrame(rows, "id string, service string, opened long")
    home = {r.id: r.incident for r in grouped.incident_clusters(df.repartition(5), edges, 10).collect()}
    opened = {i: t for i, _, t in rows}
    members = {n: [i for i in sorted(home) if home[i] == n] for n in set(home.values())}
    assert len(home) == len(rows) and len(members) > 20 and max(map(len, members.values())) > 3
    assert all(n == ids[0] for n, ids in members.items())  # ids are in the order of opening
    pairs = [(m, e) for m, s, _ in rows for e, t, _ in rows if m < e and (s, t) in linked]
    for m, e in pairs:
        assert (home[m] == home[e]) == (opened[e] - opened[home[m]] <= 10)
    for ids in members.values():
        reached, ahead = set(), [ids[0]]
        while ahead:
            reached.add(one := ahead.pop())
            ahead += [y if x == one else x for x, y in pairs if one in (x, y) and home[x] == home[y] and not {x, y} <= reached]
        assert reached == set(ids)
    without = spark.createDataFrame([("1", None, 0), ("2", None, 1), ("3", "a", 1)], "id string, service string, opened long")
    assert {r.id: r.incident for r in grouped.incident_clusters(without, edges, 10).collect()} == {"1": "1", "2": "2", "3": "3"}
    assert grouped.incident_clusters(df.limit(0), edges, 10).count() == 0


def test_matching_is_largest(spark):
    rng = np.random.default_rng(3)
    labels, found = [], []
    for key in "pqrst":
        labels += [(key, i, int(a), int(a + rng.integers(1, 6))) for i, a in enumerate(rng.integers(0, 10, 5))]
        found += [(key, f"{key}{i}", int(a)) for i, a in enumerate(rng.integers(0, 12, 5))]
    got = grouped.episode_match(spark.createDataFrame(labels, "key string, label long, valid_from long, valid_to long"), spark.createDataFrame(found, "key string, id string, opened long")).collect()
    assert len({(r.key, r.label) for r in got}) == len({r.id for r in got}) == len(got)
    for key in "pqrst":
        mine, theirs = [x for x in labels if x[0] == key], [x for x in found if x[0] == key]
        best = max(sum(l[2] <= f[2] < l[3] for l, f in zip(mine, p)) for p in itertools.permutations(theirs))
        assert sum(r.key == key for r in got) == best


def test_breaks_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        y = rng.random(13) * 0.3 + (np.arange(13) > 6) * rng.random()

        def cost(starts):
            ends = [0, *starts, 13]
            return sum(((y[a:b] - y[a:b].mean()) ** 2).sum() for a, b in zip(ends, ends[1:])) + 0.01 * len(starts)

        every = [c for k in (0, 1, 2) for c in itertools.combinations(range(4, 10), k) if all(b - a >= 4 for a, b in zip([0, *c], [*c, 13]))]
        assert abs(cost(grouped.breaks(y)) - min(map(cost, every))) < 1e-12


def test_saturation(spark):
    rows = [("full", 10.0 * i, 200.0 if i < 8 else 200.0 + 100 * (i - 7), 1000.0) for i in range(16)] + [("flat", 10.0 * i, 500.0, 1000.0) for i in range(16)] + [("short", 1.0, 1.0, 2.0)]
    got = {r.key: r.score for r in grouped.pelt_saturation(spark.createDataFrame(rows, "key string, ts double, used double, capacity double")).collect()}
    assert got == {"full": 1.0, "flat": None}


def test_queries_run(spark):
    for name in grouped.QUERIES:
        assert catalog.QUERIES[name][0](spark, SF).count() > 0


def test_attributes_and_bad_envelopes(spark):
    good = '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"s"}},{"key":"x","value":{"boolValue":true}}]},"scopeLogs":[{"scope":{"attributes":[{"key":"x","value":{"intValue":"2"}}]},"logRecords":[{"observedTimeUnixNano":"5000","body":{"stringValue":"hi"},"attributes":[{"key":"x","value":{"doubleValue":1.5}}]}]}]}]}'
    raw = spark.createDataFrame([(good,), ("not json",), (None,), ("{}",)], "payload string")
    (row,) = otlp.logs(raw).collect()
    assert (row.service, row.us, row.body, row.attributes["x"]) == ("s", 5, "hi", "1.5")
    assert otlp.spans(raw).count() == otlp.scalar_metrics(raw).count() == otlp.aggregate_metrics(raw).count() == 0
