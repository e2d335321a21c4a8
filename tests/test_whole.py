"""Statements that take every event, against counts made without SQL."""

from collections import Counter, defaultdict

from galena import catalog

SF = "/root/testdata/sf0.001"


def test_every_change_and_event_takes_part(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    at = events.ts.astype("datetime64[us]").astype("int64")
    want = Counter()
    changes = at[events.event_type == "signup"]
    for event, us in zip(events.event_id, at):
        n = int(((changes <= us) & (changes > us - 3600000000)).sum())
        if n:
            want[event] = n
    got = catalog.QUERIES["change_pressure_all"][0](spark, SF).collect()
    assert {r.event_id: r.changes for r in got} == want


def test_every_event_is_listed_and_every_decision_answered(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    refs = defaultdict(set)
    for user, event in zip(events.user_id, events.event_id):
        refs[user].add(str(event))
    got = catalog.QUERIES["ordered_distinct_all"][0](spark, SF).collect()
    assert {r.user_id: set(r.refs.split(",")) for r in got} == refs
    got = catalog.QUERIES["episodes_at_decision"][0](spark, SF).collect()
    days = {us // 86400000000 for us in events.ts.astype("datetime64[us]").astype("int64")}
    assert len(got) == len(refs) * len(days) == len({(r.id, r.decided) for r in got})
