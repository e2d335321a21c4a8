"""Streams against the same rules told row by row, and the sink under redelivery."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from galena.streaming import delivery
from galena.streaming.ticks import keyed_ticks, observations, observations_sink

SCHEMA = "key string, us long, value double"


def streamed(spark, tmp_path, batches, **how):
    """What a stream gives whose micro-batches are ``batches``."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, rows in enumerate(batches):
        pd.DataFrame(rows, columns=["key", "us", "value"]).astype({"us": "Int64", "value": "Float64"}).to_parquet(source / f"{i:04}.parquet")
        import os

        os.utime(source / f"{i:04}.parquet", (1_700_000_000 + i,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = keyed_ticks(stream, **how).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(str(out)).select("key", "tick", "n", "total", "late", "evicted").collect())


def test_empty_ticks_late_rows_and_eviction(spark, tmp_path):
    batches = [[("a", 25, 1.0), ("a", 21, 2.0), ("b", 5, 1.0), (None, 5, 1.0), ("a", None, 1.0)], [("a", 62, 4.0), ("b", 9, None)], [("a", 20, 9.0), ("a", 58, 1.0)], [("a", 90, 1.0), ("b", 19, 0.0), ("a", 30, 1.0)]]
    got = streamed(spark, tmp_path, batches, width=10, lateness=5)
    assert [r for r in got if r[0] == "a"] == [("a", 2, 2, 3.0, 0, 0), ("a", 3, 0, 0.0, 0, 0), ("a", 4, 0, 0.0, 0, 0), ("a", 5, 1, 1.0, 2, 0), ("a", 6, 1, 4.0, 2, 0), ("a", 7, 0, 0.0, 2, 0)]
    assert [r for r in got if r[0] == "b"] == [("b", 0, 2, 1.0, 0, 0)]


def test_capacity_drops_the_oldest_open_ticks(spark, tmp_path):
    got = streamed(spark, tmp_path, [[("a", t, 1.0) for t in (5, 15, 25, 35)], [("a", 145, 1.0)]], width=10, lateness=100, capacity=2)
    assert got == [("a", 0, 0, 0.0, 0, 2), ("a", 1, 0, 0.0, 0, 2), ("a", 2, 1, 1.0, 0, 2), ("a", 3, 1, 1.0, 0, 2)]


def test_a_wrong_timestamp_closes_no_ticks_and_downtime_begins_anew(spark, tmp_path):
    batches = [[("a", 5, 1.0)], [("a", 3_000_000, 7.0), ("a", 25, 2.0)], [("a", 47, 3.0)], [("a", 1_000, 1.0), ("a", 1_021, 1.0)], [("a", 1_040, 1.0)]]
    got = streamed(spark, tmp_path, batches, width=10, lateness=5, jump=50)
    assert got == [("a", 0, 1, 1.0, 0, 0), ("a", 1, 0, 0.0, 0, 0), ("a", 2, 1, 2.0, 0, 0), ("a", 3, 0, 0.0, 0, 0), ("a", 4, 1, 3.0, 0, 0), ("a", 100, 1, 1.0, 0, 0), ("a", 101, 0, 0.0, 0, 0), ("a", 102, 1, 1.0, 0, 0)]


def test_ticks_against_rules_told_batch_by_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    batches = [[(str(rng.choice(["x", "y"])), int(b * 40 + rng.integers(-60, 60)), float(rng.integers(0, 9))) for _ in range(30)] for b in range(8)]
    wanted = []
    for key in "xy":
        start, high, late, kept = None, -(10**9), 0, []
        for rows in batches:
            of = [(u // 10, v) for k, u, v in rows if k == key]
            if not of:
                continue
            high = max(high, *(u for k, u, _ in rows if k == key))
            start = min(t for t, _ in of) if start is None else start
            late += sum(t < start for t, _ in of)
            kept += [x for x in of if x[0] >= start]
            end = max(start, (high - 15) // 10)
            wanted += [(key, t, sum(x == t for x, _ in kept), sum(v for x, v in kept if x == t), late, 0) for t in range(start, end)]
            start = end
    assert streamed(spark, tmp_path, batches, width=10, lateness=15) == sorted(wanted)


def test_sink_is_unchanged_by_redelivery(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i, 86_400_000_000 * (i % 3), i * 1.0, 1) for i in range(20)]
    schema = "id long, us long, value double, revision long"
    spark.createDataFrame(rows, schema).write.parquet(str(source))
    for attempt in ("c1", "c2"):  # the second run has lost its position and sends all again
        stream = spark.readStream.schema(schema).parquet(str(source))
        observations_sink(stream, str(tmp_path / "out"), str(tmp_path / attempt), "us").awaitTermination(120)
        if attempt == "c1":
            spark.createDataFrame([(3, 0, 9.0, 2)], schema).write.mode("append").parquet(str(source))
    got = observations(spark.read.parquet(str(tmp_path / "out")), ["id"], "revision")
    assert sorted(map(tuple, got.select("id", "us", "value", "revision").collect())) == sorted([r for r in rows if r[0] != 3] + [(3, 0, 9.0, 2)])


def batches_of(tmp_path, batches, columns, types):
    import os

    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        df = pd.DataFrame(rows, columns=columns).astype(types)
        df["ts"] = pd.to_datetime(df["ts"], unit="s").astype("datetime64[us]")
        df.to_parquet(source / f"{i:04}.parquet")
        os.utime(source / f"{i:04}.parquet", (1_700_000_000 + i,) * 2)
    return str(source)


def test_redelivery_is_silent_and_conflicts_are_told_or_refused(spark, tmp_path):
    batches = [[("a", 1, 10, "x"), ("a", 1, 10, "x"), ("b", 1, 10, None)], [("a", 1, 10, "x"), ("a", 2, 11, "y")], [("a", 2, 11, "z"), ("c", 1, 12, "q"), ("c", 1, 12, "p"), (None, 1, 12, "n")]]
    source = batches_of(tmp_path, batches, ["key", "tick", "ts", "signature"], {"tick": "Int64"})
    stream = lambda: spark.readStream.schema("key string, tick long, ts timestamp, signature string").option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda df, name: df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    outcomes = lambda: delivery.delivered(stream(), "1 minute", 60_000)
    run(outcomes(), "told").awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "told")).collect())
    assert got == [("a", 1, "x", "first"), ("a", 2, "y", "first"), ("a", 2, "z", "conflict"), ("b", 1, "", "first"), ("c", 1, "p", "first"), ("c", 1, "q", "conflict")]
    with pytest.raises(StreamingQueryException, match="conflicting redelivery of (a at tick 2|c at tick 1)"):
        run(delivery.refuse_conflicts(outcomes()), "refused").awaitTermination(120)


def test_contexts_are_read_again_and_the_last_ones_outlive_a_failure(spark, tmp_path):
    batches = [[("a", 1, 10, "x")], [("b", 1, 10, "x")], [("c", 1, 10, "x")]]
    source = batches_of(tmp_path, batches, ["key", "tick", "ts", "signature"], {"tick": "Int64"})
    stream = spark.readStream.schema("key string, tick long, ts timestamp, signature string").option("maxFilesPerTrigger", 1).parquet(source)
    calls = []

    def read():
        calls.append(1)
        if len(calls) == 2:
            return spark.read.parquet(str(tmp_path / "absent"))
        return spark.createDataFrame([(len(calls),)], "version int")

    delivery.with_contexts(stream, read, lambda rows, contexts: rows.select("key").join(contexts), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r.key, r.version) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()) == [("a", 1), ("b", 1), ("c", 3)]
    import shutil

    shutil.copy(f"{source}/0002.parquet", f"{source}/0003.parquet")  # restarted, with contexts that can't be read at first: those from before serve
    calls[:] = [1]
    delivery.with_contexts(stream, read, lambda rows, contexts: rows.select("key").join(contexts), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r.key, r.version) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()) == [("a", 1), ("b", 1), ("c", 3), ("c", 3)]
