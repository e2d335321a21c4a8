"""Keyed state of streams against the batch operators over the same rows, cut into micro-batches in several ways and across a restart."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galena.operators import lifecycle, queries, selection
from galena.operators.decompose import Rules, decompose
from galena.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    state.rocks(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(folder, batches, first=0):
    """A file for each micro-batch, in order."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches, first):
        rows.to_parquet(f"{folder}/{i:04}.parquet", index=False)
        os.utime(f"{folder}/{i:04}.parquet", (1_700_000_000 + i,) * 2)


def drained(spark, tmp_path, build, schema):
    """Run a query over the files that are there, from its checkpoint on."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out"))


def cut_at(rows, column, cuts):
    """Rows by ascending parts of a column, each part in a shuffled order."""
    places = rows[column].rank(method="dense").astype(int)
    edges = [0, *cuts, places.max()]
    return [rows[(places > a) & (places <= b)].sample(frac=1, random_state=a) for a, b in zip(edges, edges[1:])]


def told(df, columns):
    return sorted((tuple(None if v is None or v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


def rates(spark):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = spark.read.parquet(f"{SF}/events.parquet").groupBy((F.col("user_id") % 2).cast("string").alias("service"), F.floor(us / 21600000000).cast("long").alias("tick")).agg(F.count("*").cast("double").alias("observed"))
    return e.withColumn("lift", F.when(F.col("tick") % 7 == 0, 0.5).otherwise(0.0))


@pytest.mark.parametrize("cuts,restart", [((1, 2, 5, 31, 33), 3), ((4, 9, 10, 11), 1), ((), 1)])
def test_baselines_equal_the_batch_across_a_restart(spark, tmp_path, cuts, restart):
    rules = Rules(warmup=6, alpha=0.3, gate=0.6)
    rows = rates(spark).toPandas()
    batches = cut_at(rows, "tick", cuts)
    schema = "service string, tick long, observed double, lift double"
    columns = ["service", "tick", "observed", "base", "event", "low", "high", "residual", "score", "status"]
    feed(tmp_path / "in", batches[:restart])
    drained(spark, tmp_path, lambda s: state.decomposed(s, rules), schema)
    feed(tmp_path / "in", [*batches[restart:], batches[0]], restart)  # and the first one again: refused
    got = drained(spark, tmp_path, lambda s: state.decomposed(s, rules), schema)
    source = spark.createDataFrame(rows)
    want = decompose(source.drop("lift"), source.select("tick", "lift").distinct(), rules.warmup, rules.alpha, rules.gate, rules.floor, rules.tolerance)
    assert told(got, columns) == told(want, columns)
    assert {r[0] for r in told(got, ["status"])} == {"warming", "ok"}
    last = got.groupBy("service").agg(F.max("frames").alias("frames"), F.max("updates").alias("updates"))
    assert told(last, ["service", "frames"]) == told(want.where("status = 'ok'").groupBy("service").agg(F.count("*").alias("frames")), ["service", "frames"])


def test_a_frozen_baseline_and_refused_ticks(spark, tmp_path):
    batches = [pd.DataFrame({"service": "a", "tick": [1, 2, 3], "observed": [1.0, 9.0, 5.0]}), pd.DataFrame({"service": ["a", "a", None, "a"], "tick": [3, 4, 5, None], "observed": [7.0, 6.0, 1.0, 1.0]}).astype({"tick": "Int64"}), pd.DataFrame({"service": "a", "tick": [5], "observed": [500.0]})]
    feed(tmp_path / "in", batches)
    got = drained(spark, tmp_path, lambda s: state.decomposed(s, Rules(warmup=3, alpha=0.0)), "service string, tick long, observed double")
    assert told(got, ["tick", "base", "status", "refused"]) == [(1, None, "warming", 0), (2, None, "warming", 0), (3, None, "warming", 0), (4, 5.0, "ok", 1), (5, 5.0, "ok", 1)]


@pytest.mark.parametrize("cuts,restart", [((1, 2, 3, 40, 41), 4), ((7, 70), 1), ((), 1)])
def test_episodes_equal_the_batch_across_a_restart(spark, tmp_path, cuts, restart):
    scored = queries._scored(spark, "/root/testdata/sf0.01").toPandas()
    scored["tick"] = scored["tick"].astype("int64")
    policies = queries._policies(spark)
    assert {r.gap for r in policies.collect()} == {"skip", "hold"} and not scored["sufficient"].all()
    batches = cut_at(scored, "tick", cuts)
    schema = "stream string, kind string, tick long, score double, sufficient boolean"
    columns = [c.split()[0] for c in state.TRANSITIONS.split(", ")]
    feed(tmp_path / "in", batches[:restart])
    drained(spark, tmp_path, lambda s: state.episodes(s, policies), schema)
    feed(tmp_path / "in", [*batches[restart:], batches[-1]], restart)  # the last one is delivered again
    got = drained(spark, tmp_path, lambda s: state.episodes(s, policies), schema)
    want = lifecycle.transitions(queries._scored(spark, "/root/testdata/sf0.01"), policies)
    assert told(got, columns) == told(want, columns)
    assert {r[0] for r in told(got, ["action"])} == {"PENDING", "OPENED", "SUSTAINED", "CLEARING", "HELD", "CLOSED"}


@pytest.mark.parametrize("cuts,restart", [((100, 150, 400, 401), 2), ((), 1)])
def test_sliding_windows_equal_the_batch(spark, tmp_path, cuts, restart):
    hour = 3_600_000_000
    rng = np.random.default_rng(5)
    us = np.sort(rng.integers(0, 60 * hour, 600))
    us[::9] = us[::9] // (2 * hour) * 2 * hour  # on the border of a window
    us += 1000 * hour
    calls = pd.DataFrame({"caller": rng.choice(["x", "y"], 600), "service": rng.choice(["s", "t"], 600), "us": us, "value": rng.integers(0, 30, 600).astype(float), "failed": rng.random(600) < 0.2}).sort_values("us")
    batches = cut_at(calls, "us", cuts)
    if len(batches) > 1:  # calls that come up to an hour late
        late = batches[0].iloc[(batches[0]["us"] > batches[0]["us"].max() - hour).to_numpy().nonzero()[0][:3]]
        batches[0], batches[1] = batches[0].drop(late.index), pd.concat([batches[1], late])
    end = pd.DataFrame({"caller": ["end"], "service": ["end"], "us": [2000 * hour], "value": [1.0], "failed": [False]})
    schema = "caller string, service string, us long, value double, failed boolean"
    build = lambda s: state.sliding_edges(s, 12 * hour, 2 * hour, "2 hours")
    feed(tmp_path / "in", batches[:restart])
    drained(spark, tmp_path, build, schema)
    feed(tmp_path / "in", [*batches[restart:], end], restart)
    got = drained(spark, tmp_path, build, schema)
    columns = ["caller", "service", "tick_us", "calls", "p95", "error_rate"]
    want = selection.sliding_edges(spark.createDataFrame(calls), 12 * hour, 2 * hour)
    assert told(got, columns) == told(want, columns)


def test_sliding_windows_refuse_other_steps(spark):
    with pytest.raises(ValueError):
        state.sliding_edges(spark.createDataFrame([], "caller string, service string, us long, value double, failed boolean"), 7_000_000, 2_000_000, "1 hour")
