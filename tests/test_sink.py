"""The partitioned sink: redelivery, replaced revisions, retention, conflicts, pruning and order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from galena.sources.sink import DAY_US, PartitionedSink, SinkConflict, partitioned_sink

SCHEMA = "service string, signal string, us long, id long, revision long, value double"


def some(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a b", "c/d", "é=1"]), rng.choice(["rate", "log"]), rng.randint(0, 4 * DAY_US - 1), i, 1, float(rng.randint(0, 9))) for i in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("service", "signal", "us", "id", "revision", "value").collect())


def test_revisions_and_redelivery(spark, tmp_path):
    sink = PartitionedSink(spark, str(tmp_path / "s"), SCHEMA)
    assert sink.version() == 0 and sink.read().count() == 0
    data = some(60)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert sink.write(frame(data[:40]), 0) == 1
    newer = [(*r[:4], 2, 99.0) for r in data[:5]] + [(*r[:4], 0, -1.0) for r in data[5:9]]
    assert sink.write(frame(data[40:] + newer + data[:3] + [(None, "rate", 5, 900, 1, 1.0), ("a b", "rate", None, 901, 1, 1.0)]), 1) == 2
    want = sorted([(*r[:4], 2, 99.0) for r in data[:5]] + data[5:])
    assert rows_of(sink.read()) == want and sink.state().refused == 2
    assert sink.write(frame(some(30, 5)), 1) == 2 and rows_of(sink.read()) == want  # the micro-batch is there
    assert rows_of(sink.read(version=1)) == sorted(data[:40])
    before = sink.parts().count()
    sink.clean()
    assert rows_of(sink.read()) == want and sink.parts().count() == before
    assert sink._data().count() == len(want)


def test_retention_drops_whole_days_and_keeps_them_out(spark, tmp_path):
    sink = PartitionedSink(spark, str(tmp_path / "s"), SCHEMA)
    data = some(80)
    sink.write(spark.createDataFrame(data, SCHEMA), 0)
    sink.expire(2)
    left = sorted(r for r in data if r[2] >= 2 * DAY_US)
    assert rows_of(sink.read()) == left and {f.name for f in (tmp_path / "s" / "data").iterdir() if f.name.startswith("day")} == {"day=2", "day=3"}
    sink.write(spark.createDataFrame(data, SCHEMA), 1)  # a producer sends all again
    assert rows_of(sink.read()) == left and sink.state().refused == len(data) - len(left)


def test_folders_are_pruned_and_files_sorted(spark, tmp_path):
    sink = PartitionedSink(spark, str(tmp_path / "s"), SCHEMA)
    sink.write(spark.createDataFrame(some(300), SCHEMA).repartition(5), 0)
    one = sink.read((F.col("day") == 1) & (F.col("service") == "c/d"))
    plan = one._jdf.queryExecution().simpleString()
    filters = re.findall(r"PartitionFilters: \[(.*)", plan)
    assert any("(day#" in f and "= 1)" in f and "c/d" in f for f in filters)
    assert rows_of(one) == sorted(r for r in some(300) if r[0] == "c/d" and r[2] // DAY_US == 1)
    files = [f for f in (tmp_path / "s" / "data").rglob("*.parquet")]
    assert len(files) >= 24
    import pyarrow.parquet as pq

    for f in files:
        us = pq.ParquetFile(f).read(columns=["us"])["us"].to_pylist()
        assert us == sorted(us)


def test_two_writers(spark, tmp_path, monkeypatch):
    one = PartitionedSink(spark, str(tmp_path / "s"), SCHEMA)
    one.write(spark.createDataFrame(some(5), SCHEMA))
    two = PartitionedSink(spark, str(tmp_path / "s"), SCHEMA)
    monkeypatch.setattr(two, "version", lambda: 0)  # it looked before the other one committed
    with pytest.raises(SinkConflict):
        two.write(spark.createDataFrame(some(7, 3), SCHEMA))
    assert one.version() == 1 and rows_of(one.read()) == sorted(some(5))


def test_a_stream_into_the_sink(spark, tmp_path):
    data = some(50)
    for i in range(3):
        spark.createDataFrame(data[i * 10 :], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink = PartitionedSink(spark, str(tmp_path / "s"), SCHEMA)
    for checkpoint in ("c", "c", "d"):  # the third run has lost its position
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        partitioned_sink(stream, sink, str(tmp_path / checkpoint)).awaitTermination(120)
    assert rows_of(sink.read()) == sorted(data)
