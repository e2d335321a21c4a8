"""Every declarative operator against DuckDB on the smallest tables, and the fold against a worked case."""

import math
import subprocess
import sys

import pandas as pd
import pytest

from galena import catalog
from galena.operators.decompose import decompose

SF = "/root/testdata/sf0.001"
CHECKED = sorted(k for k, (_, sql) in catalog.QUERIES.items() if sql)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    same = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([same(v) for v in row]) for row in df.values.tolist())


@pytest.fixture(scope="module")
def wanted(tmp_path_factory):
    """Oracle results, from a process of their own."""
    out = tmp_path_factory.mktemp("oracle") / "out.pkl"
    code = f"""
import duckdb, os, pickle, sys
sys.path.insert(0, {sys.path[0]!r})
from galena import catalog
con = duckdb.connect()
for f in os.listdir({SF!r}):
    con.sql(f"create view {{f[:-8]}} as select * from read_parquet('{SF}/{{f}}')")
pickle.dump({{k: con.sql(sql).df() for k, (_, sql) in catalog.QUERIES.items() if sql}}, open({str(out)!r}, "wb"))
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    return pd.read_pickle(out)


@pytest.mark.parametrize("name", CHECKED)
def test_statement(spark, wanted, name):
    got = catalog.QUERIES[name][0](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(wanted[name].columns)
    assert rows(got) == rows(wanted[name])


def test_decomposition_worked_case(spark):
    observed = [4] * 32 + [10] * 10 + [16] * 8
    rates = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(observed)], "service string, tick long, observed double")
    lifts = spark.createDataFrame([(i, 1.5) for i in range(32, 50)], "tick long, lift double")
    got = {r.tick: r for r in decompose(rates, lifts).collect()}
    assert got[29].status == "warming" and got[30].base == 4
    assert (got[35].event, got[35].residual, got[35].score) == (6, 0, 0)
    assert (got[45].low, got[45].high, got[45].residual, got[45].score) == (8.5, 11.5, 6, 1)


def test_streaming_windows(spark, tmp_path):
    from galena.streaming.windows import feature_windows, first_seen

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df in (("fw", feature_windows(stream)), ("fs", first_seen(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(120)
    assert 0 < spark.table("fw").count() and spark.table("fs").count() == events.count()
