"""Redelivery of ticks with and without a conflict, and contexts that are read again for each micro-batch."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

log = logging.getLogger(__name__)


def delivered(stream: DataFrame, late: str, keep_ms: int) -> DataFrame:
    """(key, tick, signature, outcome) of a stream (key, tick, ts, signature): the first signature of a tick, and every other one as a conflict.

    The same signature again says nothing.  Of a tick that arrives with several at once the smallest is the first.  A tick is
    remembered until the watermark (``late`` behind the newest ts) is ``keep_ms`` past its own newest ts.  Rows without key,
    tick or ts are left out; a null signature counts as "".
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, newest = set(), 0
        for frame in frames:
            seen |= set(frame["signature"])
            newest = max(newest, int(frame["ms"].max()))
        known, until = state.get if state.exists else ([], 0)
        fresh = sorted(seen - set(known))
        until = max(until, newest + keep_ms, state.getCurrentWatermarkMs() + 1)
        state.update((list(known) + fresh, until))
        state.setTimeoutTimestamp(until)
        if fresh:
            outcomes = ["conflict" if known or i else "first" for i in range(len(fresh))]
            yield pd.DataFrame({"key": key[0], "tick": key[1], "signature": fresh, "outcome": outcomes})

    rows = stream.select(F.col("key").cast("string").alias("key"), F.col("tick").cast("long").alias("tick"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("signature").cast("string"), F.lit("")).alias("signature"))
    timed = rows.where("key IS NOT NULL AND tick IS NOT NULL AND ts IS NOT NULL").withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("key", "tick").applyInPandasWithState(fold, "key string, tick long, signature string, outcome string", "known array<string>, until long", "append", "EventTimeTimeout")


def refuse_conflicts(outcomes: DataFrame) -> DataFrame:
    """Outcomes of ``delivered`` with conflicts as an error, which stops the query before the micro-batch is written."""
    named = F.concat(F.lit("conflicting redelivery of "), "key", F.lit(" at tick "), F.col("tick").cast("string"))
    return outcomes.withColumn("outcome", F.when(F.col("outcome") == "conflict", F.raise_error(named).cast("string")).otherwise(F.col("outcome")))


def _newest(spark: SparkSession, path: str) -> list[str]:
    """The folder of the newest micro-batch below ``path``, where Spark has finished writing, if there is one."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done) or []
    folders = [str(f.getPath().getParent()) for f in found]
    return [max(folders, key=lambda f: int(f.rpartition("=")[2]))] if folders else []


def with_contexts(stream: DataFrame, read: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``apply(micro-batch, contexts)`` below ``path``, a folder for each micro-batch, until the input is used up.

    Contexts are read before each micro-batch and written beside it.  If that fails the last ones written below ``path``, also before
    a restart, are used again, with a warning; if there are none yet the query fails.  A micro-batch that is delivered again replaces its folders.
    """
    last = _newest(stream.sparkSession, f"{path}/contexts")

    def write(batch: DataFrame, number: int) -> None:
        here = f"{path}/contexts/batch={number}"
        try:
            read().write.mode("overwrite").parquet(here)
            last[:] = [here]
        except PySparkException as e:
            if not last:
                raise
            log.warning("contexts of micro-batch %s not read (%s); the last ones are used", number, type(e).__name__)
        contexts = batch.sparkSession.read.parquet(last[0])
        apply(batch, contexts).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
