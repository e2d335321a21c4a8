"""Ticks of a keyed stream that close by the key's own watermark, empty ones too, and a sink that redelivery does not change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

_OUT = "key string, tick long, n long, total double, late long, evicted long, ahead long"
_STATE = "high long, next long, late long, evicted long, ticks array<long>, counts array<long>, totals array<double>, firsts array<long>, lasts array<long>"
_CHUNK = 10_000


def keyed_ticks(events: DataFrame, width: int, lateness: int, capacity: int = 1000, jump: int | None = None) -> DataFrame:
    """(key, tick, n, total, late, evicted, ahead) of each tick of a stream (key, us, value) as it closes, once and in order.

    A key's ticks are anchored at the first one it is seen in.  A tick closes when floor((newest - lateness) / width) has
    passed it, where newest is the key's own; ticks without rows are given too.  Rows of closed ticks are late: counted and
    dropped.  Which rows are late depends on the micro-batches, not on the order inside one.  Of more than ``capacity`` open
    ticks the oldest lose their rows, which are counted, and still close, empty.  ``late`` and ``evicted`` are totals so far.
    Rows without key or us are left out; a null value counts as a row.

    The newest time moves in steps of at most ``jump`` (1000 widths unless given).  Rows beyond a wider step wait, ``ahead`` counts them, and
    close nothing, so one wrong timestamp closes no more ticks than fit in the jump.  When all rows of a key in a micro-batch lie beyond, its
    open ticks close and it begins anew at the first of them, without empty ticks for the time between.
    """
    jump = 1000 * width if jump is None else jump

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        high, start, late, evicted, held = None, None, 0, 0, {}
        if state.exists:
            high, start, late, evicted, *lists = state.get
            held = {t: list(x) for t, *x in zip(*lists)}
        got: dict[int, list] = {}
        for frame in frames:
            sums = frame.assign(value=frame["value"].fillna(0.0)).groupby(frame["us"] // width).agg(n=("us", "size"), total=("value", "sum"), first=("us", "min"), last=("us", "max"))
            for tick, *one in sums.itertuples():
                _add(got, int(tick), one)
        first = min(x[2] for x in got.values())

        def closed(until: int) -> Iterator[pd.DataFrame]:
            for lo in range(start, until, _CHUNK):
                ticks = range(lo, min(lo + _CHUNK, until))
                sums = [held.pop(t, (0, 0.0)) for t in ticks]
                yield pd.DataFrame({"key": key[0], "tick": list(ticks), "n": [x[0] for x in sums], "total": [x[1] for x in sums], "late": late, "evicted": evicted, "ahead": ahead})

        ahead = 0
        if high is not None and first > high + jump:
            ahead = sum(x[0] for t, x in held.items() if t > high // width) + sum(x[0] for x in got.values())
            yield from closed(max(start, high // width + 1))
            start, high = min(first // width, min(held, default=first // width)), None
        start = min(got) if start is None else start
        high = min(x[2] for x in (*held.values(), *got.values())) if high is None else high
        for tick, one in got.items():
            if tick < start:
                late += one[0]
                high = max(high, one[3])
            else:
                _add(held, tick, one)
        for tick in sorted(held):
            if held[tick][2] > high + jump:
                break
            high = max(high, held[tick][3])
        ahead = sum(x[0] for t, x in held.items() if x[2] > high)
        end = max(start, (high - lateness) // width)
        for tick in sorted(t for t in held if t >= end)[:-capacity]:
            evicted += held.pop(tick)[0]
        yield from closed(end)
        left = sorted(held)
        state.update((high, end, late, evicted, left, *([held[t][i] for t in left] for i in range(4))))

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("us").cast("long").alias("us"), F.col("value").cast("double").alias("value")).where("key IS NOT NULL AND us IS NOT NULL")
    return rows.groupBy("key").applyInPandasWithState(fold, _OUT, _STATE, "append", "NoTimeout")


def _add(held: dict[int, list], tick: int, more: list) -> None:
    """``more``, (rows, total, first and last time), to those of a tick."""
    n, total, first, last = int(more[0]), float(more[1]), int(more[2]), int(more[3])
    if tick in held:
        had = held[tick]
        n, total, first, last = had[0] + n, had[1] + total, min(had[2], first), max(had[3], last)
    held[tick] = [n, total, first, last]


def observations_sink(stream: DataFrame, path: str, checkpoint: str, day: str) -> StreamingQuery:
    """Write a stream as Parquet below ``path``, a folder for each micro-batch, by the days of ``day`` (microseconds).

    A micro-batch that is delivered again replaces its own folder, and the position moves on only after it is written; what a
    restarted producer sends twice is told apart by content in ``observations``.  Runs until the input is used up.
    """

    def write(batch: DataFrame, number: int) -> None:
        dated = batch.withColumn("day", F.floor(F.col(day) / 86_400_000_000))
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observations(df: DataFrame, key: list[str], revision: str) -> DataFrame:
    """The newest row of each key of what the sink wrote (a redelivered row once; of equal revisions the last batch's)."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(revision), F.desc("batch")))
    return df.withColumn("_newest", newest).where("_newest = 1").drop("_newest", "batch", "day")
