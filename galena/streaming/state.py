"""Keyed state of a stream: baselines, episodes and sliding windows, each equal to its batch operator for any cut into micro-batches.

The processors keep their state in Spark's state store, so a stream goes on after a restart from its checkpoint; the session
needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider (``rocks`` does that).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decompose import SCHEMA, Rules

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITIONS = "stream string, tick long, score double, class string, action string, phase string, number long, opened long, breaches long, revision long, peak double"


def rocks(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB, as processors ask."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order."""
    return pd.concat(list(frames)).sort_values(by, kind="stable", na_position="first")


class _Baselines(StatefulProcessor):
    """Of each service: the warm-up's values until there is a baseline, the baseline, and a position with counters."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.warmup = handle.getListState("warmup", "value double")
        self.baseline = handle.getValueState("baseline", "value double")
        self.position = handle.getValueState("position", "tick long, frames long, updates long, refused long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, frames, updates, refused = self.position.get() if self.position.exists() else (None, 0, 0, 0)
        base = self.baseline.get()[0] if self.baseline.exists() else None
        seen = [] if base is not None or not self.warmup.exists() else [v for (v,) in self.warmup.get()]
        had, out, until = len(seen), [], last
        for r in _ordered(rows, ["tick", "observed"]).itertuples():
            if last is not None and r.tick <= last:
                refused += 1
                continue
            before = base
            frame, base = self.rules.step(seen, base, r.observed, r.lift)
            updates += base != before
            frames += frame[-1] == "ok"
            until = r.tick
            out.append((key[0], r.tick, r.observed, *frame))
        if base is None:
            for value in seen[had:]:
                self.warmup.appendValue((value,))
        else:
            self.baseline.update((base,))
            if self.warmup.exists():
                self.warmup.clear()
        if until is not None:
            self.position.update((int(until), frames, updates, refused))
        if out:
            done = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield done.assign(frames=frames, updates=updates, refused=refused)

    def close(self) -> None:
        pass


def decomposed(rates: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Frames of a stream (service, tick, observed[, lift]), as ``decompose`` gives them of the whole, with counters of the service so far.

    A service's ticks must come in order across micro-batches: a row at or before its last tick (a redelivery, say) is refused and counted.
    Rows of one tick in one micro-batch are taken by value.  ``frames``, ``updates`` and ``refused`` hold at the end of the micro-batch.
    Rows without service, tick or observed are left out; a missing lift is none.
    """
    lift = F.coalesce(F.col("lift").cast("double"), F.lit(0.0)) if "lift" in rates.columns else F.lit(0.0)
    rows = rates.select(F.col("service").cast("string").alias("service"), F.col("tick").cast("long").alias("tick"), F.col("observed").cast("double").alias("observed"), lift.alias("lift"))
    rows = rows.where("service IS NOT NULL AND tick IS NOT NULL AND observed IS NOT NULL")
    return rows.groupBy("service").transformWithStateInPandas(_Baselines(rules), SCHEMA + ", frames long, updates long, refused long", "Append", "None")


class _Episodes(StatefulProcessor):
    """Of each stream: the run of equal classes that its last tick belongs to, and the episode, open or not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "class string, length long, first long, peak double, tick long")
        self.episode = handle.getValueState("episode", "open boolean, number long, opened long, breaches long, revision long, peak double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, length, first, top, last = self.run.get() if self.run.exists() else (None, 0, None, None, None)
        is_open, number, opened, breaches, revision, peak = self.episode.get() if self.episode.exists() else (False, 0, None, 0, 0, None)
        out, until = [], last
        higher = lambda a, b: b if a is None else a if b is None else max(a, b)
        for r in _ordered(rows, ["tick"]).itertuples():
            if last is not None and r.tick <= last:
                continue
            until, score = r.tick, None if r.score is None or math.isnan(r.score) else r.score
            if r.kind != kind:
                kind, length, first, top = r.kind, 0, r.tick, None
            length, top, was = length + 1, higher(top, score), is_open
            if kind == "B" and length >= r.open_after:
                is_open = True
            elif kind == "C" and length >= r.close_after:
                is_open = False
            if kind == "B":
                action = ("SUSTAINED" if was else "OPENED") if is_open else "PENDING"
                phase = "ACTIVE" if is_open else "PENDING"
            elif kind == "C" and was:
                action = phase = "CLEARING" if is_open else "CLOSED"
            else:
                action, phase = "HELD", "ACTIVE" if is_open else "IDLE"
            if action == "OPENED":
                number, opened, breaches, revision, peak = number + 1, first, r.open_after, 1, top
            elif action == "SUSTAINED":
                breaches, revision, peak = breaches + 1, revision + 1, higher(peak, score)
            elif action == "CLOSED":
                revision += 1
            episode = (number, opened, breaches, revision, peak) if number and (is_open or action == "CLOSED") else (None,) * 5
            out.append((key[0], r.tick, score, kind, action, phase, *episode))
        if out:
            self.run.update((kind, int(length), int(first), top, int(until)))
            self.episode.update((bool(is_open), int(number), None if opened is None else int(opened), int(breaches), int(revision), peak))
            done = pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])
            yield done.astype({c: "Int64" for c in ("number", "opened", "breaches", "revision")} | {c: "Float64" for c in ("score", "peak")})

    def close(self) -> None:
        pass


def episodes(scored: DataFrame, policies: DataFrame) -> DataFrame:
    """Transitions of a stream (stream, kind, tick, score, sufficient), as ``lifecycle.transitions`` gives them of the whole.

    ``policies`` is (kind, breach, clear, open_after, close_after, gap), a table of a row for each kind, joined to every micro-batch.
    A stream's ticks must come in order across micro-batches; a tick at or before its last one is a redelivery and changes nothing.
    """
    rows = scored.join(policies, "kind").where("(sufficient OR gap = 'hold') AND stream IS NOT NULL AND tick IS NOT NULL")
    kind = F.when(~F.col("sufficient"), "H").when(F.col("score") >= F.col("breach"), "B").when(F.col("score").isNull() | (F.col("score") <= F.col("clear")), "C").otherwise("H")
    rows = rows.select("stream", F.col("tick").cast("long").alias("tick"), F.col("score").cast("double").alias("score"), kind.alias("kind"), F.col("open_after").cast("long").alias("open_after"), F.col("close_after").cast("long").alias("close_after"))
    return rows.groupBy("stream").transformWithStateInPandas(_Episodes(), TRANSITIONS, "Append", "None")


class _Panes(StatefulProcessor):
    """Of each edge: the values of its calls, with counts, and the failed ones, by step of time."""

    def __init__(self, width_us: int, step_us: int, share: float):
        self.step, self.panes_of, self.share = step_us, width_us // step_us, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane long", "vals array<double>, counts array<long>, failed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        due = set()
        for pane, some in frame.groupby(-(-frame["us"] // self.step)):
            pane = int(pane)
            values, counts, failed = self.panes.getValue((pane,)) if self.panes.containsKey((pane,)) else ([], [], 0)
            held = Counter(dict(zip(values, counts)))
            held.update(some["value"].tolist())
            kept = sorted(held)
            self.panes.updateValue((pane,), (kept, [int(held[v]) for v in kept], int(failed) + int(some["failed"].sum())))
            due |= set(range(pane, pane + self.panes_of))
        for tick in due:
            self.handle.registerTimer(tick * self.step // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick = (expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 // self.step
        held: Counter = Counter()
        failed = 0
        for pane in range(tick - self.panes_of + 1, tick + 1):
            if self.panes.containsKey((pane,)):
                values, counts, bad = self.panes.getValue((pane,))
                held.update(dict(zip(values, map(int, counts))))
                failed += int(bad)
        first = tick - self.panes_of + 1
        if self.panes.containsKey((first,)):  # no later window holds it
            self.panes.removeKey((first,))
        calls = sum(held.values())
        if calls:
            rank, below = max(1, math.ceil(self.share * calls - 1e-9)), 0
            for value in sorted(held):
                below += held[value]
                if below >= rank:
                    break
            yield pd.DataFrame([(*key, tick * self.step, calls, value, round(failed / calls, 6))], columns=["caller", "service", "tick_us", "calls", "p95", "error_rate"])

    def close(self) -> None:
        pass


def sliding_edges(calls: DataFrame, width_us: int, step_us: int, late: str, share: float = 0.95) -> DataFrame:
    """(caller, service, tick_us, calls, p95, error_rate) of windows (tick - width, tick] of a stream (caller, service, us, value, failed), once each, when the watermark passes them.

    A call is kept once, in the pane of its step, as a count of its value; a window merges its panes, so the nearest rank is exact and
    memory is the distinct values of an edge in one width.  The watermark is Spark's, ``late`` behind the newest call of all edges; calls at or behind
    it are dropped.  ``step_us`` must be whole milliseconds and divide ``width_us``.  Calls without caller, service, us or value are left out.
    """
    if step_us % 1000 or width_us % step_us:
        raise ValueError("the step must be whole milliseconds and divide the width")
    rows = calls.select(F.col("caller").cast("string").alias("caller"), F.col("service").cast("string").alias("service"), F.col("us").cast("long").alias("us"), F.col("value").cast("double").alias("value"), F.coalesce(F.col("failed"), F.lit(False)).cast("long").alias("failed"))
    rows = rows.where("caller IS NOT NULL AND service IS NOT NULL AND us IS NOT NULL AND value IS NOT NULL").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    return rows.groupBy("caller", "service").transformWithStateInPandas(_Panes(width_us, step_us, share), "caller string, service string, tick_us long, calls long, p95 double, error_rate double", "Append", "EventTime")
