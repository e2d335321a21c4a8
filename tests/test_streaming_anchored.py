"""One watermark over all keys: against the rule told row by row, wrong timestamps, and downtime on both sides of the limit."""

import os

import numpy as np
import pandas as pd
import pytest

from galena.streaming.anchored import Position, anchored_ticks, closed_ticks, position

SCHEMA = "key string, us long, value double"


def streamed(spark, folder, batches, first=0, **how):
    os.makedirs(folder / "in", exist_ok=True)
    for i, rows in enumerate(batches, first):
        pd.DataFrame(rows, columns=["key", "us", "value"]).astype({"key": "string", "us": "Int64", "value": "Float64"}).to_parquet(folder / "in" / f"{i:04}.parquet")
        os.utime(folder / "in" / f"{i:04}.parquet", (1_700_000_000 + i,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = anchored_ticks(stream, str(folder / "t"), str(folder / "c"), **how)
    assert query.awaitTermination(300)
    return sorted(tuple(r) for r in closed_ticks(spark, str(folder / "t")).collect()), position(spark, str(folder / "t"))


def by_rule(batches, width, lateness):
    """Rows one micro-batch after the other, without gaps."""
    anchor = closed = mark = None
    sums, firsts, late, out = {}, {}, 0, []
    for rows in batches:
        if anchor is None:
            anchor = closed = min(u for _, u, _ in rows) // width * width
            mark = anchor
        for k, u, v in rows:
            tick = u // width * width
            if tick < closed:
                late += 1
                continue
            firsts[k] = min(tick, firsts.get(k, tick))
            n, total = sums.get((k, tick), (0, 0.0))
            sums[k, tick] = n + 1, total + (v or 0.0)
        mark = max(mark, *(u for _, u, _ in rows))
        end = max(closed, (mark - lateness) // width * width)
        out += [(0, k, t, *sums.get((k, t), (0, 0.0))) for k in firsts for t in range(max(closed, firsts[k]), end, width)]
        closed = end
    return sorted(out), Position(0, anchor, closed, mark, late)


def test_ticks_by_the_rule(spark, tmp_path):
    rng = np.random.default_rng(2)
    batches = [[(str(rng.choice(list("xyz"[: 2 + (b > 3)]))), int(1000 + b * 40 + rng.integers(-60, 60)), float(rng.integers(0, 9))) for _ in range(20)] for b in range(6)]
    assert streamed(spark, tmp_path, batches, width_us=10, lateness_us=15, gap_us=10_000) == by_rule(batches, 10, 15)


def test_no_difference_by_cuts_and_restart(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 7 == 0], int(5_000 + 6 * i + rng.integers(0, 5)), 1.0) for i in range(60)]
    want = None
    for name, cuts in (("one", []), ("many", [5, 6, 30, 44]), ("two", [31])):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, None])]
        got, _ = streamed(spark, tmp_path / name, parts[:1], width_us=10, lateness_us=20, gap_us=1000)
        if len(parts) > 1:
            got, _ = streamed(spark, tmp_path / name, parts[1:], 1, width_us=10, lateness_us=20, gap_us=1000)
        want = want or got
        assert got == want and len(got) > 40


def test_a_wrong_timestamp_closes_nothing(spark, tmp_path):
    batches = [[("a", 105, 1.0), ("b", 10**15, 7.0), (None, 110, 1.0), ("a", None, 1.0)], [("a", 128, 2.0), ("a", 149, None)], [("a", 170, 1.0), ("a", 121, 4.0)]]
    got, pos = streamed(spark, tmp_path, batches, width_us=10, lateness_us=10, gap_us=50)
    assert got == [(0, "a", 100, 1, 1.0), (0, "a", 110, 0, 0.0), (0, "a", 120, 1, 2.0), (0, "a", 130, 0, 0.0), (0, "a", 140, 1, 0.0), (0, "a", 150, 0, 0.0)]
    assert pos == Position(0, 100, 160, 170, late=1, held=1)
    bound = (50 + 10) // 10
    got, pos = streamed(spark, tmp_path, [[("a", 219, 1.0)]], 3, width_us=10, lateness_us=10, gap_us=50)
    assert pos.mark == 219 and len([r for r in got if r[2] >= 160]) <= bound


@pytest.mark.parametrize("pause,epochs", [(120_000_000, 1), (120_000_001, 2)])
def test_resume_or_begin_anew(spark, tmp_path, pause, epochs):
    """Restarted after a pause: up to the limit the stream goes on with empty ticks, beyond it a new epoch begins without any between."""
    sec = 1_000_000
    how = {"width_us": 10 * sec, "lateness_us": 5 * sec}
    _, before = streamed(spark, tmp_path, [[("a", 1000 * sec, 1.0), ("b", 1003 * sec, 1.0)], [("a", 1020 * sec, 1.0)]], **how)
    assert before == Position(0, 1000 * sec, 1010 * sec, 1020 * sec)
    again = 1020 * sec + pause
    got, pos = streamed(spark, tmp_path, [[("a", again, 1.0)], [("a", again + 40 * sec, 1.0)]], 2, **how)
    silent = [r for r in got if r[3] == 0 and 1030 * sec < r[2] < again - 10 * sec]
    if epochs == 1:
        assert pos.epoch == 0 and pos.anchor == 1000 * sec and pos.reanchored == 0 and len(silent) >= 18
    else:
        assert pos.epoch == 1 and pos.anchor == again // (10 * sec) * 10 * sec and pos.reanchored == 1 and silent == []
        assert [r for r in got if r[0] == 0 and r[2] == 1020 * sec] == [(0, "a", 1020 * sec, 1, 1.0), (0, "b", 1020 * sec, 0, 0.0)]
        assert {r[1] for r in got if r[0] == 1} == {"a"} and [r[3] for r in got if r[0] == 1] == [1, 0, 0]


def test_held_rows_come_in_when_the_stream_moves_on(spark, tmp_path):
    """One micro-batch with downtime inside: what lies beyond waits, and is counted once the stream is there."""
    batches = [[("a", 100, 1.0), ("a", 1000, 1.0), ("b", 1010, 1.0)], [("a", 1030, 1.0)]]
    got, pos = streamed(spark, tmp_path, batches, width_us=10, lateness_us=10, gap_us=50)
    assert pos == Position(1, 1000, 1020, 1030, late=0, held=0, reanchored=1)
    assert got == [(0, "a", 100, 1, 1.0), (1, "a", 1000, 1, 1.0), (1, "a", 1010, 0, 0.0), (1, "b", 1010, 1, 1.0)]


def test_no_rows(spark, tmp_path):
    got, pos = streamed(spark, tmp_path, [[(None, 1, 1.0)], [("a", 5, 1.0)]], width_us=10, lateness_us=0, gap_us=50)
    assert got == [] and pos == Position(0, 0, 0, 5)
