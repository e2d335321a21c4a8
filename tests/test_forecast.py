"""Seasonal forecasts against numpy over each series by itself."""

import numpy as np
import pytest

from galena.operators import forecast

DAY = forecast.DAY_US
FRAMES = "series string, us long, value double, lift double"


def by_numpy(us, values, least=2, level_days=7):
    step, n = int(us[1] - us[0]), len(us)
    day, week = DAY // step, 7 * DAY // step
    daily, weekly = day >= 2 and n > least * day, week >= 2 and n > least * week
    if not daily and not weekly:
        return "MEAN", values.mean(), {}, {}
    m = week if weekly else day
    kernel = np.ones(m) / m if m % 2 else np.r_[0.5, np.ones(m - 1), 0.5] / m
    trend = np.convolve(values, kernel, "valid")
    at = us[len(kernel) // 2 : len(kernel) // 2 + len(trend)]
    over = values[len(kernel) // 2 : len(kernel) // 2 + len(trend)] - trend
    days, weeks = {}, {}

    def profile(keys, left):
        got = {k: left[keys == k].mean() for k in set(keys.tolist())}
        mid = np.mean(list(got.values()))
        return {k: v - mid for k, v in got.items()}

    if daily:
        days = profile(at % DAY // step, over)
        over = over - np.array([days[k] for k in (at % DAY // step).tolist()])
    if weekly:
        weeks = profile((at // DAY + 3) % 7, over)
    name = {(True, True): "DAILY_WEEKLY", (True, False): "DAILY", (False, True): "WEEKLY"}[daily, weekly]
    return name, np.median(trend[-max(1, level_days * DAY // step) :]), days, weeks


@pytest.mark.parametrize("block", [1, 60, 4096])
def test_fit_and_forecast_by_numpy(spark, block):
    rng = np.random.default_rng(block)
    rows, asked, want = [], [], {}
    for name, hours, n, start in (("both", 6, 300, 3), ("odd", 8, 130, 1), ("daily", 4, 60, 5), ("weekly", 24, 40, 2), ("short", 6, 8, 9), ("two", 24, 2, 0), ("one", 6, 1, 0), ("gap", 6, 90, 4)):
        step = hours * DAY // 24
        us = start * DAY + step * np.arange(n)
        free = 50 + 0.1 * np.arange(n) + 5 * np.sin(2 * np.pi * us / DAY) + 3 * (us // DAY % 7 == 2) + rng.normal(0, 1, n)
        lift = np.where(rng.random(n) < 0.2, 0.5, 0.0)
        for i in range(n):
            if name == "gap" and i == 40:
                continue
            seen = [free[i]] if i % 5 else [free[i] - 1, free[i] + 1]
            rows += [(name, int(us[i]), float(v * (1 + lift[i])), float(lift[i]) if lift[i] else None) for v in seen]
        if name not in ("gap", "one"):
            want[name] = by_numpy(us, free)
        asked += [(name, int(us[-1] + k * step), 0.0, [None, 0.5, -1.0][k % 3]) for k in range(1, 30)]
    frames = spark.createDataFrame(rows, FRAMES).repartition(3)
    model = forecast.fit(frames, block=block)
    levels = {r.series: r for r in model[0].collect()}
    assert {s: r.method for s, r in levels.items()} == {s: w[0] for s, w in want.items()}
    daily, weekly = model[1].collect(), model[2].collect()
    for s, (_, level, days, weeks) in want.items():
        assert levels[s].level == pytest.approx(level)
        assert {r.bucket: r.daily for r in daily if r.series == s} == pytest.approx(days)
        assert {r.weekday: r.weekly for r in weekly if r.series == s} == pytest.approx(weeks)
    got = {(r.series, r.us): r.forecast for r in forecast.predict(spark.createDataFrame([(s, u, lift) for s, u, _, lift in asked], "series string, us long, lift double"), model, 55.0).collect()}
    told = {}
    for s, u, _, lift in asked:
        if s in want:
            _, level, days, weeks = want[s]
            base = level + days.get(u % DAY // levels[s].step, 0.0) + weeks.get((u // DAY + 3) % 7, 0.0)
            told[s, u] = max(55.0, base * (1 + max(lift or 0.0, 0.0)))
    assert got == pytest.approx(told) and min(got.values()) == 55.0


def test_refused_and_empty(spark):
    bad = spark.createDataFrame([("a", 1, 1.0, -0.5)], FRAMES)
    with pytest.raises(Exception, match="negative"):
        forecast.grid(bad).collect()
    levels, daily, weekly = forecast.fit(bad.limit(0))
    assert levels.count() == daily.count() == weekly.count() == 0
