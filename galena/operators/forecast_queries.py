"""Forecasts of the rates of event types by segment for the week after the last event; SQL that averages every window by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import forecast
from .queries import EVENTS, TICK, _events


def _frames(spark, sf_dir):
    """Six-hour counts with a lift of one half at each seventh tick; ticks without events of a type aren't there, and its series then isn't regular."""
    e = _events(spark, sf_dir).groupBy(F.col("event_type").alias("series"), "tick").agg(F.count("*").cast("double").alias("value"))
    return e.select("series", (F.col("tick") * TICK).alias("us"), "value", F.when(F.col("tick") % 7 == 0, 0.5).otherwise(0.0).alias("lift"))


def forecast_fit(spark, sf_dir):
    levels, _, _ = forecast.fit(_frames(spark, sf_dir))
    return levels.select("series", "method", "n", F.round("level", 6).alias("level"))


def forecast_cycles(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    ahead = frames.groupBy("series").agg(F.max("us").alias("last")).select("series", F.explode(F.sequence(F.lit(1), F.lit(28))).alias("k"), "last")
    asked = ahead.select("series", (F.col("last") + F.col("k") * TICK).alias("us")).withColumn("lift", F.when(F.floor(F.col("us") / TICK) % 7 == 0, 0.5).otherwise(0.0))
    return forecast.predict(asked, forecast.fit(frames), 1.0).select("series", "us", F.round("forecast", 6).alias("forecast"))


#: Four ticks a day, 28 a week; a trend weighs the ends of its 28 ticks by half.
FIT = f"""WITH v AS MATERIALIZED (SELECT event_type AS series, tick, count(*) / CASE WHEN tick % 7 = 0 THEN 1.5 ELSE 1.0 END AS v FROM {EVENTS} GROUP BY event_type, tick),
s AS MATERIALIZED (SELECT series, count(*) AS n, max(tick) AS last, avg(v) AS mean, count(*) > 8 AS days, count(*) > 56 AS weeks FROM v GROUP BY series HAVING count(*) > 1 AND max(tick) - min(tick) + 1 = count(*)),
t AS MATERIALIZED (SELECT a.series, a.tick, any_value(a.v) AS v, sum(b.v * CASE WHEN abs(a.tick - b.tick) = h.h THEN 0.5 ELSE 1 END) / (2 * any_value(h.h)) AS trend
      FROM v a JOIN s USING (series) JOIN (SELECT series, CASE WHEN weeks THEN 14 ELSE 2 END AS h FROM s WHERE days) h USING (series) JOIN v b ON b.series = a.series AND abs(a.tick - b.tick) <= h.h
      GROUP BY a.series, a.tick HAVING count(*) = 2 * any_value(h.h) + 1),
d AS MATERIALIZED (SELECT series, bucket, m - avg(m) OVER (PARTITION BY series) AS daily FROM (SELECT series, tick % 4 AS bucket, avg(v - trend) AS m FROM t GROUP BY series, tick % 4)),
w AS MATERIALIZED (SELECT series, weekday, m - avg(m) OVER (PARTITION BY series) AS weekly FROM (SELECT t.series, (tick // 4 + 3) % 7 AS weekday, avg(v - trend - daily) AS m FROM t JOIN d ON d.series = t.series AND d.bucket = t.tick % 4 JOIN s ON s.series = t.series AND s.weeks GROUP BY t.series, (tick // 4 + 3) % 7)),
l AS MATERIALIZED (SELECT s.series, n, last, CASE WHEN weeks THEN 'DAILY_WEEKLY' WHEN days THEN 'DAILY' ELSE 'MEAN' END AS method, coalesce((SELECT median(trend) FROM t WHERE t.series = s.series AND t.tick > (SELECT max(tick) FROM t x WHERE x.series = s.series) - 28), mean) AS level FROM s)"""
ORACLES = {
    "forecast_fit": FIT + " SELECT series, method, n, round(level, 6) AS level FROM l",
    "forecast_cycles": FIT + f""", a AS (SELECT series, level, unnest(range(last + 1, last + 29)) AS tick FROM l)
SELECT a.series, a.tick * {TICK} AS us, round(greatest(1.0, (level + coalesce(daily, 0) + coalesce(weekly, 0)) * CASE WHEN a.tick % 7 = 0 THEN 1.5 ELSE 1 END), 6) AS forecast
FROM a LEFT JOIN d ON d.series = a.series AND d.bucket = a.tick % 4 LEFT JOIN w ON w.series = a.series AND w.weekday = (a.tick // 4 + 3) % 7""",
}
QUERIES = {name: (globals()[name], sql) for name, sql in ORACLES.items()}
