"""Seasonal forecasts of grouped series by trend and clock profiles, as windows and aggregations.

A value is freed of its event lift and averaged per time.  On a regular grid, a day and a week are cycles if the series
has more than ``least_cycles`` of them.  The trend is the centred moving average over the longest cycle; what is left over it, averaged
by time of day, is the daily profile, and what is left over both, by weekday, the weekly one.  The level is the median of the trend's
tail.  A series without cycles is forecast by its mean; one that is not on a regular grid is not forecast.

Moving averages are taken in blocks of the series with as many rows of the neighbours as half a cycle, so a long series is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_US = 86_400_000_000
NAMES = {(False, False): "MEAN", (True, False): "DAILY", (False, True): "WEEKLY", (True, True): "DAILY_WEEKLY"}


def grid(frames: DataFrame) -> DataFrame:
    """(series, us, value) freed of lift and averaged per time, of ``frames`` (series, us, value, lift); a negative lift is an error."""
    lift = F.coalesce("lift", F.lit(0.0))
    free = F.when(lift < 0, F.raise_error(F.lit("a lift is negative")).cast("double")).otherwise(F.col("value") / (1 + lift))
    return frames.where("series IS NOT NULL AND us IS NOT NULL AND value IS NOT NULL").groupBy("series", "us").agg(F.avg(free).alias("value"))


def shapes(rows: DataFrame, least_cycles: int = 2) -> DataFrame:
    """(series, n, first, step, regular, daily, weekly, mean) of each series of ``grid``; daily and weekly are ticks of a usable cycle or null.

    n distinct times that are multiples of span / (n - 1) after the first are a regular grid; no series is sorted for that.
    """
    facts = rows.groupBy("series").agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"), F.avg("value").alias("mean"))
    facts = facts.withColumn("step", F.expr("CASE WHEN n > 1 AND (last - first) % (n - 1) = 0 THEN (last - first) DIV (n - 1) END"))
    on_grid = rows.join(facts, "series").groupBy("series").agg(F.bool_and(F.coalesce((F.col("us") - F.col("first")) % F.col("step") == 0, F.lit(False))).alias("regular"))
    cycle = lambda days: F.expr(f"CASE WHEN regular AND {days * DAY_US} DIV step >= 2 AND n > {least_cycles} * ({days * DAY_US} DIV step) THEN {days * DAY_US} DIV step END")
    return facts.join(on_grid, "series").select("series", "n", "first", "step", "regular", cycle(1).alias("daily"), cycle(7).alias("weekly"), "mean")


def trend(rows: DataFrame, shape: DataFrame, block: int = 4096) -> DataFrame:
    """(series, us, value, trend) of series with a cycle; the trend is null where half a cycle is missing on a side."""
    period = F.greatest(F.coalesce("daily", F.lit(0)), F.coalesce("weekly", F.lit(0)))
    at = rows.join(shape.where("daily IS NOT NULL OR weekly IS NOT NULL").select("series", "n", "first", "step", period.alias("m")), "series")
    at = at.withColumns({"i": F.expr("(us - first) DIV step"), "half": F.expr("m DIV 2")}).withColumn("size", F.greatest("m", F.lit(block)))
    near = F.array_distinct(F.array(*(F.floor((F.col("i") + d) / F.col("size")) for d in (-F.col("half"), F.lit(0), F.col("half")))))
    at = at.withColumn("own", F.floor(F.col("i") / F.col("size"))).withColumn("block", F.explode(near))
    # of an even cycle the two ends count by half: the mean of two windows that are one row apart.  Sums to a place give both
    order = Window.partitionBy("series", "block").orderBy("i")
    at = at.withColumn("sum", F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    upto = at.select("series", "block", F.col("i").alias("j"), F.col("sum").alias("upto"))
    whole = at.where("block = own AND i >= half AND i + half < n")
    reach = F.when(F.col("m") % 2 == 0, F.array(-F.col("half") - 1, -F.col("half"), F.col("half") - 1, F.col("half"))).otherwise(F.array(-F.col("half") - 1, F.col("half")))
    sign = F.when(F.col("m") % 2 == 0, F.array(*map(F.lit, (-0.5, -0.5, 0.5, 0.5)))).otherwise(F.array(F.lit(-1.0), F.lit(1.0)))
    ends = whole.select("series", "block", "us", "m", F.explode(F.arrays_zip(reach.alias("d"), sign.alias("w"))).alias("e"), "i").select("series", "block", "us", "m", (F.col("i") + F.col("e.d")).alias("j"), F.col("e.w").alias("w"))
    mean = ends.join(upto, ["series", "block", "j"], "left").groupBy("series", "us").agg((F.sum(F.col("w") * F.coalesce("upto", F.lit(0.0))) / F.first("m")).alias("trend"))
    return rows.join(shape.where("daily IS NOT NULL OR weekly IS NOT NULL").select("series"), "series", "left_semi").join(mean, ["series", "us"], "left")


def _bucket(step: Column) -> Column:
    return F.floor(F.pmod("us", F.lit(DAY_US)) / step)


def _weekday() -> Column:
    return F.pmod(F.floor(F.col("us") / DAY_US) + 3, F.lit(7))  # Monday is 0


def fit(frames: DataFrame, least_cycles: int = 2, level_days: int = 7, block: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(levels, daily, weekly): (series, method, step, n, level), (series, bucket, daily) and (series, weekday, weekly) of the series of ``frames``."""
    rows = grid(frames)
    shape = shapes(rows, least_cycles)
    parts = trend(rows, shape, block)
    known = parts.where("trend IS NOT NULL").join(shape.select("series", "n", "first", "step", "daily", "weekly"), "series").withColumn("over", F.col("value") - F.col("trend"))
    centred = lambda df, c: df.join(df.groupBy("series").agg(F.avg(c).alias("mid")), "series").withColumn(c, F.col(c) - F.col("mid")).drop("mid")
    daily = centred(known.where("daily IS NOT NULL").groupBy("series", _bucket(F.col("step")).alias("bucket")).agg(F.avg("over").alias("daily")), "daily")
    rest = known.withColumn("bucket", _bucket(F.col("step"))).where("weekly IS NOT NULL").drop("daily").join(daily, ["series", "bucket"], "left")
    weekly = centred(rest.groupBy("series", _weekday().alias("weekday")).agg(F.avg(F.col("over") - F.coalesce("daily", F.lit(0.0))).alias("weekly")), "weekly")
    # the tail is counted from the last trend there is, half a cycle before the series' end
    end = known.groupBy("series").agg(F.max("us").alias("end"))
    tail = known.join(end, "series").where(F.col("us") > F.col("end") - F.greatest(F.lit(1), F.expr(f"{level_days * DAY_US} DIV step")) * F.col("step"))
    level = tail.groupBy("series").agg(F.median("trend").alias("level"))
    name = F.coalesce(*(F.when(F.col("daily").isNotNull().eqNullSafe(F.lit(d)) & F.col("weekly").isNotNull().eqNullSafe(F.lit(w)), n) for (d, w), n in NAMES.items()))
    levels = shape.where("regular").join(level, "series", "left").select("series", name.alias("method"), "step", "n", F.coalesce("level", "mean").alias("level"))
    return levels, daily, weekly


def predict(asked: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], floor: float = 0.0) -> DataFrame:
    """``asked`` (series, us, lift) with the forecast, lift put back in, at least ``floor``; series without a model are left out."""
    levels, daily, weekly = model
    rows = asked.join(levels.select("series", "step", "level"), "series").withColumns({"bucket": _bucket(F.col("step")), "weekday": _weekday()})
    rows = rows.join(daily, ["series", "bucket"], "left").join(weekly, ["series", "weekday"], "left")
    base = F.col("level") + F.coalesce("daily", F.lit(0.0)) + F.coalesce("weekly", F.lit(0.0))
    return rows.withColumn("forecast", F.greatest(F.lit(floor), base * (1 + F.greatest(F.coalesce("lift", F.lit(0.0)), F.lit(0.0))))).select(*asked.columns, "forecast")
