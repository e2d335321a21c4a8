"""A run against its plan, against an earlier run, and against what its own history lets expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def completeness(rows: DataFrame, plan: DataFrame, key: list[str]) -> DataFrame:
    """(key, actual, expected, completeness): rows of each key over what ``plan`` (key, rate per second, start, end; microseconds) asks.

    A planned key without rows has 0; completeness is null where nothing is planned.
    """
    asked = plan.groupBy(*key).agg(F.sum(F.col("rate") * (F.col("end") - F.col("start")) / 1e6).alias("expected"))
    got = asked.join(rows.groupBy(*key).agg(F.count("*").alias("actual")), key, "full")
    counts = got.withColumns({"actual": F.coalesce("actual", F.lit(0)), "expected": F.coalesce("expected", F.lit(0.0))})
    return counts.select(*key, "actual", "expected", F.when(F.col("expected") > 0, F.col("actual") / F.col("expected")).alias("completeness"))


def transcript(rows: DataFrame, anchor: Column, at: str, step: int, fields: list[str]) -> DataFrame:
    """(step, fields): rows with their time as whole steps since the anchor, free of the clock of the run."""
    return rows.select(F.floor((F.col(at) - anchor) / step).alias("step"), *fields)


def transcript_diff(run: DataFrame, golden: DataFrame) -> DataFrame:
    """(side, columns, n): rows "added" to, or "missing" from, a run of equal columns, with how many; no row where both agree.

    One aggregation of both, so each side is read once and equal rows meet already before the shuffle.
    """
    both = run.withColumn("n", F.lit(1)).unionByName(golden.select(run.columns).withColumn("n", F.lit(-1)))
    net = both.groupBy(*run.columns).agg(F.sum("n").alias("n")).where("n <> 0")
    return net.select(F.when(F.col("n") > 0, "added").otherwise("missing").alias("side"), *run.columns, F.abs("n").alias("n"))


def envelopes(rows: DataFrame, signal: str, strata: Sequence[str], value: str, least: int = 20, least_signal: int = 200, shares: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(signal, strata, n, level, q10, q50, q90, blind_q90, event_part) of each cell of the strata.

    ``strata`` go from coarse to fine, the last one is the context.  A cell with fewer than ``least`` values takes the quantiles
    of the next coarser one, down to the signal itself; ``level`` is how many strata they were taken over.  The blind twin is the
    same without the context; what the upper quantile gains over it, if anything, is the event's part.  Signals with fewer than
    ``least_signal`` values have no envelope.  Null values don't count.  A cell's buffer holds its distinct values.
    """
    strata = list(strata)
    counts = rows.where(F.col(value).isNotNull()).groupBy(signal, *strata, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    quantiles = F.percentile("v", [float(s) for s in shares], F.col("c"))
    rolled = counts.rollup(signal, *strata).agg(F.sum("c").alias("n"), quantiles.alias("q"), (len(strata) - sum(F.grouping(s).cast("int") for s in strata)).alias("level"), F.grouping(signal).alias("all_"))
    rolled = rolled.where("all_ = 0").drop("all_")
    cells = rolled.where(F.col("level") == len(strata)).select(signal, *strata, "n", F.when(F.col("n") >= least, F.struct("q", "level")).alias(f"at{len(strata)}"))
    for level in range(len(strata) - 1, -1, -1):
        key = [signal, *strata[:level]]
        enough = F.col("n") >= (least if level else least_signal)
        coarser = rolled.where((F.col("level") == level) & enough).select(*(F.col(k).alias(f"{k}_") for k in key), F.struct("q", "level").alias(f"at{level}"))
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key]
        cells = cells.join(coarser, same, "left" if level else "inner").drop(*(f"{k}_" for k in key))
    found = F.coalesce(*(f"at{i}" for i in range(len(strata), -1, -1)))
    blind = F.coalesce(*(f"at{i}" for i in range(len(strata) - 1, -1, -1)))
    cells = cells.select(signal, *strata, "n", found.alias("a"), blind.alias("b"))
    named = [F.col("a.q")[i].alias(f"q{round(100 * s)}") for i, s in enumerate(shares)]
    top, top_blind = F.col("a.q")[len(shares) - 1], F.col("b.q")[len(shares) - 1]
    return cells.select(signal, *strata, "n", F.col("a.level").alias("level"), *named, top_blind.alias(f"blind_q{round(100 * shares[-1])}"), F.greatest(F.lit(0.0), top - top_blind).alias("event_part"))
