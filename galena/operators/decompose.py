"""Baseline, event-explained part and residual of a rate, tick by tick.

The baseline is a gated exponential average: whether a tick moves it depends on the baseline
itself, which no window function can say.  Each series is therefore folded in time order: Spark
sorts it, spilling if need be, and it passes one task in batches, with only the warm-up's values
and the baseline carried on.  A series has one row for each tick, not for each event.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.sized import small

SCHEMA = "service string, tick long, observed double, base double, event double, low double, high double, residual double, score double, status string"


@dataclass(frozen=True)
class Rules:
    """How a baseline is found and moved: the median of ``warmup`` values without a lift, then an average of weight ``alpha`` (0 freezes it)."""

    warmup: int = 30
    alpha: float = 0.15
    gate: float = 0.25
    floor: float = 1.5
    tolerance: float = 0.1

    def step(self, seen: list[float], base: float | None, observed: float, lift: float) -> tuple[tuple, float | None]:
        """(base, event, low, high, residual, score, status) of one value and the baseline after it; ``seen``, the warm-up's values, is added to."""
        if base is None:
            if not lift:
                seen.append(observed)
            if len(seen) >= self.warmup:
                base = float(median(seen))
            return (None, None, None, None, None, None, "warming"), base
        event = base * lift
        expected = base + event
        band = max(self.floor, self.tolerance * expected)
        residual = observed - expected
        beyond = max(0.0, abs(residual) - band)
        frame = (base, event, expected - band, expected + band, residual, min(1.0, beyond / band), "ok")
        if not lift and abs(residual) <= max(self.floor, self.gate * base):
            base += self.alpha * (observed - base)
        return frame, base


def decompose(rates: DataFrame, lifts: DataFrame | None = None, warmup: int = 30, alpha: float = 0.15, gate: float = 0.25, floor: float = 1.5, tolerance: float = 0.1) -> DataFrame:
    """Frames of ``rates`` (service, tick, observed); ``lifts`` (tick, lift) adds base * lift.

    Ticks before the warm-up is over have the status 'warming' and no values.  Rows without a service are left out; rows of one tick are taken by value.
    """
    rows = rates.join(small(lifts), "tick", "left") if lifts is not None else rates.withColumn("lift", F.lit(0.0))
    rows = rows.select("service", "tick", F.col("observed").cast("double").alias("observed"), F.coalesce("lift", F.lit(0.0)).alias("lift"))

    rules = Rules(warmup, alpha, gate, floor, tolerance)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seen, base = None, [], None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.service != current:
                    current, seen, base = r.service, [], None
                frame, base = rules.step(seen, base, r.observed, r.lift)
                out.append((r.service, r.tick, r.observed, *frame))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.where("service IS NOT NULL").repartition("service").sortWithinPartitions("service", "tick", "observed").mapInPandas(fold, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour event counts by type, decomposed."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rates = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("service"), F.floor(us / 21600000000).cast("long").alias("tick")).agg(F.count("*").alias("observed"))
    return decompose(rates)
