"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows (at most one more is counted); else as it is, for Spark to choose."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
