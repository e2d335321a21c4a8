"""Incident memory: exact nearest neighbours of signatures above a similarity floor, and the nudge that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def signature_knn(signatures: DataFrame, memory: DataFrame, dimensions: int, k: int = 3, floor: float = 0.9) -> DataFrame:
    """(id, rank, neighbour, similarity): the k most similar remembered signatures of each, itself left out, ties by id.

    Both tables are (id, vector) with ``dimensions`` components in 0..1; similarity is 1 - distance / sqrt(dimensions), and
    those below ``floor`` are no matches.  The floor is a radius: signatures are dealt to cells of its width in their first two
    components and meet those of the neighbouring cells, nine copies whatever the dimensions; the exact distance decides.
    """
    most = float(dimensions) ** 0.5
    radius = max((1 - floor) * most, 1e-9)
    cell = lambda v: [F.floor(v[i] / radius).cast("long") for i in range(min(2, dimensions))]
    v = F.col("vector")
    near = signatures
    for i, at in enumerate(cell(v)):
        near = near.withColumn(f"c{i}", F.explode(F.sequence(at - 1, at + 1)))
    known = memory.select(F.col("id").alias("neighbour"), v.alias("other"), *(at.alias(f"c{i}") for i, at in enumerate(cell(v))))
    pairs = near.join(known, [f"c{i}" for i in range(min(2, dimensions))]).where("id <> neighbour")
    square = F.aggregate(F.zip_with("vector", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.withColumn("similarity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.sqrt(square) / most))).where(F.col("similarity") >= floor)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "neighbour", "similarity")


def nudged(verdicts: DataFrame, matches: DataFrame, nudge: float = 0.05, floor: float = 0.9) -> DataFrame:
    """``verdicts`` (id, confidence) with their confidence raised by at most ``nudge``, by how far the best match is past the floor; untouched without one."""
    best = matches.groupBy("id").agg(F.max("similarity").alias("best"))
    strength = F.lit(1.0) if floor >= 1 else F.least(F.lit(1.0), (F.col("best") - floor) / (1 - floor))
    return verdicts.join(best, "id", "left").select("id", F.when(F.col("best").isNull(), F.col("confidence")).otherwise(F.least(F.lit(1.0), F.col("confidence") + nudge * strength)).alias("confidence"), "best")
