"""Connected components of an edge table, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the
smallest node it sees, until the edges are stars.  Rounds grow with the logarithm
of the longest path, and neither edges nor labels ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import cut, release


def connected(links: DataFrame) -> DataFrame:
    """(cid, comp) of each node of ``links`` (a, b): comp is the smallest node it is connected with."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = held = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if held is not None:
            release(held)
        held = edges
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    # a root has no edge of its own
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct())
