"""Service graphs: hops and dependents by joins to a fixed point, and what nodes and edges carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def reach(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(source, target, hops) of all nodes that can be reached, source itself left out, by edges (source, target).

    Each round joins the pairs found last with the edges and ends when none is new: rounds are as many as the longest
    shortest path, without a cap.  Each round's pairs are checkpointed, so that plans do not grow.
    """
    edges = edges.select("source", "target").where("source <> target")
    if not directed:
        edges = edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    edges = _kept(edges.distinct())
    found = last = edges.withColumn("hops", F.lit(1))
    while True:
        step = last.select("source", F.col("target").alias("via"), "hops").join(edges.select(F.col("source").alias("via"), "target"), "via")
        new = step.where("source <> target").select("source", "target", (F.col("hops") + 1).alias("hops")).distinct()
        last = _kept(new.join(found, ["source", "target"], "left_anti"))
        if last.isEmpty():
            return found
        found = _kept(found.unionByName(last))


def _kept(df: DataFrame) -> DataFrame:
    """``df``, checkpointed in the session's shared folder where one is named."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", "") or df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set")
            import tempfile

            named = tempfile.mkdtemp(prefix="galena-checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint()


def node_heat(nodes: DataFrame, episodes: DataFrame) -> DataFrame:
    """(node, peak, active, kinds): what the episodes (node, kind, peak, active) leave on each node; quiet nodes have peak null."""
    heat = episodes.groupBy("node").agg(F.max("peak").alias("peak"), F.sum(F.col("active").cast("long")).alias("active"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return nodes.join(heat, "node", "left").select("node", "peak", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def edge_evidence(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """(source, target, evidence, peak): episodes (source, target, peak) on each edge; an edge without any has evidence 0."""
    held = episodes.groupBy("source", "target").agg(F.count("*").alias("evidence"), F.max("peak").alias("peak"))
    return edges.join(held, ["source", "target"], "left").select("source", "target", F.coalesce("evidence", F.lit(0)).alias("evidence"), "peak")
