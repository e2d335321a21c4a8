"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put in a random but fixed order and cut into blocks.  A source
with weight w releases its block j at slot floor(j / w) and must have it out by slot
ceil((j + 1) / w); taking, at each slot, the released block with the earliest deadline keeps
every source within one block of its target share at every slot while it has blocks left.

Weights are whole shares of a frame of slots, so the schedule repeats with every frame.  The
earliest-deadline-first choice is made once, for one frame: a table with as many rows as the
frame has slots, whatever the corpus.  All the rest is a join and window functions of Spark.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

FRAME = 1000  # slots of a frame, and the unit of weights
BLOCK_DOCS = 20
BUCKETS = 3  # hex digits of the order key that split a source, for ranks without one task for a whole source


def frame_slots(shares: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one frame: earliest deadline first, ties by source name."""
    total = sum(shares.values())
    coming = sorted((j * total // w, -(-(j + 1) * total // w), s, j) for s, w in shares.items() if w for j in range(w))
    ready: list[tuple[int, str, int, int]] = []
    out, at = [], 0
    for slot in range(total):
        while at < len(coming) and coming[at][0] <= slot:
            release, deadline, s, j = coming[at]
            heapq.heappush(ready, (deadline, s, j, release))
            at += 1
        deadline, s, j, release = heapq.heappop(ready)
        out.append((s, j, release, deadline, slot))
    return out


def shares_by_size(counts: dict[str, int], power: float = 0.5, frame: int = FRAME) -> dict[str, int]:
    """Shares in proportion to a power of each source's size, at least 1, that sum to ``frame`` (or to the number of sources)."""
    if not counts:
        return {}
    frame = max(frame, len(counts))
    raw = {s: n**power for s, n in sorted(counts.items())}
    whole = sum(raw.values())
    out = {s: max(1, int(frame * r / whole)) for s, r in raw.items()}
    order = sorted(raw, key=lambda s: (-(frame * raw[s] / whole - out[s]), s))
    gap = frame - sum(out.values())
    for i in range(max(0, gap)):
        out[order[i % len(order)]] += 1
    largest = [(-w, s) for s, w in out.items()]
    heapq.heapify(largest)
    for _ in range(max(0, -gap)):
        w, s = heapq.heappop(largest)
        out[s] -= 1
        heapq.heappush(largest, (w + 1, s))
    return out


def source_key(source: str | None) -> str:
    """How a source is named inside: the null source is none of the others."""
    return "null" if source is None else "=" + source


def mix(docs: DataFrame, shares: dict[str | None, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with mix_source, mix_block, mix_slot and mix_seq, the place of each row in the mixture.

    ``docs`` needs doc_id, source and text; all its columns are kept whatever their names, save older ones of these
    four.  ``shares`` are whole weights by source (None is the null source, a source of its own); without them
    the square roots of the sizes are taken.  Every row is kept once: when a source has no blocks left its slots stay
    empty and mix_seq skips them.  A source without a share comes after all others.  Rows equal in
    doc_id and text are placed in any order among themselves; an empty table gives no rows.

    The schedule of a frame, which the driver makes, has at least one slot for each source: there may be many
    documents but not millions of sources.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_seq")
    source = F.col("source").cast("string")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))
    docs = docs.select(F.struct("*").alias("row"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("name"), key.alias("key"))
    docs = docs.withColumn("bucket", F.substring("key", 1, BUCKETS))
    sizes = docs.groupBy("name", "bucket").agg(F.count("*").alias("n"))
    # a row for each source and bucket: what stands before the bucket in its source
    before = F.sum("n").over(Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    if shares is None:
        weights = shares_by_size({r[0]: r[1] for r in sizes.groupBy("name").agg(F.sum("n")).collect()})  # a row for each source
    else:
        weights = {source_key(s): w for s, w in shares.items()}
    known = {s: w for s, w in weights.items() if w > 0} or {"null": 1}
    inside = Window.partitionBy("name", "bucket").orderBy("key", "row.doc_id", F.when(F.col("row.doc_id").isNull(), F.col("row.text")))
    placed = docs.withColumn("place", F.row_number().over(inside) - 1).join(starts, ["name", "bucket"])
    rank = F.col("before") + F.col("place")
    placed = placed.select("row", "name", F.pmod(rank, F.lit(block_docs)).alias("at"), F.floor(rank / block_docs).cast("long").alias("block"))
    slots = spark.createDataFrame([(s, j, slot, known[s]) for s, j, _, _, slot in frame_slots(known)], "name string, nth long, slot long, weight long")
    # small tables of known size: Spark sees it and broadcasts them while they are
    placed = placed.join(slots.select("name", "weight").distinct(), "name", "left").withColumn("nth", F.pmod("block", F.coalesce("weight", F.lit(1))))
    placed = placed.join(slots.drop("weight"), ["name", "nth"], "left")
    slot = F.when(F.col("slot").isNull(), F.lit(1 << 52) + F.col("block")).otherwise(F.floor(F.col("block") / F.col("weight")) * sum(known.values()) + F.col("slot")).cast("long")
    seq = (slot * block_docs + F.col("at")).alias("mix_seq")
    return placed.select("row.*", F.when(F.col("name") != "null", F.substring("name", 2, 1 << 30)).alias("mix_source"), F.col("block").alias("mix_block"), slot.alias("mix_slot"), seq)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` placed in a mixture that takes each source by the square root of its size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", F.col("mix_source").alias("source"), "mix_block", "mix_slot", "mix_seq")


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
