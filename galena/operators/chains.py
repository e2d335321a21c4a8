"""Hash chains: every entry's hash covers its content, its sequence number and the hash before it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

GENESIS = "0" * 64


def build_chains(entries: DataFrame) -> DataFrame:
    """(chain, seq, content, previous_hash, entry_hash) of (chain, seq, content), seq from 0 without gaps.

    A chain is sequential: chains are dealt to tasks, sorted there, and read as a stream, so that a task holds one batch however long a chain is.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, before = None, GENESIS
        for rows in batches:
            previous, hashes = [], []
            for c, seq, content in rows.itertuples(index=False):
                if c != chain:
                    chain, before = c, GENESIS
                previous.append(before)
                before = hashlib.sha256(f"{before}|{seq}|{content}".encode()).hexdigest()
                hashes.append(before)
            yield rows.assign(previous_hash=previous, entry_hash=hashes)

    rows = entries.select("chain", "seq", "content")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition("chain").sortWithinPartitions("chain", "seq").mapInPandas(of, f"{kinds}, previous_hash string, entry_hash string")


def verify_chains(entries: DataFrame) -> DataFrame:
    """(chain, entries, first_break): the first seq whose number, link or hash is wrong, or null; what stands is hashed again, all entries side by side."""
    order = Window.partitionBy("chain").orderBy("seq")
    again = F.sha2(F.concat_ws("|", "previous_hash", F.col("seq").cast("string"), "content"), 256)
    broken = (F.col("seq") != F.row_number().over(order) - 1) | (F.col("previous_hash") != F.lag("entry_hash", 1, GENESIS).over(order)) | (F.col("entry_hash") != again)
    return entries.withColumn("broken", broken).groupBy("chain").agg(F.count("*").alias("entries"), F.min(F.when(F.col("broken"), F.col("seq"))).alias("first_break"))
