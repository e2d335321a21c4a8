"""Ticks of a stream that close for all keys at once, by one watermark, from one anchor; empty ones too.

The position of the stream (epoch, anchor, closed ticks, newest time) and its open ticks are small tables, a folder for each
micro-batch: micro-batch N reads those of N - 1 and replaces its own, so one that is run again after a failure gives the same.
Only the position, one row, comes to the driver.  Sums and empty ticks are joins and aggregations over (key, tick).

* **Mark.** The newest time moves in steps of at most ``gap_us``: from the mark so far to the next tick with rows, and on.  Rows beyond
  a wider step are *held*: they close no tick, so one wrong timestamp cannot close more than the gap, and they are counted in when time reaches them.
* **Re-anchoring.** When every row of a micro-batch lies beyond the gap, the stream has moved on, after downtime, say.  The ticks up to
  the old mark close, and a new epoch begins at the first row beyond: the time between gets no empty ticks, which would say that all
  keys were silent.
* **Late rows** belong to a tick that is closed; they are counted and dropped.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

OPEN = "key string, tick_us long, n long, total double, newest long"
CLOSED = "epoch long, key string, tick_us long, n long, total double"
KEYS = "epoch long, key string, first_us long"


@dataclass(frozen=True)
class Position:
    """Where a stream is: ticks of ``epoch`` begin at ``anchor`` and every ``width``; those before ``closed`` are closed.  Counts are totals."""

    epoch: int
    anchor: int
    closed: int
    mark: int
    late: int = 0
    held: int = 0
    reanchored: int = 0


POSITION = "epoch long, anchor long, closed long, mark long, late long, held long, reanchored long"


def _folder(path: str, what: str, number: int) -> str:
    return f"{path}/{what}/batch={number}"


def _reached(rows: DataFrame, mark: int | None, gap_us: int) -> tuple[int | None, int | None]:
    """The newest time that steps of at most ``gap_us`` from ``mark`` lead to, and the first time beyond; ``rows`` has tick_us and newest, its last time."""
    ticks = rows.groupBy("tick_us").agg(F.max("newest").alias("newest"), F.min("oldest").alias("oldest"))
    sofar = Window.orderBy("tick_us").rowsBetween(Window.unboundedPreceding, -1)  # a row for each tick of the micro-batch
    before = F.max("newest").over(sofar)
    before = F.greatest(before, F.lit(mark).cast("long")) if mark is not None else before
    wide = ticks.withColumn("before", before).where(F.col("oldest") - F.col("before") > gap_us).agg(F.min("oldest")).first()[0]
    top = (ticks if wide is None else ticks.where(F.col("oldest") < wide)).agg(F.max("newest")).first()[0]
    return top if mark is None else mark if top is None else max(mark, top), wide


def advance(batch: DataFrame, path: str, number: int, width_us: int, lateness_us: int, gap_us: int) -> Position | None:
    """Write ticks, keys, open ticks and position of micro-batch ``number`` of (key, us, value); None while there are no rows yet."""
    spark = batch.sparkSession
    last = spark.read.schema(POSITION).parquet(_folder(path, "position", number - 1)).first() if number else None
    pos = None if last is None else Position(**last.asDict())
    old = lambda what, schema: spark.read.schema(schema).parquet(_folder(path, what, number - 1)) if number else spark.createDataFrame([], schema)
    rows = batch.select(F.col("key").cast("string").alias("key"), F.col("us").cast("long").alias("us"), F.col("value").cast("double").alias("value")).where("key IS NOT NULL AND us IS NOT NULL")
    fine = rows.groupBy("key", (F.floor(F.col("us") / width_us) * width_us).alias("tick_us")).agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"), F.max("us").alias("newest"), F.min("us").alias("oldest"))
    fine.write.mode("overwrite").parquet(_folder(path, "arrived", number))
    fine = spark.read.schema(fine.schema).parquet(_folder(path, "arrived", number))
    held = old("held", OPEN + ", oldest long")
    first_new = fine.agg(F.min("oldest")).first()[0]
    closing: list[tuple[int, int, int]] = []  # (epoch, from, to) of ticks that close
    if first_new is not None or pos is None:
        if pos is None and first_new is not None:
            start = first_new // width_us * width_us
            pos = Position(0, start, start, first_new)
        elif pos is not None and first_new > pos.mark + gap_us:
            end = max(pos.closed, pos.mark // width_us * width_us + width_us)
            closing.append((pos.epoch, pos.closed, end))
            start = min(x for x in (first_new, held.agg(F.min("oldest")).first()[0]) if x is not None) // width_us * width_us
            pos = Position(pos.epoch + 1, start, start, start, pos.late, 0, pos.reanchored + 1)
    pool = fine.unionByName(held)
    waiting = old("open", "epoch long, " + OPEN)
    if pos is None:
        _write(spark, path, number, spark.createDataFrame([], CLOSED), old("keys", KEYS), waiting, pool, None)
        return None
    mark, wide = _reached(pool, pos.mark, gap_us)
    taken, beyond = (pool, pool.limit(0)) if wide is None else (pool.where(F.col("oldest") < wide), pool.where(F.col("oldest") >= wide))
    late = taken.where(F.col("tick_us") < pos.closed).agg(F.sum("n")).first()[0] or 0
    on_time = taken.where(F.col("tick_us") >= pos.closed).select(F.lit(pos.epoch).cast("long").alias("epoch"), "key", "tick_us", "n", "total", "newest")
    end = max(pos.closed, (mark - lateness_us) // width_us * width_us)
    closing.append((pos.epoch, pos.closed, end))
    ticks = waiting.unionByName(on_time).groupBy("epoch", "key", "tick_us").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("newest").alias("newest"))
    firsts = old("keys", KEYS).unionByName(on_time.select("epoch", "key", F.col("tick_us").alias("first_us"))).groupBy("epoch", "key").agg(F.min("first_us").alias("first_us"))
    due = spark.createDataFrame(closing, "epoch long, since long, until long").where("until > since")
    spine = firsts.join(F.broadcast(due), "epoch").where("first_us < until")  # at most two rows: the epochs that close ticks now
    spine = spine.select("epoch", "key", F.explode(F.sequence(F.greatest("since", "first_us"), F.col("until") - width_us, F.lit(width_us))).alias("tick_us"))
    done = spine.join(ticks, ["epoch", "key", "tick_us"], "left").select("epoch", "key", "tick_us", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))
    still = ticks.where((F.col("epoch") == pos.epoch) & (F.col("tick_us") >= end)).select("epoch", "key", "tick_us", "n", "total", "newest")
    keys = firsts.where(F.col("epoch") == pos.epoch)
    after = Position(pos.epoch, pos.anchor, end, mark, pos.late + late, beyond.agg(F.sum("n")).first()[0] or 0, pos.reanchored)
    _write(spark, path, number, done, keys, still, beyond, after)
    return after


def _write(spark: SparkSession, path: str, number: int, done: DataFrame, keys: DataFrame, still: DataFrame, held: DataFrame, pos: Position | None) -> None:
    for what, df in (("ticks", done), ("keys", keys), ("open", still), ("held", held.select("key", "tick_us", "n", "total", "newest", "oldest"))):
        df.write.mode("overwrite").parquet(_folder(path, what, number))
    spark.createDataFrame([asdict(pos)] if pos else [], POSITION).write.mode("overwrite").parquet(_folder(path, "position", number))


def anchored_ticks(stream: DataFrame, path: str, checkpoint: str, width_us: int, lateness_us: int, gap_us: int = 120_000_000) -> StreamingQuery:
    """Write the closed ticks of a stream (key, us, value) below ``path``/ticks until the input is used up: epoch, key, tick_us (its begin), n, total.

    A tick closes for all keys when the newest time, less ``lateness_us``, has passed its end.  A key has ticks from the first that it is
    seen in, in each epoch; those without rows have n = 0.  For rows that come in order up to the lateness the result does not depend on
    how they are cut into micro-batches.  Positions are below ``path``/position.  Rows without key or us are left out; a null value
    counts as a row.  ``path`` belongs to ``checkpoint``: a new checkpoint needs a new path.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: advance(batch, path, number, width_us, lateness_us, gap_us) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_ticks(spark: SparkSession, path: str) -> DataFrame:
    """All ticks that ``anchored_ticks`` has closed."""
    return spark.read.schema(CLOSED).parquet(f"{path}/ticks/batch=*")


def position(spark: SparkSession, path: str) -> Position | None:
    """The position after the last micro-batch."""
    rows = spark.read.schema(POSITION + ", batch long").parquet(f"{path}/position").orderBy(F.desc("batch")).limit(1).drop("batch").collect()
    return Position(**rows[0].asDict()) if rows else None
