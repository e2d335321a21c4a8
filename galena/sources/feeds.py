"""Feeds of contexts, changes and episodes as they come in, made uniform; what a feed gets wrong is told or refused, never guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def fixture_windows(fixtures: DataFrame, statuses: Sequence[str], lead: int, duration: int) -> DataFrame:
    """(context_id, valid_from, valid_to) of the fixtures (fixture_id, status, kickoff) in one of ``statuses``: from ``lead`` before kickoff to ``duration`` after it."""
    return fixtures.where(F.col("status").isin(*statuses)).select(F.concat(F.lit("fixture-"), F.col("fixture_id").cast("string")).alias("context_id"), (F.col("kickoff") - lead).alias("valid_from"), (F.col("kickoff") + duration).alias("valid_to"))


def calendar_windows(entries: DataFrame, as_of: Column) -> DataFrame:
    """(context_id, valid_from, valid_to) of the enabled entries (entry_id, enabled, valid_from, valid_to) in force at ``as_of``."""
    now = entries.where(F.col("enabled") & (F.col("valid_from") <= as_of) & (as_of < F.col("valid_to")))
    return now.select(F.concat(F.lit("calendar-"), F.col("entry_id").cast("string")).alias("context_id"), "valid_from", "valid_to")


def _content(columns: Sequence[str]) -> Column:
    """Rows equal in these columns have equal content; nulls are equal to nulls only."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def changes(feed: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of a feed (change_id, kind, name, ts, revision): the service comes from ``mapping`` (kind, name, service).

    Accepted is (change_id, kind, service, ts, revision), once for each id.  Refused is (change_id, reason): "unmapped" where no
    service is configured for the name, "conflict" where records of one id differ; these are refused as a whole.
    """
    named = feed.join(mapping, ["kind", "name"], "left")
    fields = ["kind", "name", "ts", "revision"]
    # bounded state for each id: the least and the greatest content tell whether there are two
    found = named.withColumn("c_", _content(fields)).groupBy("change_id").agg(F.min("c_").alias("lo"), F.max("c_").alias("hi"), F.count_if(F.col("service").isNull()).alias("unmapped"), F.min(F.struct("kind", "service", "ts", "revision")).alias("r"))
    reason = F.when(F.col("lo") != F.col("hi"), "conflict").when(F.col("unmapped") > 0, "unmapped")
    told = found.withColumn("reason", reason)
    return told.where("reason IS NULL").select("change_id", "r.*"), told.where("reason IS NOT NULL").select("change_id", "reason")


def absolute(relative: DataFrame, anchors: DataFrame, on: Sequence[str]) -> DataFrame:
    """(.., start, end, problem) of intervals (on, id, offset, length) after the anchor (on, anchor, duration) of their run.

    problem is null, "no anchor", or "out of bounds" where an interval starts before the anchor or ends after the run.
    """
    rows = relative.join(anchors, list(on), "left")
    out = (F.col("offset") < 0) | (F.col("offset") + F.col("length") > F.col("duration"))
    start = F.col("anchor") + F.col("offset")
    problem = F.when(F.col("anchor").isNull(), "no anchor").when(out, "out of bounds")
    return rows.select(*relative.columns, start.alias("start"), (start + F.col("length")).alias("end"), problem.alias("problem"))


def latest_revisions(episodes: DataFrame, identity: Sequence[str]) -> DataFrame:
    """(.., problem): the newest revision of each episode (episode_id, revision, ..), once.

    problem is "identity" where revisions of an id differ in ``identity``, "payload" where one revision of it comes with different
    contents, else null.  Only aggregates of fixed size, so that an id with many revisions needs no more memory.
    """
    columns = [c for c in episodes.columns if c != "episode_id"]
    content, who = _content(columns), _content(list(identity))
    by_revision = episodes.withColumns({"content_": content, "who_": who}).groupBy("episode_id", "revision").agg(
        (F.min("content_") != F.max("content_")).alias("twice"), F.min("who_").alias("lo"), F.max("who_").alias("hi"), F.min(F.struct("content_", F.struct(*columns).alias("row"))).alias("one"),
    )
    newest = by_revision.groupBy("episode_id").agg(F.max("twice").alias("twice"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("one", "revision").alias("one"))
    problem = F.when(F.col("lo") != F.col("hi"), "identity").when(F.col("twice"), "payload")
    return newest.select("episode_id", "one.row.*", problem.alias("problem")).select(*episodes.columns, "problem")
