"""Grades of detections by kind, windows of referenced labels, and bounded pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .selection import nearest_rank


def kind_scores(outcomes: DataFrame) -> DataFrame:
    """(kind, hits, false_alarms, missed, precision, recall, p50, p95) of outcomes (kind, symptom, label, latency).

    A row with symptom and label is a hit, with a symptom only a false alarm, with a label only missed.  A share of nothing is
    null; latencies are by nearest rank over the hits that have one.
    """
    hit = F.col("symptom").isNotNull() & F.col("label").isNotNull()
    rows = outcomes.withColumn("latency", F.when(hit, F.col("latency")))
    got = rows.groupBy("kind").agg(F.count(F.when(hit, 1)).alias("hits"), F.count("symptom").alias("symptoms"), F.count("label").alias("labels"), nearest_rank("latency", 0.5).alias("p50"), nearest_rank("latency", 0.95).alias("p95"))
    share = lambda of: F.when(F.col(of) > 0, F.col("hits") / F.greatest(F.col(of), F.lit(1)))
    return got.select("kind", "hits", (F.col("symptoms") - F.col("hits")).alias("false_alarms"), (F.col("labels") - F.col("hits")).alias("missed"), share("symptoms").alias("precision"), share("labels").alias("recall"), "p50", "p95")


def reference_windows(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, start, end, missing): the span of the labels (label, start, end) that each of (id, refs) names, and the refs that name none.

    Decisions without any label found keep a row with a null span; a decision without refs has none missing.
    """
    each = decisions.select("id", F.explode_outer(F.array_distinct("refs")).alias("label"))
    found = each.join(labels.select("label", "start", "end", F.lit(True).alias("known")), "label", "left")
    missing = F.array_sort(F.collect_set(F.when(F.col("label").isNotNull() & F.col("known").isNull(), F.col("label"))))
    return found.groupBy("id").agg(F.min("start").alias("start"), F.max("end").alias("end"), missing.alias("missing"))


def page(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """The first ``size`` rows in a total order, with ``truncated``: whether there were more.  Spark keeps one row more than a page of each task."""
    first = rows.orderBy(*order).limit(size + 1)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # over one page
    counted = first.withColumns({"_number": number, "truncated": F.count("*").over(Window.partitionBy(F.lit(0))) > size})
    return counted.where(F.col("_number") <= size).drop("_number")


def range_page(rows: DataFrame, at: str, start: int, end: int, order: list[Column], size: int, longest: int, most: int = 10_000) -> DataFrame:
    """A ``page`` of the rows with ``at`` in start..end; a span above ``longest`` or a page above ``most`` is refused, not cut."""
    if not 0 <= end - start <= longest or not 0 < size <= most:
        raise ValueError("span or page out of bounds")
    return page(rows.where(F.col(at).between(start, end)), order, size)


def separation(scored: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, auc, positive_mean, negative_mean, gap) of (key, score, positive): how well scores tell two classes apart.

    auc is the share of pairs in which the positive scores higher, ties counting half; auc and gap are null where a class is empty.
    Rows without score or class don't count.  Rows meet as counts of each score, and only these are put in order.
    """
    hit = F.col("positive").cast("boolean")
    counts = scored.where("score IS NOT NULL AND positive IS NOT NULL").groupBy(*key, F.col("score").cast("double").alias("score")).agg(F.count_if(hit).alias("p"), F.count_if(~hit).alias("m"))
    below = F.sum("m").over(Window.partitionBy(*key).orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    won = counts.withColumn("won", F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("m") / 2))
    got = won.groupBy(*key).agg(F.sum("p").alias("p"), F.sum("m").alias("m"), F.sum("won").alias("won"), F.sum(F.col("p") * F.col("score")).alias("ps"), F.sum(F.col("m") * F.col("score")).alias("ms"))
    means = got.withColumns({"positive_mean": F.try_divide("ps", "p"), "negative_mean": F.try_divide("ms", "m")})
    return means.select(*key, (F.col("p") + F.col("m")).alias("n"), F.try_divide(F.col("won"), F.col("p") * F.col("m")).alias("auc"), "positive_mean", "negative_mean", (F.col("positive_mean") - F.col("negative_mean")).alias("gap"))


def headline(outcomes: DataFrame, required: list[str]) -> DataFrame:
    """One row (recall_status, least_recall, latency_status, p95, matched) over the ``required`` kinds of outcomes as ``kind_scores`` takes them.

    The least recall counts only if every required kind has labels; p95 is by nearest rank over all hits.  Else the status is INSUFFICIENT.
    """
    some = outcomes.where(F.col("kind").isin(*required))
    by_kind = kind_scores(some).agg(F.count("recall").alias("kinds"), F.min("recall").alias("least"))
    hits = some.where("symptom IS NOT NULL AND label IS NOT NULL").agg(F.count("latency").alias("matched"), nearest_rank("latency", 0.95).alias("p95"))
    both = by_kind.join(hits)  # one row each
    whole = F.col("kinds") == len(required)
    return both.select(F.when(whole, "OK").otherwise("INSUFFICIENT").alias("recall_status"), F.when(whole, F.col("least")).alias("least_recall"), F.when(F.col("matched") > 0, "OK").otherwise("INSUFFICIENT").alias("latency_status"), "p95", "matched")


def run_bounds(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, anchor, first, end, problem) of each of ``runs`` (run, duration) by its spans (run, at, marker).

    The anchor is the last marker, first the first other span, end the anchor and the duration.  problem: "no spans", "no marker",
    or "anchor after first span"; then the run has no end.
    """
    edges = spans.groupBy("run").agg(F.max(F.when(F.col("marker"), F.col("at"))).alias("anchor"), F.min(F.when(~F.col("marker"), F.col("at"))).alias("first"))
    problem = F.when(F.col("first").isNull(), "no spans").when(F.col("anchor").isNull(), "no marker").when(F.col("anchor") > F.col("first"), "anchor after first span")
    rows = runs.join(edges, "run", "left").withColumn("problem", problem)
    return rows.select("run", "anchor", "first", F.when(F.col("problem").isNull(), F.col("anchor") + F.col("duration")).alias("end"), "problem")


def characterised(episodes: DataFrame, bounds: DataFrame, times: list[str]) -> DataFrame:
    """``episodes`` (run, ..) of runs that have bounds, with the columns ``times`` as offsets from the run's anchor."""
    rows = episodes.join(bounds.where("problem IS NULL").select("run", F.col("anchor").alias("anchor_")), "run")
    return rows.withColumns({t: F.col(t) - F.col("anchor_") for t in times}).drop("anchor_")


def counts_by_kind(episodes: DataFrame, bounds: DataFrame, kinds: list[str]) -> DataFrame:
    """(run, kind, n) for each run that has bounds and each of ``kinds``, none too."""
    spine = bounds.where("problem IS NULL").select("run", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return spine.join(episodes.groupBy("run", "kind").agg(F.count("*").alias("n")), ["run", "kind"], "left").select("run", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def adjacent(episodes: DataFrame, hops: DataFrame, within: int) -> DataFrame:
    """(earlier, later, apart): pairs of episodes (id, service, opened) that opened at most ``within`` apart on one service or on two that are ``hops`` (a, b) apart.

    Ties are in the order of ids.  An episode is copied to its service and that service's neighbours, and meets others in its own
    bucket of time and the next one, so the join is an equi-join on (service, bucket).
    """
    near = hops.select(F.col("a").alias("service"), F.col("b").alias("other")).unionByName(hops.select(F.col("b").alias("service"), F.col("a").alias("other"))).where("service <> other").distinct()
    first = episodes.select(F.col("id").alias("earlier"), "service", F.col("opened").alias("opened_"))
    first = first.unionByName(first.join(near, "service").select("earlier", F.col("other").alias("service"), "opened_"))
    bucket = F.floor(F.col("opened_") / within)
    first = first.withColumn("bucket_", F.explode(F.array(bucket, bucket + 1)))
    later = episodes.select(F.col("id").alias("later"), "service", "opened", F.floor(F.col("opened") / within).alias("bucket_"))
    met = first.join(later, ["service", "bucket_"]).withColumn("apart", F.col("opened") - F.col("opened_"))
    return met.where((F.col("apart") <= within) & ((F.col("apart") > 0) | ((F.col("apart") == 0) & (F.col("earlier") < F.col("later"))))).select("earlier", "later", "apart")
