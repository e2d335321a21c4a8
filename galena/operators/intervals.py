"""Joins on intervals as equi-joins: an interval is dealt to the buckets of time that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _bucket(at: Column, width: int) -> Column:
    return F.floor(at / width)


def point_in_interval(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Rows of ``points`` with those of ``intervals`` where start <= at < end, and equal columns ``on``.

    ``width`` is about the length of an interval: each is copied to the buckets of that width that it touches, so
    the join is one equi-join whatever the number of intervals, and AQE splits hot buckets.  Empty intervals match nothing.
    """
    copied = intervals.where(F.col(end) > F.col(start)).withColumn("bucket_", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end) - 1, width))))
    asked = points.withColumn("bucket_", _bucket(F.col(at), width))
    same = [asked[c] == copied[c] for c in ["bucket_", *(on or [])]]
    joined = asked.join(copied, [*same, asked[at] >= copied[start], asked[at] < copied[end]], how)
    for c in ["bucket_", *(on or [])]:
        joined = joined.drop(copied[c])
    return joined.drop("bucket_")


def overlapping(left: DataFrame, right: DataFrame, width: int, on: list[str]) -> DataFrame:
    """Pairs of (l_id, l_start, l_end) and (r_id, r_start, r_end) that overlap (half-open) and are equal in ``on``; each pair once for each value of ``on``."""
    a, b = (x.where(F.col(f"{s}_end") > F.col(f"{s}_start")).withColumn("bucket_", F.explode(F.sequence(_bucket(F.col(f"{s}_start"), width), _bucket(F.col(f"{s}_end") - 1, width)))) for x, s in ((left, "l"), (right, "r")))
    met = a.join(b, ["bucket_", *on]).where("l_start < r_end AND r_start < l_end")
    # a pair meets in every bucket that both touch; it is kept in the first
    return met.where(F.col("bucket_") == F.greatest(_bucket(F.col("l_start"), width), _bucket(F.col("r_start"), width))).drop("bucket_")


def meetings(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """(l_id, r_id) of ``left`` (l_id, l_start, l_end, services) and ``right`` (r_id, r_start, r_end, services) that overlap (half-open) with a service in common, each pair once.

    Ids are unique.  A pair is kept in the first bucket that both touch, for the first service in common, so pairs are not shuffled to tell them apart.
    """
    a = dealt(left.select("l_id", "l_start", "l_end", F.array_compact(F.array_distinct("services")).alias("ls_")), "l_start", "l_end", width).select("*", F.posexplode("ls_").alias("nth_", "service"))
    b = dealt(right.select("r_id", "r_start", "r_end", F.array_compact(F.array_distinct("services")).alias("rs_")), "r_start", "r_end", width).select("*", F.explode("rs_").alias("service"))
    met = a.join(b, ["bucket_", "service"]).where("l_start < r_end AND r_start < l_end")
    met = met.where(F.col("bucket_") == F.greatest(_bucket(F.col("l_start"), width), _bucket(F.col("r_start"), width)))
    earlier = F.when(F.col("nth_") > 0, F.size(F.array_intersect(F.slice("ls_", 1, F.col("nth_")), "rs_")) > 0).otherwise(False)
    return met.where(~earlier).select("l_id", "r_id")


def overlapped(left: DataFrame, right: DataFrame, width: int, on: list[str], salts: int = 8) -> DataFrame:
    """(l_id) of ``left`` (l_id, l_start, l_end) that some row of ``right`` (r_start, r_end) with equal ``on`` overlaps (half-open), each once.

    Both are dealt to the buckets of time that they touch.  Left rows of a bucket are spread over ``salts`` tasks, to each of which the bucket's
    right rows go, reduced to the longest of those with one begin.  Of several rows with one l_id one is enough.  Empty intervals overlap nothing.
    """
    touched = lambda s: F.explode(F.sequence(_bucket(F.col(f"{s}_start"), width), _bucket(F.col(f"{s}_end") - 1, width)))
    a = left.where("l_end > l_start").withColumn("bucket_", touched("l")).withColumn("salt_", F.pmod(F.xxhash64("l_id"), F.lit(salts)).cast("int"))
    b = right.where("r_end > r_start").withColumn("bucket_", touched("r")).groupBy("bucket_", *on, F.greatest(F.col("r_start"), F.col("bucket_") * width).alias("r_start")).agg(F.max("r_end").alias("r_end"))
    b = b.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = [a[c] == b[c] for c in ["bucket_", "salt_", *on]]
    return a.join(b, [*same, a["l_start"] < b["r_end"], b["r_start"] < a["l_end"]], "left_semi").select("l_id").distinct()


def without_overlap(left: DataFrame, right: DataFrame, width: int, on: list[str], salts: int = 8) -> DataFrame:
    """Rows of ``left`` whose l_id is not ``overlapped``: absence is proved over all buckets that they touch."""
    return left.join(overlapped(left, right, width, on, salts), "l_id", "left_anti")


def snapshots(versions: DataFrame, times: DataFrame, width: int) -> DataFrame:
    """(at, id, revision, ...) of every version (id, revision, effective, ...) in force at each of ``times`` (at): an id's latest known by then.

    A version holds from ``effective`` until the id's next one with a higher revision; one that is not higher than an earlier one never
    holds, of several at one time the highest does.  Versions are carried to the buckets of ``width`` up to their end or the last time, and meet the times there:
    the join makes the rows of the result and no others.
    """
    seen = Window.partitionBy("id").orderBy("effective", "revision").rowsBetween(Window.unboundedPreceding, -1)
    fresh = versions.withColumn("top_", F.max("revision").over(seen)).where("top_ IS NULL OR revision > top_").drop("top_")
    last = times.agg((F.max("at") + 1).alias("end_"))
    held = fresh.withColumn("next_", F.lead("effective").over(Window.partitionBy("id").orderBy("effective", "revision"))).join(F.broadcast(last))  # one row
    held = held.withColumn("until_", F.least(F.coalesce("next_", "end_"), "end_")).drop("next_", "end_")
    return point_in_interval(times.select("at").distinct(), held, "at", "effective", "until_", width).drop("until_")


def dealt(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """``rows`` once for each bucket of ``width`` that [start, end) touches, as ``bucket_``; empty intervals touch none."""
    return rows.where(F.col(end) > F.col(start)).withColumn("bucket_", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end) - 1, width))))


def in_force(points: DataFrame, intervals: DataFrame, at: str, width: int) -> DataFrame:
    """``points`` with the number ``n`` of ``intervals`` (start, end) with start <= at < end: a running count over the begins and ends of each bucket."""
    steps = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("step")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("step"))))
    marks = dealt(intervals.select("start", "end"), "start", "end", width).select("bucket_", steps.alias("s")).select("bucket_", "s.t", "s.step").where(F.col("t") < (F.col("bucket_") + 1) * width)
    marks = marks.groupBy("bucket_", "t").agg(F.sum("step").alias("step")).withColumn("asks", F.lit(0))
    asked = points.select(F.struct(*points.columns).alias("p_"), F.col(at).alias("t"), _bucket(F.col(at), width).alias("bucket_"), F.lit(1).alias("asks"))
    rows = asked.unionByName(marks, allowMissingColumns=True)
    n = F.coalesce(F.sum("step").over(Window.partitionBy("bucket_").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("n", n).where("asks = 1").select("p_.*", "n")


def contexts_as_of(decisions: DataFrame, contexts: DataFrame, width: int) -> DataFrame:
    """(decision_id, at, contexts): the ids of the contexts in force at each decision, by valid_from and id.

    ``decisions`` is (decision_id, at), one row for each decision, ``contexts`` the union of all sources (context_id, valid_from, valid_to).  An id that is in
    force twice at a decision is an error of the sources and stops the query.  A bucket's contexts are one sorted list that its decisions
    filter: pairs are neither shuffled nor sorted, and only the lists that are the result grow with pairs.
    """
    near = dealt(contexts.where("context_id IS NOT NULL"), "valid_from", "valid_to", width).groupBy("bucket_").agg(F.array_sort(F.collect_list(F.struct("valid_from", "context_id", "valid_to"))).alias("near_"))
    # by time, so that neighbours have nearly the same list
    asked = decisions.select("decision_id", "at").withColumn("bucket_", _bucket(F.col("at"), width)).repartition("bucket_").sortWithinPartitions("bucket_", "at")
    inside = F.filter("near_", lambda c: (c["valid_from"] <= F.col("at")) & (F.col("at") < c["valid_to"]))
    ids = F.coalesce(F.transform(inside, lambda c: c["context_id"]), F.array().cast(near.schema["near_"].dataType.simpleString()).context_id)
    # each list is made once, however often it is looked at
    one = asked.join(near, "bucket_", "left").select("decision_id", "at", F.explode(F.array(ids)).alias("c"))
    checked = F.when(F.size(F.array_distinct("c")) < F.size("c"), F.raise_error(F.concat(F.lit("a context id is in force twice at decision "), F.col("decision_id").cast("string"))).cast(one.schema["c"].dataType)).otherwise(F.col("c"))
    return one.select("decision_id", "at", checked.alias("contexts"))


def suppressed(decisions: DataFrame, windows: DataFrame, attention: dict[str, int], width: int, acting: tuple[str, ...] = ("ACT",), fallback: str = "ASK") -> DataFrame:
    """Decisions after the first window in force (by start, then id) that changes them.

    ``decisions`` is (decision_id, at, services, class, action); ``windows`` (window_id, start, end, kind, window_services, classes, most).
    A change freeze turns an acting decision on any of its services into ``fallback``.  A maintenance window caps the action at ``most``
    where it names the class and all services and the action asks for more ``attention``.  Returns the columns of decisions,
    applied and applied_kind (of the window, or null), and final.  Windows that differ only in id and times are one sort: sorts meet sorts of
    decisions in each bucket, and a decision asks each sort that changes it for the first window in force.
    """
    rank = F.create_map(*(F.lit(x) for pair in attention.items() for x in pair))
    sort, kind = ["kind", "window_services", "classes", "most"], ["services", "class", "action"]
    near = dealt(windows, "start", "end", width).select("bucket_", F.struct(*sort).alias("sort_"), F.struct("start", F.col("window_id").alias("id"), "end").alias("w_"))
    asked = decisions.select("decision_id", "at", F.struct(*kind).alias("kind_")).withColumn("bucket_", _bucket(F.col("at"), width))
    freeze = (F.col("kind") == "CHANGE_FREEZE") & F.col("action").isin(*acting)
    covers = F.size(F.array_except("services", "window_services")) == 0
    cap = (F.col("kind") != "CHANGE_FREEZE") & F.array_contains("classes", F.col("class")) & covers & F.col("most").isNotNull() & (F.element_at(rank, F.col("action")) > F.element_at(rank, F.col("most")))
    final = F.when(freeze, F.lit(fallback)).when(cap, F.col("most"))
    ours = asked.select("bucket_", "kind_").distinct().withColumn("service", F.explode("kind_.services"))
    theirs = near.select("bucket_", "sort_").distinct().withColumn("service", F.explode("sort_.window_services"))
    changes = ours.join(theirs, ["bucket_", "service"]).select("bucket_", "kind_", "sort_", "kind_.*", "sort_.*").withColumn("final", final).where("final IS NOT NULL").select("bucket_", "kind_", "sort_", "final").distinct()
    met = first_in_force(asked.join(changes, ["bucket_", "kind_"]), near, "at", ["bucket_", "sort_"])
    first = met.groupBy("decision_id").agg(F.min(F.struct("w_.start", F.col("w_.id").alias("window_id"), "final", "sort_.kind")).alias("f"))
    return decisions.join(first, "decision_id", "left").select(*decisions.columns, F.col("f.window_id").alias("applied"), F.col("f.kind").alias("applied_kind"), F.coalesce("f.final", "action").alias("final"))


def first_in_force(points: DataFrame, near: DataFrame, at: str, on: list[str]) -> DataFrame:
    """``points`` with ``w_``, of the intervals w_ (start, id, end) of ``near`` with equal ``on`` that hold at ``at`` the first by start, then id; points without one are left out.

    ``on`` has the bucket to whose buckets the intervals are dealt.  An interval is first from the greatest end before it, or its start, to its own end, if that is later:
    these spans don't overlap, so the last one to begin answers, and no point meets every interval.
    """
    rows = points.select(*on, F.col(at).alias("t"), F.lit(1).alias("asks"), F.struct(*points.columns).alias("p_")).unionByName(near.select(*on, F.col("w_.start").alias("t"), F.lit(0).alias("asks"), "w_"), allowMissingColumns=True)
    by = Window.partitionBy(*on)
    before = F.max(F.when(F.col("asks") == 0, F.col("w_.end"))).over(by.orderBy("t", "asks", "w_.id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before_", before).where("asks = 1 OR before_ IS NULL OR w_.end > before_")
    rows = rows.withColumn("t", F.when(F.col("asks") == 0, F.greatest("t", "before_")).otherwise(F.col("t")))
    last = F.last("w_", True).over(by.orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("w_", last).where(F.col("asks") == 1).where("w_.end > t").select("p_.*", "w_")


def pressed(observed: DataFrame, changes: DataFrame, reach: int, own: float = 1.0, other: float = 0.4) -> DataFrame:
    """(event_id, changes, pressure) of each of ``observed`` (event_id, us, service) after any of ``changes`` (service, us) within ``reach``, as many and as near as they are.

    A change weighs ``own`` for its own service, else ``other``, which is not more, less its age over ``reach``; the pressure is the greatest.  That is the
    weight of the service's latest change or of the latest of all, so running values over each bucket's sorted rows answer.
    """
    near = dealt(changes.select("service", "us", (F.col("us") + reach).alias("until")), "us", "until", reach)
    steps = F.explode(F.array(F.struct(F.col("us").alias("t"), F.lit(1).alias("step"), F.col("us").alias("since")), F.struct(F.col("until").alias("t"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("since"))))
    marks = near.select("bucket_", "service", steps.alias("s")).select("bucket_", "service", "s.*").where(F.col("t") < (F.col("bucket_") + 1) * reach)
    marks = marks.groupBy("bucket_", "service", "t").agg(F.sum("step").alias("step"), F.max("since").alias("since")).withColumn("asks", F.lit(0))
    asked = observed.where("event_id IS NOT NULL").select("event_id", "service", F.col("us").alias("t"), _bucket(F.col("us"), reach).alias("bucket_"), F.lit(1).alias("asks"))
    so_far = lambda *of: Window.partitionBy("bucket_", *of).orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(marks, allowMissingColumns=True)
    rows = rows.withColumn("latest", F.max("since").over(so_far("service"))).withColumns({"any": F.max("since").over(so_far()), "n": F.sum("step").over(so_far())}).where("asks = 1 AND n > 0")
    weight = lambda since, of: (1 - (F.col("t") - F.col(since)) / float(reach)) * of
    ours = F.when(F.col("service").isNotNull() & (F.col("latest") > F.col("t") - reach), weight("latest", own))
    return rows.withColumn("pressure", F.greatest(ours, weight("any", other))).groupBy("event_id").agg(F.sum("n").alias("changes"), F.max("pressure").alias("pressure"))
