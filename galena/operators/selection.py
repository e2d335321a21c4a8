"""Measures and choices over groups: entropy, coherence, templates, sliding edges, before and after, best of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def entropy(rows: DataFrame, key: list[str], of: str, least: int) -> DataFrame:
    """Shannon entropy in bits of the values of ``of`` in each group; NULL below ``least`` rows."""
    counts = rows.groupBy(*key, of).agg(F.count("*").alias("c"))
    # of counts c with sum n: log2(n) - sum(c log2 c) / n; one pass and no second join
    got = counts.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("s"))
    bits = F.greatest(F.lit(0.0), F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n"))
    return got.select(*key, "n", F.when(F.col("n") >= least, F.round(bits, 6)).alias("entropy"), F.when(F.col("n") >= least, "ok").otherwise("insufficient").alias("status"))


def coherence(rows: DataFrame, key: list[str], x: str, y: str, least: int) -> DataFrame:
    """Pearson correlation of two columns, clipped to 0..1; NULL where one does not vary or there are fewer than ``least`` rows."""
    got = rows.groupBy(*key).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("r"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return got.select(*key, "n", F.when((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("r"), F.sqrt(F.col("vx") * F.col("vy"))))), 6)).alias("coherence"))


def best_of(rows: DataFrame, key: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in a total order, with their rank; Spark keeps only k rows of a group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def nearest_rank(value: str, share: float) -> Column:
    """The smallest value with at least ``share`` of the group at or below it."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def sliding_edges(calls: DataFrame, width_us: int, step_us: int) -> DataFrame:
    """(caller, service, tick_us, calls, p95, error_rate) of windows (tick - width, tick] at every step; ``calls`` has us, value and failed.

    A call is copied to the width/step windows that hold it, so memory and shuffle do not depend on how calls bunch.
    """
    first = F.ceil(F.col("us") / step_us)
    ticks = F.sequence(first, F.ceil((F.col("us") + width_us) / step_us) - 1)
    rows = calls.withColumn("tick_us", F.explode(ticks)).withColumn("tick_us", F.col("tick_us") * step_us)
    return rows.groupBy("caller", "service", "tick_us").agg(F.count("*").alias("calls"), nearest_rank("value", 0.95).alias("p95"), F.round(F.avg(F.col("failed").cast("double")), 6).alias("error_rate"))


def template(line: Column) -> Column:
    """A line with its numbers, and words that hold any, masked."""
    # most lines hold no number; a run without numbers is not gone through again from each of its characters
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\s0-9]*+[0-9]\S*", "<*>")).otherwise(line)


def template_frequency(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, template, n, rate, first_ref): how often each template comes in a group of (line, ref), and its share; blank lines don't count."""
    rows = lines.withColumn("template", template(F.trim("line"))).where("template <> ''")
    got = rows.groupBy(*key, "template").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref"))
    total = got.groupBy(*key).agg(F.sum("n").alias("total"))
    return got.join(total, key).select(*key, "template", "n", F.round(F.col("n") / F.col("total"), 9).alias("rate"), "first_ref")


def merged_templates(templates: DataFrame, key: list[str], similarity: float = 0.4) -> DataFrame:
    """(key, template, leader): templates of one group, length and first word follow the most frequent one (then the first by name) that agrees in enough words.

    ``templates`` is (key, template, n).  Leaders are compared within a block only; a template without a better one leads itself.
    """
    rows = templates.withColumn("words", F.split("template", r"\s+")).withColumns({"length": F.size("words"), "head": F.col("words")[0]})
    block = [*key, "length", "head"]
    other = rows.select(*block, F.col("template").alias("leader"), F.col("n").alias("leader_n"), F.col("words").alias("leader_words"))
    same = F.aggregate(F.zip_with("words", "leader_words", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    better = (F.col("leader_n") > F.col("n")) | ((F.col("leader_n") == F.col("n")) & (F.col("leader") <= F.col("template")))
    pairs = rows.join(other, block).where(better & (same >= F.col("length") * similarity))
    return pairs.groupBy(*key, "template").agg(F.min(F.struct(-F.col("leader_n"), "leader")).alias("l")).select(*key, "template", F.col("l.leader").alias("leader"))


def restored(windows: DataFrame, actions: DataFrame) -> DataFrame:
    """(action_id, services, delta): the worst availability gained over the services that an action names, clipped to -1..1.

    ``windows`` is (service, tick, availability), ``actions`` (action_id, service, tick); before is the tick before, after the tick after.
    A service counts only if both were measured; an action without any has delta NULL.
    """
    side = lambda name, by: windows.select("service", (F.col("tick") + by).alias("tick"), F.col("availability").alias(name))
    both = actions.join(side("before", 1), ["service", "tick"], "left").join(side("after", -1), ["service", "tick"], "left")
    gain = F.col("after") - F.col("before")
    return both.groupBy("action_id").agg(F.count(gain).alias("services"), F.when(F.count(gain) > 0, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min(gain))), 6)).alias("delta"))


def cited(members: DataFrame, citations: DataFrame, kinds: list[str]) -> DataFrame:
    """Member episodes (incident_id, episode_id, kind, ts) of the given kinds that the incident's axis cites, numbered by time; citations are (incident_id, refs)."""
    named = citations.select("incident_id", F.explode("refs").alias("episode_id"))
    some = members.where(F.col("kind").isin(kinds)).join(named, ["incident_id", "episode_id"], "left_semi")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("incident_id").orderBy("ts", "episode_id")))
