"""Judgement of incidents: verdicts fused from the scores of several axes, and the service that an incident started in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import graph


class Rule(NamedTuple):
    """A class of verdict, the axes that must be lit, known calm, or not lit, and the kinds of symptom that refute it."""

    verdict: str
    lit: Sequence[str] = ()
    calm: Sequence[str] = ()
    absent: Sequence[str] = ()
    forbids: Sequence[str] = ()


class Subtype(NamedTuple):
    """A name for verdicts of a class whose corroborating kinds include ``requires`` and none of ``forbids``."""

    name: str
    verdict: str
    requires: Sequence[str] = ()
    forbids: Sequence[str] = ()


def _texts(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def fuse(
    assessments: DataFrame, rules: Sequence[Rule], thresholds: Mapping[str, float], subtypes: Sequence[Subtype] = (),
    unknown: float = 0.5, least: float = 0.4, fit_gain: float = 0.3, kinds_gain: float = 0.3, kinds_full: int = 3,
) -> DataFrame:
    """(id, status, verdict, subtype, confidence, kinds, shares, rejected) of each id of (id, axis, score, kinds).

    ``score`` is null on an axis that could not be measured, which is neither lit (from its threshold on) nor calm; ``kinds``
    lists the kinds of symptom that contributed.  The first rule whose demands all hold decides.  Each rule's share is the
    product of its lit scores and of one minus its calm and absent ones, ``unknown`` where not measured, 0 where refuted; even
    where all are 0.  Without any kind the status is NO_EVIDENCE, without a rule INSUFFICIENT; both leave the verdict null.
    The same axis twice for an id is an error.
    """
    kinds = F.coalesce("kinds", _texts(()))
    by = F.map_from_entries(F.collect_list(F.struct("axis", F.struct(F.col("score").cast("double").alias("score"), kinds.alias("kinds")))))
    got = assessments.groupBy("id").agg(by.alias("by")).withColumn("present", F.array_distinct(F.flatten(F.transform(F.map_values("by"), lambda a: a["kinds"]))))
    read = {a: F.try_element_at("by", F.lit(a)) for a in thresholds}
    score = {a: r["score"] for a, r in read.items()}
    lit = {a: F.coalesce(s >= thresholds[a], F.lit(False)) for a, s in score.items()}
    calm = {a: F.coalesce(s < thresholds[a], F.lit(False)) for a, s in score.items()}

    def fit(no: int, rule: Rule) -> Column:
        refuted = F.arrays_overlap("present", _texts(rule.forbids)) if rule.forbids else F.lit(False)
        unmet = F.when(refuted, "refuted")
        for axes, holds, what in ((rule.lit, lit, "not lit"), (rule.calm, calm, "not calm"), (rule.absent, {a: ~c for a, c in lit.items()}, "lit")):
            for a in axes:
                unmet = unmet.when(~holds[a], f"{a} {what}")
        support = F.lit(1.0)
        for a in (*rule.lit, *rule.calm, *rule.absent):
            x = F.coalesce(score[a], F.lit(unknown))
            support = support * (x if a in rule.lit else 1 - x)
        backing = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.coalesce(read[a]["kinds"], _texts(())) for a in rule.lit))))) if rule.lit else _texts(())
        return F.struct(F.lit(no).alias("no"), F.lit(rule.verdict).alias("verdict"), unmet.alias("unmet"), F.when(refuted, 0.0).otherwise(support).alias("support"), backing.alias("kinds"))

    got = got.withColumn("fits", F.array(*(fit(i, r) for i, r in enumerate(rules))))
    total = F.aggregate("fits", F.lit(0.0), lambda s, f: s + f["support"])
    got = got.withColumn("total", total).withColumn("won", F.when(F.size("present") > 0, F.get(F.filter("fits", lambda f: f["unmet"].isNull()), F.lit(0))))
    share = lambda f: F.when(F.col("total") > 0, f["support"] / F.col("total")).otherwise(1.0 / len(rules))
    won = F.col("won")
    subtype: Column = F.lit(None).cast("string")
    for s in reversed(subtypes):
        has = F.size(F.array_except(_texts(s.requires), won["kinds"])) == 0
        subtype = F.when((won["verdict"] == s.verdict) & has & ~F.arrays_overlap(won["kinds"], _texts(s.forbids)), s.name).otherwise(subtype)
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), least + fit_gain * share(won) + kinds_gain * F.least(F.lit(1.0), F.size(won["kinds"]) / float(kinds_full))))
    rejected = F.transform(F.filter("fits", lambda f: f["no"] != won["no"]), lambda f: F.concat(f["verdict"], F.lit(": "), F.coalesce(f["unmet"], F.lit("outranked"))))
    return got.select(
        "id", F.when(F.size("present") == 0, "NO_EVIDENCE").when(won.isNull(), "INSUFFICIENT").otherwise("DECIDED").alias("status"), won["verdict"].alias("verdict"), subtype.alias("subtype"),
        F.when(won.isNotNull(), confidence).alias("confidence"), won["kinds"].alias("kinds"),
        F.when(F.size("present") > 0, F.transform("fits", lambda f: F.struct(f["verdict"].alias("verdict"), share(f).alias("share")))).alias("shares"), F.when(won.isNotNull(), rejected).alias("rejected"),
    )


def origins(
    episodes: DataFrame, edges: DataFrame, weights: tuple[float, float, float] = (0.3, 0.35, 0.35), margin: float = 0.05, prefix: str = "dependency.", accusing: str = "EDGE_DEGRADED",
) -> DataFrame:
    """(incident, rank, service, score, onset, reach, accusation, origin): where the episodes (incident, service, kind, signal, opened) of an incident may have started.

    Candidates are the services with episodes and those that an ``accusing`` episode names over one of the ``edges`` (service,
    dependency); the latter start when first accused.  onset: how early among the candidates.  reach: the share of the others
    that depend on it, over any number of edges.  accusation: accusations of it less those it makes, over all of the incident.
    The best one is the origin if it leads by ``margin``.  A row for each service of an incident, whatever its episodes.
    """
    named = F.when((F.col("kind") == accusing) & F.col("signal").startswith(prefix), F.expr(f"substring(signal, {len(prefix) + 1})"))
    accusations = episodes.select("incident", "service", "opened", named.alias("callee")).where("callee <> ''")
    committed = accusations.join(edges.select("service", F.col("dependency").alias("callee")).distinct(), ["service", "callee"], "left_semi")
    seen = episodes.select("incident", "service", "opened").unionByName(committed.select("incident", F.col("callee").alias("service"), "opened"))
    found = seen.groupBy("incident", "service").agg(F.min("opened").alias("opened"))
    spans = found.groupBy("incident").agg(F.min("opened").alias("first"), F.max("opened").alias("last"), F.count("*").alias("candidates"))
    net = accusations.groupBy("incident", "service", "callee").agg(F.count("*").alias("c"))
    net = net.select("incident", "c", F.explode(F.array(F.struct(F.col("callee").alias("service"), F.lit(1).alias("sign")), F.struct("service", F.lit(-1).alias("sign")))).alias("x"))
    net = net.groupBy("incident", F.col("x.service").alias("service")).agg(F.sum(F.col("c") * F.col("x.sign")).alias("net"))
    total = accusations.groupBy("incident").agg(F.count("*").alias("accusations"))
    depends = graph.reach(edges.select(F.col("service").alias("source"), F.col("dependency").alias("target"))).select("source", F.col("target").alias("service"))
    covered = found.select("incident", "service").join(depends, "service").join(found.select("incident", F.col("service").alias("source")), ["incident", "source"], "left_semi")
    covered = covered.groupBy("incident", "service").agg(F.count("*").alias("covered"))
    rows = found.join(spans, "incident").join(total, "incident", "left").join(net, ["incident", "service"], "left").join(covered, ["incident", "service"], "left")
    onset = F.when(F.col("last") > F.col("first"), 1 - (F.col("opened") - F.col("first")) / (F.col("last") - F.col("first"))).otherwise(1.0)
    reach = F.when(F.col("candidates") > 1, F.coalesce("covered", F.lit(0)) / F.greatest(F.col("candidates") - 1, F.lit(1))).otherwise(1.0)
    accusation = F.when(F.col("accusations") > 0, F.greatest(F.coalesce("net", F.lit(0)), F.lit(0)) / F.greatest("accusations", F.lit(1))).otherwise(0.0)
    rows = rows.withColumns({"onset": onset, "reach": reach, "accusation": accusation})
    rows = rows.withColumn("score", weights[0] * F.col("onset") + weights[1] * F.col("reach") + weights[2] * F.col("accusation"))
    order = Window.partitionBy("incident").orderBy(F.desc(F.round("score", 12)), "service")
    rows = rows.withColumns({"rank": F.row_number().over(order), "next": F.lead("score").over(order)})
    origin = (F.col("rank") == 1) & F.coalesce(F.col("score") - F.col("next") >= margin - 1e-9, F.lit(True))
    return rows.select("incident", "rank", "service", "score", "onset", "reach", "accusation", origin.alias("origin"))
