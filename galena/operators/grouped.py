"""Operators whose steps depend on earlier steps of the same small group, folded per group.

Groups are keyed so that no step can reach across them, and hold episodes, labels or the last
points of one series, never raw events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.dialect import statement
from ..plans.sized import small
from .detection import OPENINGS
from .evaluation import LABELS
from .graph import reach
from .statements import EDGE_SET, OBS


def incident_clusters(episodes: DataFrame, edges: DataFrame, within: int) -> DataFrame:
    """Incidents of ``episodes`` (id, service, opened) over ``edges`` (service, dependency).

    In the order of opening, an episode joins each incident that opened at most ``within``
    before and holds its service or a neighbour; several such incidents become one, the
    earliest.  Episodes are dealt by connected part of the graph and, within it, by runs of
    occupied spans of ``within``: the gap of an empty span is longer than ``within``, and no
    incident can bridge it.  A run is sorted by Spark and passes one task in batches, which holds
    only the incidents that can still be joined.  Returns id, incident (the id of its first
    episode) and merged (how many incidents the episode brought together).  Episodes without a
    service are adjacent to none.
    """
    linked = edges.toDF("source", "target")
    part = reach(linked, directed=False).groupBy(F.col("source").alias("service")).agg(F.least("source", F.min("target")).alias("part"))
    near = linked.union(linked.select("target", "source")).toDF("service", "other").groupBy("service").agg(F.collect_set("other").alias("near"))
    known = small(near.join(part, "service", "left"))
    alone = F.coalesce("part", "service", F.concat(F.lit("without a service: "), F.col("id").cast("string")))
    placed = episodes.withColumn("span", F.floor(F.col("opened") / within).cast("long")).join(known, "service", "left").withColumn("part", alone)
    # one row for each part and span of time, whatever the number of episodes
    order = Window.partitionBy("part").orderBy("span")
    spans = placed.select("part", "span").distinct().withColumn("gap", F.col("span") - F.lag("span").over(order))
    segments = spans.withColumn("segment", F.sum((F.coalesce("gap", F.lit(0)) > 1).cast("int")).over(order)).drop("gap")
    dealt = placed.join(segments, ["part", "span"]).select("part", "segment", "opened", F.col("id").cast("string").alias("id"), "service", "near")

    def told(incidents: list[dict]) -> list[tuple]:
        return [(e, i["first"], merged) for i in incidents for e, merged in i["ids"]]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, live, columns = None, [], ["id", "incident", "merged"]
        for batch in batches:
            out = []
            for r in batch.itertuples():
                closed = live if (r.part, r.segment) != current else [i for i in live if r.opened - i["opened"] > within]
                if closed:
                    out += told(closed)
                    live = [i for i in live if not any(i is c for c in closed)]
                current = r.part, r.segment
                touched = {r.service, *(r.near if r.near is not None else ())}
                met = [i for i in live if touched & i["services"]]
                home = met[0] if met else {"first": r.id, "opened": r.opened, "services": set(), "ids": []}
                for other in met[1:]:
                    home["services"] |= other["services"]
                    home["ids"] += other["ids"]
                live = [i for i in live if not any(i is o for o in met[1:])] + ([] if met else [home])
                home["services"].add(r.service)
                home["ids"].append((r.id, max(0, len(met) - 1)))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(told(live), columns=columns)

    return dealt.repartition("part", "segment").sortWithinPartitions("part", "segment", "opened", "id").mapInPandas(fold, "id string, incident string, merged int")


def episode_match(labels: DataFrame, found: DataFrame) -> DataFrame:
    """A largest one-to-one matching of ``labels`` (key, label, valid_from, valid_to) and ``found`` (key, id, opened).

    A pair may match if the episode opened inside the interval; each label tries the nearest
    first.  Pairs never cross keys.  Returns key, label, id, late.
    """
    pairs = labels.join(found, "key").where("opened >= valid_from AND opened < valid_to").select("key", "label", "id", (F.col("opened") - F.col("valid_from")).alias("late"))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        wanted = {n: g.sort_values(["late", "id"]) for n, g in rows.groupby("label")}
        choices = {n: list(zip(g["id"], g["late"])) for n, g in wanted.items()}
        taken: dict[str, str] = {}
        for start in sorted(choices):
            # breadth first to a free episode, then hand each episode on along the way back
            came, queue, end = {}, [start], None
            while queue and end is None:
                label = queue.pop(0)
                for e, _ in choices[label]:
                    if e not in came:
                        came[e] = label
                        if e not in taken:
                            end = e
                            break
                        queue.append(taken[e])
            while end is not None:
                label = came[end]
                before = next((e for e, n in taken.items() if n == label), None)
                taken[end] = label
                end = before
        late = {(n, e): d for n, c in choices.items() for e, d in c}
        return pd.DataFrame([(rows["key"].iloc[0], n, e, late[n, e]) for e, n in taken.items()], columns=["key", "label", "id", "late"])

    return pairs.groupBy("key").applyInPandas(match, "key string, label long, id string, late long")


def breaks(values: np.ndarray, penalty: float = 0.01, shortest: int = 4) -> list[int]:
    """Starts of the segments after the first that minimise squared error plus ``penalty`` for each."""
    n = len(values)
    s, s2 = np.r_[0, np.cumsum(values)], np.r_[0, np.cumsum(values * values)]
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for end in range(shortest, n + 1):
        at = np.arange(0, end - shortest + 1)
        cost = best[at] + penalty + (s2[end] - s2[at]) - (s[end] - s[at]) ** 2 / (end - at)
        back[end], best[end] = at[np.argmin(cost)], cost.min()
    out, end = [], n
    while end > 0 and back[end] > 0:
        end = back[end]
        out.append(int(end))
    return out[::-1]


def pelt_saturation(series: DataFrame, tail: int = 24, least: int = 12) -> DataFrame:
    """Saturation of ``series`` (key, ts, used, capacity) from its last ``tail`` points.

    A break counts if at least 0.8 of the steps behind it rise, the slope is 2e-4 a second or
    more and the mean grows; with 0.2 of headroom or less it scores 0.8 (headroom 0.2) to 1
    (0.05).  Series with fewer than ``least`` points are left out.
    """
    last = series.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts")))).where(F.col("_k") <= tail).drop("_k")

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        key, y, t = rows["key"].iloc[0], (rows["used"] / rows["capacity"]).to_numpy(), rows["ts"].to_numpy(float)
        empty = pd.DataFrame({"key": [key], "points": [len(y)], "break_ts": [None], "score": [None]})
        if len(y) < least:
            return empty.iloc[:0]
        for b in breaks(y):
            after = y[b:]
            rising, slope = np.mean(np.diff(after) > 0), np.polyfit(t[b:] - t[b], after, 1)[0] if len(set(t[b:])) > 1 else 0.0
            if rising >= 0.8 and slope >= 2e-4 and after.mean() > y[:b].mean():
                room = 1 - y[-1]
                score = min(1.0, 0.8 + 0.2 * (0.2 - room) / 0.15) if room <= 0.2 else None
                return pd.DataFrame({"key": [key], "points": [len(y)], "break_ts": [t[b]], "score": [score]})
        return empty

    return last.groupBy("key").applyInPandas(judge, "key string, points long, break_ts double, score double")


_EPISODES, _ = statement(f"SELECT concat(stream, '@', CAST(tick AS VARCHAR(9))) AS id, substr(stream, 6) AS service, tick AS opened FROM {OPENINGS} o")
_EDGES, _ = statement(f"SELECT e.service, e.dependency FROM {EDGE_SET} e")
_LABELS, _ = statement(f"SELECT event_type AS key, day AS label, valid_from, valid_to FROM {LABELS} l")
_USED, _ = statement(f"SELECT CAST(user_id AS VARCHAR(20)) AS key, us / 1e6 AS ts, sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS used, 1000.0e0 AS capacity FROM {OBS} o")

QUERIES = {
    "incident_clusters": (lambda spark, sf: incident_clusters(_EPISODES(spark, sf), _EDGES(spark, sf), 8), None),
    "episode_match": (lambda spark, sf: episode_match(_LABELS(spark, sf), _EPISODES(spark, sf).withColumnRenamed("service", "key")), None),
    "pelt_saturation": (lambda spark, sf: pelt_saturation(_USED(spark, sf)), None),
}
