"""Monitors: drift between adjacent windows of a series, isolation of rare rows, and drift of measured intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def placed(rows: DataFrame, width: int) -> DataFrame:
    """Rows (stream, at, id) with ``place``, their number in their stream by (at, id), from 0.

    Rows are numbered within buckets of ``width``; what came before a bucket is a running sum over one row for each bucket,
    so that no task orders a whole stream.
    """
    bucketed = rows.withColumn("bucket", F.floor(F.col("at") / width))
    counts = bucketed.groupBy("stream", "bucket").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("stream", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("stream", "bucket").orderBy("at", "id")) - 1
    return bucketed.join(starts, ["stream", "bucket"]).withColumn("place", F.col("start") + within).drop("bucket", "start")


def ks_windows(series: DataFrame, width: int, window: int = 100, recent: int = 30, alpha: float = 0.005, block: int = 4096) -> DataFrame:
    """(stream, place, id, distance, alarm) of each row of (stream, at, id, value) that ends a full window.

    distance is the Kolmogorov-Smirnov distance between the last ``recent`` values and the window's others; from
    sqrt(-ln(alpha) / recent) on, exclusively, it is an alarm.  Rows without a value are left out.  A stream is cut into blocks
    of places, each with the end of the one before it, so that a hot stream is many tasks; ``width`` is as for ``placed``.
    """
    rows = placed(series.where("value IS NOT NULL").select("stream", "at", "id", F.col("value").cast("double").alias("value")), width)
    own = F.floor(F.col("place") / block)
    late = F.col("place") % block > block - window
    rows = rows.withColumn("block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    last = Window.partitionBy("stream", "block").orderBy("place").rowsBetween(1 - window, 0)
    full = rows.withColumn("values", F.collect_list("value").over(last)).where((own == F.col("block")) & (F.size("values") == window))
    old = window - recent

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("values").flatten().to_numpy().reshape(-1, window)
            order = np.argsort(v, axis=1, kind="stable")
            ranked = np.take_along_axis(v, order, axis=1)
            gap = np.abs(np.cumsum(np.where(order >= old, old, -recent), axis=1))  # in units of 1 / (old * recent): whole numbers
            gap[:, :-1][ranked[:, 1:] == ranked[:, :-1]] = 0  # distributions are compared after all of a tie
            d = gap.max(axis=1, initial=0) / (old * recent)
            kept = [batch.column(c) for c in ("stream", "place", "id")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(d, pa.float64())], ["stream", "place", "id", "distance"])

    kinds = dict(full.dtypes)
    found = full.select("stream", "place", "id", "values").mapInArrow(distances, f"stream {kinds['stream']}, place {kinds['place']}, id {kinds['id']}, distance double")
    return found.withColumn("alarm", F.col("distance") > float(np.sqrt(-np.log(alpha) / recent)))


def mean_path(n: Column) -> Column:
    """The mean depth of an unsuccessful search among n rows, by which isolation depths are scaled."""
    size = n.cast("double")
    harmonic = F.log(F.greatest(size - 1, F.lit(1.0))) + float(np.euler_gamma)
    return F.when(size > 2, 2 * harmonic - 2 * (size - 1) / F.greatest(size, F.lit(1.0))).when(size == 2, 1.0).otherwise(0.0)


_NODES = "tree int, node long, feature int, cut double, size long"


def isolation_trees(rows: DataFrame, features: list[str], trees: int = 100, sample: int = 256) -> DataFrame:
    """(tree, node, feature, cut, size): trees over about ``sample`` rows each of (id, features); node n has children 2n and 2n + 1, a leaf no feature.

    Rows are drawn by a hash of id and tree, so that a lost task draws the same ones; rows with a null feature are left out.
    Each tree is one small group.
    """
    rows = rows.select("id", *(F.col(c).cast("double").alias(c) for c in features)).dropna(subset=features)
    total = rows.count()
    share = min(1.0, sample / max(total, 1))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("id", t), F.lit(1 << 30)) < int(share * (1 << 30)))
    depth = int(np.ceil(np.log2(max(sample, 2))))

    def grow(group: pa.Table) -> pa.Table:
        tree = group["tree"][0].as_py()
        x = np.stack([group[c].to_numpy() for c in features], axis=1)
        x = x[np.lexsort(x.T[::-1])]  # the order of arrival must not matter
        rng, out, todo = np.random.default_rng(tree), [], [(1, np.arange(len(x)), 0)]
        while todo:
            node, at, level = todo.pop()
            spread = np.flatnonzero(np.ptp(x[at], axis=0) > 0)
            if level == depth or not len(spread):
                out.append((tree, node, None, None, len(at)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[at, f].min(), x[at, f].max()))
            left = x[at, f] <= cut
            out.append((tree, node, f, cut, len(at)))
            todo += [(2 * node, at[left], level + 1), (2 * node + 1, at[~left], level + 1)]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
        return pa.table({c.split()[0]: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(_NODES.split(", "), kinds))})

    return rows.withColumn("tree", F.explode(drawn)).select("tree", *features).groupBy("tree").applyInArrow(grow, _NODES)


def isolation_scores(rows: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """(id, score) of each row of (id, features): 2 ** -(mean depth / mean path), near 1 for rows that few cuts isolate; null where a feature is.

    The forest goes to every task; its size is bounded by its number of trees and their samples, not by the rows.
    """
    sizes = nodes.where("node = 1").agg(F.avg(mean_path(F.col("size")))).first()[0] or 1.0
    leaves = nodes.withColumn("path", F.floor(F.log2("node")) + mean_path(F.col("size"))).toArrow()
    forest = []
    for t in np.unique(leaves["tree"].to_numpy()):
        of = leaves.filter(pa.compute.equal(leaves["tree"], int(t))).sort_by("node")
        node = of["node"].to_numpy()
        forest.append((node, of["feature"].fill_null(-1).to_numpy(), of["cut"].fill_null(0.0).to_numpy(), of["path"].to_numpy()))
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
            total = np.zeros(len(x))
            for node, feature, cut, path in shared.value:
                at = np.ones(len(x), np.int64)
                while True:
                    i = np.searchsorted(node, at)
                    inner = feature[i] >= 0
                    if not inner.any():
                        break
                    right = x[np.arange(len(x)), feature[i]] > cut[i]
                    at = np.where(inner, 2 * at + right, at)
                total += path[i]
            s = 2.0 ** -(total / max(len(shared.value), 1) / sizes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64(), mask=np.isnan(x).any(axis=1))], ["id", "score"])

    kept = rows.select("id", *(F.col(c).cast("double").alias(c) for c in features))
    return kept.mapInArrow(score, f"id {dict(kept.dtypes)['id']}, score double")


def offset_drift(intervals: DataFrame, bound: float) -> DataFrame:
    """(id, start_drift, end_drift, exceeded): measured less requested offsets of (id, start, end, wanted_start, wanted_end), and whether either is off by more than ``bound``."""
    drift = intervals.select("id", (F.col("start") - F.col("wanted_start")).alias("start_drift"), (F.col("end") - F.col("wanted_end")).alias("end_drift"))
    return drift.withColumn("exceeded", F.greatest(F.abs("start_drift"), F.abs("end_drift")) > bound)


class AdaptiveWindow:
    """The values since the last change, as an exponential histogram: at most ``most`` buckets of each size 1, 2, 4, ...

    A bucket is (mean, sum of squared distances from it).  Bifet and Gavalda, "Learning from time-changing data with adaptive windowing".
    """

    def __init__(self, delta: float, most: int = 5):
        self.delta, self.most = delta, most
        self.levels: list[list[tuple[float, float]]] = [[]]

    def add(self, value: float) -> None:
        self.levels[0].append((value, 0.0))
        for i, level in enumerate(self.levels):
            if len(level) <= self.most:
                break
            (a, p), (b, q) = level[:2]
            del level[:2]
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(((a + b) / 2, p + q + (a - b) ** 2 * 2**i / 2))

    def totals(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Sizes and means of the buckets, oldest first, and the variance of the whole window."""
        levels = range(len(self.levels) - 1, -1, -1)
        sizes = np.array([2.0**i for i in levels for _ in self.levels[i]])
        means, squares = np.array([b for i in levels for b in self.levels[i]]).reshape(-1, 2).T
        spread = squares.sum() + (sizes * (means - np.average(means, weights=sizes)) ** 2).sum()
        return sizes, means, spread / sizes.sum()

    def shrink(self) -> bool:
        """Drop the oldest buckets while some cut tells two means apart; whether any was dropped."""
        dropped = False
        while True:
            sizes, means, variance = self.totals()
            n = sizes.sum()
            if len(sizes) < 2 or n < 3:
                return dropped
            old, sums = np.cumsum(sizes)[:-1], np.cumsum(sizes * means)
            new = n - old
            apart = np.abs(sums[:-1] / old - (sums[-1] - sums[:-1]) / new)
            log, share = np.log(2 * np.log(n) / self.delta), 1 / old + 1 / new
            if not (apart > np.sqrt(2 * share * variance * log) + 2 / 3 * share * log).any():
                return dropped
            dropped = True
            self.levels[-1].pop(0)
            while len(self.levels) > 1 and not self.levels[-1]:
                self.levels.pop()


def adaptive_drift(values: DataFrame, delta: float = 0.002, every: int = 32) -> DataFrame:
    """(stream, place, id, width, mean, alarm) at each ``every``-th value of each stream (stream, at, id, value): the window kept, its mean, and whether it shrank.

    A stream is read in the order of (at, id); it is sorted by Spark, which spills, and passes one task as Arrow batches with a
    window that grows with the logarithm.  Null and non-finite values, and rows without a stream, don't count.
    """
    kept = values.select(F.col("stream").cast("string").alias("stream"), "at", "id", F.col("value").cast("double").alias("value"))
    kept = kept.where("stream IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")
    out = {"stream": pa.string(), "place": pa.int64(), "id": None, "width": pa.int64(), "mean": pa.float64(), "alarm": pa.bool_()}

    def watch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, window, place = None, AdaptiveWindow(delta), -1
        for batch in batches:
            told = []
            for i, (stream, value) in enumerate(zip(batch.column("stream").to_pylist(), batch.column("value").to_pylist())):
                if stream != current:
                    current, window, place = stream, AdaptiveWindow(delta), -1
                window.add(value)
                place += 1
                if (place + 1) % every == 0:
                    alarm = window.shrink()
                    sizes, means, _ = window.totals()
                    told.append((stream, place, i, int(sizes.sum()), float(np.average(means, weights=sizes)), alarm))
            lists = dict(zip(out, map(list, zip(*told)))) if told else {c: [] for c in out}
            ids = batch.column("id").take(pa.array(lists["id"], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids if kind is None else pa.array(lists[c], kind) for c, kind in out.items()], names=list(out))

    return kept.repartition("stream").sortWithinPartitions("stream", "at", "id").mapInArrow(watch, f"stream string, place long, id {dict(kept.dtypes)['id']}, width long, mean double, alarm boolean")
