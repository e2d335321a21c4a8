"""Exact top-k inner products from an impact-ordered index, score at a time.

Each component of a quantised vector is a posting (dimension -> vector, value) and its
magnitude is its impact.  ``build_index`` writes the postings of each block of vectors once, in
segments of falling impact.  A search adds segments to the accumulators of its queries from the
highest on.  What lower segments can still add is bounded by the norms of what is left of the
vector and of the query (Cauchy-Schwarz); the scan stops only when that proves that few
vectors can be among a query's best k, and exactly these are rescored from whole vectors.

Each query is first searched in one block; its k-th score there is a floor for all others.
Blocks have fixed sizes, and every pair of a vector block and a query block is one group of a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .storage import cut

VECTOR_BLOCK, QUERY_BLOCK = 8192, 16384
GROUP = 256  # queries that share accumulators
EDGES = (1 / 2, 1 / 4, 1 / 8, 3 / 32, 1 / 16, 1 / 32)  # where segments end, as shares of a block's highest impact
RESCORE_SHARE = 0.03  # the scan stops when at most this share of a block can still be among the best


def quantised(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(vec_id, q) with q = floor(factor * x); rows with a null id, a null vector or a null or non-finite component are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * factor).cast("long")).alias("q"))


_INDEX = "d int, vb long, segment int, vec_ids array<long>, starts array<int>, places array<int>, impacts array<long>"


def build_index(vectors: DataFrame) -> DataFrame:
    """The postings of (d, vb, vec_id, q): a row for each block and segment, by dimension and falling impact; the first has the ids."""

    def of(rows: pa.Table) -> pa.Table:
        d, vb = rows["d"][0].as_py(), rows["vb"][0].as_py()
        v = rows["q"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        size = np.abs(v).T
        top = int(size.max(initial=0))
        edges = sorted({top + 1, *(max(1, round(top * x)) for x in EDGES), 1}, reverse=True)
        out: dict[str, list] = {c.split()[0]: [] for c in _INDEX.split(", ")}
        for i, (hi, lo) in enumerate(zip(edges, [*edges[1:], 0])):  # zeros, below 1, are no postings
            dims, places = np.nonzero((size >= max(lo, 1)) & (size < hi))
            order = np.lexsort((places, -size[dims, places], dims))
            dims, places = dims[order], places[order]
            ids = rows["vec_id"].to_numpy() if not i else np.zeros(0, np.int64)
            for c, x in zip(out, (d, vb, i, ids, np.searchsorted(dims, np.arange(d + 1)), places, v[places, dims])):
                out[c].append(x)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.table({c: pa.array(x, k) for (c, x), k in zip(out.items(), kinds)})

    return vectors.select("d", "vb", "vec_id", "q").groupBy("d", "vb").applyInArrow(of, _INDEX)


def search(index: pa.Table, qs: np.ndarray, q_id: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query's place, vec_id, score) of the k best with another id of each query in one block, and the multiplications made.

    Candidates below a query's ``floor`` may be left out.
    """
    index = index.sort_by("segment")
    v_id = index["vec_ids"][0].values.to_numpy()
    n, d = len(v_id), qs.shape[1]
    parts = [tuple(index[c][i].values.to_numpy() for c in ("starts", "places", "impacts")) for i in range(len(index))]
    whole = np.zeros((n, d), np.int64)
    for starts, places, impacts in parts:
        whole[places, np.repeat(np.arange(d), np.diff(starts))] = impacts
    left = (whole.astype(np.float64) ** 2).sum(axis=1)
    rest = []
    for _, places, impacts in parts:
        left = left - np.bincount(places, impacts.astype(np.float64) ** 2, n)
        rest.append(np.sqrt(np.maximum(left, 0)))
    rest[-1][:] = 0
    norms = np.linalg.norm(qs.astype(np.float64), axis=1)
    longest = np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    # all partial sums are whole numbers below the product of the norms times sqrt(d): exact in either type
    kind = np.float32 if longest * norms.max(initial=0) * d < 1 << 24 else np.float64
    kk, made, out = min(k, n), 0, []
    live = np.flatnonzero(norms * longest >= floor)  # else no vector of the block can reach the floor
    for lo in range(0, len(live), GROUP):
        at = live[lo : lo + GROUP]
        by_dim = np.ascontiguousarray(qs[at].T.astype(kind))
        acc = np.zeros((n, len(at)), kind)
        own = v_id[:, None] == q_id[at][None, :]
        for (starts, places, impacts), slack in zip(parts, rest):
            impacts = impacts.astype(kind)
            for j in range(d):
                here = places[starts[j] : starts[j + 1]]
                if len(here):
                    acc[here] += impacts[starts[j] : starts[j + 1], None] * by_dim[j]
            made += len(places) * len(at)
            if slack.mean() > 0.12 * longest:
                continue
            open_ = (slack[:, None] * norms[at][None, :] * (1 + 1e-6) + 1e-3).astype(np.float64) if slack.any() else np.zeros((1, len(at)))
            low = np.where(own, -np.inf, acc - open_)
            kth = np.maximum(np.partition(low, n - kk, axis=0)[n - kk], floor[at])
            possible = (acc + open_ >= kth[None, :]) & ~own
            if possible.sum() <= max(RESCORE_SHARE * possible.size, 4 * k * len(at)):
                break
        for i, x in enumerate(at):
            some = np.flatnonzero(possible[:, i])
            made += len(some) * d
            exact = whole[some] @ qs[x]
            out += [(int(x), int(v_id[some[j]]), int(exact[j])) for j in np.lexsort((v_id[some], -exact))[:k]]
    return out, made


def _searched(k: int):
    def of(index: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(index) and len(queries):
            d = index["d"][0].as_py()
            q_id, floor = queries["query_id"].to_numpy(), queries["floor"].to_numpy()
            found, _ = search(index, queries["q"].combine_chunks().flatten().to_numpy().reshape(-1, d), q_id, floor, k)
            best: dict[int, list[int]] = {}
            for i, _, score in found:
                best.setdefault(i, []).append(score)
            rows = [(int(q_id[i]), v, score, min(best[i]) if len(best[i]) == k else None) for i, v, score in found]
        return pa.table({c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(("query_id", "vec_id", "score", "kth"))})

    return of


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k vectors with the highest inner product with each query.

    Both tables are (vec_id, q).  A row with the query's own id is no candidate; ties go to the smaller vec_id;
    only vectors of the query's length are candidates.  A repeated row is a candidate as often as it comes;
    queries with one id share that id's k places.  Empty tables give no rows; other columns are not read.
    """
    vectors, queries = (x.select("vec_id", "q").withColumn("d", F.size("q")).where("d > 0") for x in (vectors, queries))
    counted = [x.groupBy("d").agg(F.ceil(F.count("*") / most).cast("long").alias(name)) for x, most, name in ((vectors, VECTOR_BLOCK, "nv"), (queries, QUERY_BLOCK, "nq"))]
    sizes = cut(counted[0].join(counted[1], "d"))  # a row for each length
    hashed = F.xxhash64("vec_id", "q")
    placed = vectors.join(sizes, "d").withColumn("vb", F.pmod(hashed, "nv"))
    index = cut(build_index(placed))
    spread = index.join(sizes.select("d", "nq"), "d").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1))).drop("nq")
    asked = queries.join(sizes, "d").select(F.col("d").alias("qd"), F.col("vec_id").alias("query_id"), "q", F.pmod(hashed, "nq").alias("q_block"), F.pmod(hashed, "nv").alias("first"), "nv")

    def searched(some: DataFrame) -> DataFrame:
        pairs = spread.groupBy("d", "vb", "qb").cogroup(some.select("qd", "at", "q_block", "query_id", "q", F.col("floor").cast("double").alias("floor")).groupBy("qd", "at", "q_block"))
        return pairs.applyInArrow(_searched(k), "query_id long, vec_id long, score long, kth long")

    first = cut(searched(asked.withColumn("at", F.col("first")).withColumn("floor", F.lit(float("-inf")))))
    floors = first.groupBy("query_id").agg(F.max("kth").alias("floor"))
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1), lambda b: b != F.col("first")))
    rest = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).withColumn("at", others)
    found = first.drop("kth").unionByName(searched(rest).drop("kth"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` for each whose vec_id is divisible by 20."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op9_exact_topk": op9_exact_topk}
ORACLES = {
    "op9_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
