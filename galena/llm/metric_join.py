"""Exact Jaccard self-join of word shingles as a join in a metric space.

``d(A, B) = 1 - |A & B| / |A | B|`` is a metric; two documents link when it is at
most ``eps = 1 - similarity``.

* **First cut: a prefix filter.** In text almost all distances are 1, so the space is first cut
  into cells that no link crosses.  Shingles have one global order, rare in the corpus first (by a
  count sketch of fixed size over all documents; the order costs or saves time, never
  links).  ``d(A, B) <= eps`` leaves at most ``floor(eps |A|)`` shingles of A outside B, so linked
  sets share one of the first ``floor(eps |A|) + 1`` shingles of each.  Inside such a region,
  pairs are ruled out by their sizes and by odd sketches: bit i says whether the number of
  shingles in bucket i is odd, so that sketches differ in at most as many bits as sets differ in
  shingles.  A sketch has at least 3/4 as many bits as the set has shingles, whatever its size: with a
  fixed number long texts could not be told apart, and in a large corpus, where most of them share a
  rare shingle with some other one by chance, would all be connected.  What is left connects documents to cells; a
  region too large to be looked at in one task is connected as a whole and left to the next step.
* **Voronoi regions.** A cell that is too large for one task is cut by documents of it as
  pivots.  A document's home is the region of its nearest pivot.
* **Windows.** If x is at home with p, y with q and d(x, y) <= eps, then
  ``d(y, p) <= d(x, p) + eps <= d(x, q) + eps <= d(y, q) + 2 eps``.  So y is copied to every region
  whose pivot is at most ``2 eps`` further off than its own, and each document meets all its links at home.
* **Recursion.** Regions that are still too large are cut again, with pivots of their own.  Where
  cutting does not halve the pairs (a ball of near copies, all within ``2 eps``), the region is dealt to
  salted blocks, and every two blocks meet in a task of their own.
* **Joining.** In the tasks at the end whole sets are compared, links are counted at the document's
  home, and only a star of each group that they connect leaves the task.

Equal sets are one class from the start, so groups of exact copies cost one row.  Shingles are
64-bit hashes (see ``bytewords``): a pair is misjudged only if two of its own shingles collide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bytewords as B
from .components import connected
from .storage import cut, freed_shuffles, release

SKETCH_BITS = 20
LEAST_BITS = 256  # of an odd sketch
REGION_ROWS = 8192  # of the first cut, compared in one task; larger ones are connected as a whole
LEAF_CLASSES, LEAF_SHINGLES = 1024, 500_000  # of a Voronoi region that one task joins
PACK_ROWS = 512  # small regions go to tasks in packs of about so many rows
FANOUT = 16  # pivots of a region
FILTER_BITS = 23  # of a bitmap by which texts are left out that no cell asks for


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles fall in each of ``2**SKETCH_BITS`` cells, over all rows."""
    shift = np.uint64(64 - SKETCH_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in B.slices(batch.column(0)):
                _, found = B.shingles(data, offsets, k)
                cells += np.bincount((found >> shift).astype(np.int64), minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells[at], pa.int64())], ["cell", "n"])

    # each task writes up to 2**SKETCH_BITS rows: a fixed number of tasks, not one for each part of the input
    tasks = 3 * docs.sparkSession.sparkContext.defaultParallelism
    counted = docs.select("text").coalesce(tasks).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    with freed_shuffles(docs.sparkSession):
        found = counted.toArrow()  # at most 2**SKETCH_BITS rows, whatever the corpus
    cells = np.zeros(1 << SKETCH_BITS, np.int64)
    cells[found["cell"].to_numpy()] = found["n"].to_numpy()
    return cells


def _identity(at: np.ndarray, found: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.bincount(at, minlength=rows).astype(np.int64)
    h1, h2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(at):
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        h1[at[begin]] = np.add.reduceat(B.mix64(found + np.uint64(11)), begin)
        h2[at[begin]] = np.add.reduceat(B.mix64(found ^ np.uint64(0x5DEECE66D)), begin)
    return n, h1.view(np.int64), h2.view(np.int64)


def _windows(k: int, cells, numerator: int, denominator: int, columns: Sequence[str]):
    """Per row: set size, identity, prefix in the global order, and odd sketch."""
    shift = np.uint64(64 - SKETCH_BITS)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = cells.value
        for batch in batches:
            rest = batch.columns[1:]
            for lo, hi, data, offsets in B.slices(batch.column(0)):
                rows = hi - lo
                at, found = B.shingles(data, offsets, k)
                n, h1, h2 = _identity(at, found, rows)
                order = np.lexsort((found, often[(found >> shift).astype(np.int64)], at))
                rank = np.arange(len(at)) - B.per_row(at, rows)[at]
                first = rank <= (n - -(-n * numerator // denominator))[at]
                prefix = _lists(at[first], found[order][first], rows)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, rows) for c in rest), pa.array(n), pa.array(h1), pa.array(h2), prefix, _odd(at, found, n)], list(columns))

    return of


def _odd(at: np.ndarray, found: np.ndarray, n: np.ndarray) -> pa.Array:
    """The odd sketch of each row: a power of two of bits, at least 3/4 n; xor of its halves is the sketch of half as many."""
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(0.75 * n, 1))).astype(np.int64))
    begin = np.r_[0, np.cumsum(bits)]
    place = begin[at] + (found & (bits - 1)[at].astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(place, minlength=begin[-1]) & 1).astype(bool), bitorder="little")
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((begin // 8).astype(np.int32)), pa.py_buffer(odd)])


def _lists(at: np.ndarray, found: np.ndarray, rows: int) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(B.per_row(at, rows), pa.int64()), pa.array(found.view(np.int64))).cast(pa.list_(pa.int64()))


def _asked(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """The rows whose bit is in the bitmap ``wanted``."""
    held = np.frombuffer(wanted.value, np.uint8)
    for batch in batches:
        bit = batch.column("bit").to_numpy()
        yield batch.filter(pa.array((held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))


def _whole(k: int):
    """Name, identity, set size and shingles of texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in B.slices(batch.column("text")):
                at, found = B.shingles(data, offsets, k)
                n, h1, h2 = _identity(at, found, hi - lo)
                rest = [batch.column(c).slice(lo, hi - lo) for c in ("id_key", "text_key")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(h1), pa.array(h2), pa.array(n), _lists(at, found, hi - lo)], ["id_key", "text_key", "h1", "h2", "n", "shingles"])

    return of


def _bitmap(bits: DataFrame) -> bytes:
    """The set of ``bits`` (bit) below 2**FILTER_BITS, of that many bits whatever their number."""
    rows = bits.groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("b")).collect()
    held = bytearray(1 << (FILTER_BITS - 3))
    for r in rows:
        held[(r.k - 1) * 4096 : r.k * 4096] = r.b
    return bytes(held)


def _ranges(times: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Each i of lo..hi-1 as often as times[i] says, and a running number for each i."""
    t = times[lo:hi]
    return np.repeat(np.arange(lo, hi), t), np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)


def _steps(times: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(times), 0
    while lo < len(times):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step)))
        yield lo, hi
        lo = hi


def _roots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The smallest number that each of 0..size-1 is connected with by the edges (a, b)."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _near(p: int, q: int):
    """A star for each group of documents of these regions that sizes, ranks and odd sketches may link."""

    def of(rows: pa.Table) -> pa.Table:
        region = rows["region"].to_numpy()
        order = np.lexsort((rows["n"].to_numpy(), region))
        region, cid, n, rank = (rows[c].to_numpy()[order] for c in ("region", "cid", "n", "rank"))
        names, node = np.unique(cid, return_inverse=True)
        # the sketches of each document once, by their number of bits, and folded to half of it
        odd, first = rows["odd"].combine_chunks(), order[np.unique(cid, return_index=True)[1]]
        bits = np.log2(pc.binary_length(odd).to_numpy()[first]).astype(np.int64)
        spot = np.zeros(len(names), np.int64)
        held, folded = {}, {}
        for k in np.unique(bits):
            of = np.flatnonzero(bits == k)
            spot[of] = np.arange(len(of))
            held[k] = np.frombuffer(b"".join(odd.take(pa.array(first[of])).to_pylist()), np.uint64).reshape(len(of), -1)
            folded[k] = held[k][:, : held[k].shape[1] // 2] ^ held[k][:, held[k].shape[1] // 2 :]

        def linked(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            both = n[i] + n[j]
            # from this region on, the first that a linked pair shares, enough shingles must be left
            may = (n[i] * q >= n[j] * p) & (n[j] * q >= n[i] * p) & (np.minimum(n[i] - rank[i], n[j] - rank[j]) * (p + q) >= both * p) & (node[i] != node[j])
            i, j, most = i[may], j[may], both[may] * (q - p)
            fine = np.ones(len(i), bool)
            x, y = node[i], node[j]
            for k in held:
                for a, b, at in ((x, y, (bits[x] == k) & (bits[y] == k)), (x, y, (bits[x] == k) & (bits[y] == k + 1)), (y, x, (bits[y] == k) & (bits[x] == k + 1))):
                    at = np.flatnonzero(at)
                    for lo in range(0, len(at), step := max(1, (1 << 22) >> int(k))):
                        u, v = a[at[lo : lo + step]], b[at[lo : lo + step]]
                        other = held[k][spot[v]] if bits[v[0]] == k else folded[k + 1][spot[v]]
                        apart = np.bitwise_count(held[k][spot[u]] ^ other).sum(axis=1, dtype=np.int64)
                        # similarity >= p/q leaves at most (q - p) / (q + p) of both sizes apart
                        fine[at[lo : lo + step]] = apart * (p + q) <= most[at[lo : lo + step]]
            return i[fine], j[fine]

        def joined(edges: list) -> tuple[np.ndarray, np.ndarray]:
            root = _roots(*(np.concatenate([e[s] for e in edges]) for s in (0, 1)), len(names))
            moved = np.flatnonzero(root != np.arange(len(names)))
            return moved, root[moved]

        begin = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        end = np.r_[begin[1:], len(region)]
        of = np.repeat(np.arange(len(begin)), end - begin)
        # all that may link with the middle one of their region are connected by it: no pair of them is looked at
        middle = ((begin + end) // 2)[of]
        met, by = linked(np.arange(len(region)), middle)
        here = middle == np.arange(len(region))
        here[met] = True
        stars = [(node[met], node[by])]
        # of the other pairs those of like size, which are neighbours
        last = np.searchsorted((of << 40) + n, (of << 40) + n * q // p, "right")
        for some, others in ((np.arange(len(region)), np.flatnonzero(~here)), (np.flatnonzero(~here), np.flatnonzero(here))):
            lo = np.searchsorted(others, some, "right")
            times = np.maximum(np.searchsorted(others, last[some]) - lo, 0)
            for x, y in _steps(times, 1 << 20):
                i, nth = _ranges(times, x, y)
                stars.append(tuple(node[e] for e in linked(some[i], others[lo[i] + nth])))
                if sum(len(e[0]) for e in stars) > 1 << 21:
                    stars = [joined(stars)]
        a, b = joined(stars)
        return pa.table({"a": pa.array(names[a]), "b": pa.array(names[b])})

    return of


def jaccard_join(docs: DataFrame, k: int = 5, numerator: int = 4, denominator: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """Components of the documents linked by a shingle similarity of at least numerator/denominator.

    ``docs`` needs ``doc_id`` (integer) and ``text``; of the other columns those named in ``keep``
    are returned.  Returns one row per input row: doc_id, the columns ``keep``, n_shingles, component_id
    (the smallest doc_id reachable), n_links (the number of other classes of equal shingle sets that link
    with its class) and component (a number of its component, also where ids are null).

    Defined cases: a null or word-free text has n_shingles 0 and is linked with nothing (its
    component_id is its own doc_id, its component null); fewer than ``k`` words make one shingle; rows repeated as a
    whole are returned as often as they come; a null doc_id stays null and a component all of
    whose ids are null has a null component_id; an empty table gives no rows.  Columns of ``keep`` must not be
    named like a column of the result.
    """
    spark = docs.sparkSession
    own = ["n_shingles", "component_id", "n_links", "component"]
    if set(keep) & {"doc_id", "text", *own}:
        raise ValueError("a column to keep has the name of a result column")
    held = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    # a row is named by its id and a hash of its text, so that rows without an id, or with one id, are not taken for each other
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *held).withColumn("text_key", F.xxhash64("text"))
    cells = spark.sparkContext.broadcast(_sketch(docs, k))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[1:]] + ["n long", "h1 long", "h2 long", "prefix array<long>", "odd binary"]
    whole = cut(docs.mapInArrow(_windows(k, cells, numerator, denominator, [x.split(" ", 1)[0] for x in kinds]), ", ".join(kinds)))
    rows = cut(whole.drop("prefix", "odd", "text_key"))
    named_first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("row")
    classes = whole.where("n > 0").groupBy("h1", "h2").agg(named_first, *(F.first(c).alias(c) for c in ("n", "prefix", "odd")))
    classes = classes.withColumns({"rep": F.col("row.doc_id"), "rep_key": F.col("row.text_key")}).drop("row")
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    release(whole)

    cell = _cells(classes, numerator, denominator)
    # a member's set comes from the text of the class's first document; texts that no bit asks for are left out before they are
    # shuffled, as sets and not as texts
    named_by = lambda doc_id, text_key: {"id_key": F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "bit": F.pmod(F.xxhash64(doc_id, text_key), F.lit(1 << FILTER_BITS))}
    reps = classes.join(cell, "cid").withColumns(named_by("rep", "rep_key")).select("cid", "comp", "id_key", F.col("rep_key").alias("text_key"), "h1", "h2", "bit")
    reps = cut(reps)
    wanted = spark.sparkContext.broadcast(_bitmap(reps.select("bit")))
    texts = docs.withColumns(named_by("doc_id", "text_key")).select("text", "id_key", "text_key", "bit")
    same = ["id_key", "text_key", "h1", "h2"]
    whole_sets = _whole(k)
    sets = texts.mapInArrow(lambda batches: whole_sets(_asked(batches, wanted)), "id_key string, text_key long, h1 long, h2 long, n long, shingles array<long>").dropDuplicates(same)
    members = cut(sets.join(reps.drop("bit"), same).select(F.col("comp").alias("region"), "cid", "n", "shingles", F.lit(True).alias("native")))
    release(reps)
    counted = _count(members, numerator, denominator)
    labels = connected(counted.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    degree = counted.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    root = classes.select("cid", "h1", "h2", "rep").join(labels, "cid", "left").withColumn("component", F.coalesce("comp", "cid"))
    least = root.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = root.join(least, "component").join(degree, "cid", "left").select("h1", "h2", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component")
    named = cut(named)
    for x in (classes, members, counted):
        release(x)

    some = rows.where("n > 0").join(named, ["h1", "h2"], "left").withColumnRenamed("n", "n_shingles")
    none = rows.where("n = 0").withColumnRenamed("n", "n_shingles").withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    out = ["doc_id", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), *own]
    return some.select(out).unionByName(none.select(out))


def _cells(classes: DataFrame, p: int, q: int) -> DataFrame:
    """(cid, comp) of the classes that may link with another: cells that no link crosses."""
    placed = classes.select("cid", "n", F.posexplode("prefix").alias("rank", "region"))
    # most regions hold one document; without a neighbour of like size a document has no link in its region
    beside = Window.partitionBy("region").orderBy("n")
    like = (F.lag("n").over(beside) * q >= F.col("n") * p) | (F.col("n") * q >= F.lead("n").over(beside) * p)
    shared = cut(placed.withColumn("like", like).where("like").drop("like"))
    # regions with the same documents are looked at once: in the first of them by the global order, where all ranks are least
    alike = shared.groupBy("region").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(cid))").alias("x"), F.expr("bit_xor(xxhash64(cid, 1))").alias("y"), F.sum("rank").alias("ranks"), F.min("cid").alias("lead"))
    alike = alike.groupBy("size", "x", "y").agg(F.min_by("region", "ranks").alias("region"), F.min("lead").alias("lead"))
    rest = cut(shared.join(alike.select("region", "size", "lead"), "region").select("region", "size", "lead", "rank", "cid", "n"))
    release(shared)
    large = rest.where(F.col("size") > REGION_ROWS).select(F.col("cid").alias("a"), F.col("lead").alias("b")).distinct()
    small = rest.where(F.col("size") <= REGION_ROWS).select("region", F.col("rank").cast("long").alias("rank"), "cid", "n")
    packs = max(1, small.count() // (4 * PACK_ROWS))
    small = small.join(classes.select("cid", "odd"), "cid").withColumn("pack", F.pmod(F.xxhash64("region"), F.lit(packs)))
    links = cut(large.unionByName(small.groupBy("pack").applyInArrow(_near(p, q), "a long, b long")))
    release(rest)
    cell = connected(links)
    release(links)
    return cell


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.sum(F.col("native").cast("long")).alias("natives"))


def _count(members: DataFrame, p: int, q: int) -> DataFrame:
    """(cid, n_links, root) of the classes with links, from recursive Voronoi regions; classes may come several times."""
    leaves, dense, left, first = [], [], members, True
    while True:
        big = cut(_sizes(left).where((F.col("size") > LEAF_CLASSES) | (F.col("weight") > LEAF_SHINGLES)))
        if big.isEmpty():
            leaves.append(left)
            break
        leaves.append(left.join(big.select("region"), "region", "left_anti"))
        part = left.join(big, "region")
        homes = cut(_homes(part, p, q))
        after = homes.groupBy("region", "sub").agg(F.sum(F.col("native").cast("double")).alias("a"), F.count("*").alias("b")).groupBy("region").agg(F.sum(F.col("a") * F.col("b")).alias("after"))
        better = after.join(big, "region").where("2 * after <= natives * size").select("region")
        dense.append(part.join(better, "region", "left_anti"))
        next_ = homes.join(better, "region", "left_semi").select(F.xxhash64("region", "sub").alias("new"), "region", "cid", "native")
        left = cut(next_.join(left.drop("native"), ["region", "cid"]).select(F.col("new").alias("region"), "cid", "n", "shingles", "native"))

    found = []
    for some in leaves:
        packs = max(1, some.count() // PACK_ROWS)
        alone = some.select(F.pmod(F.xxhash64("region"), F.lit(packs)).alias("x"), F.lit(-1).cast("long").alias("y"), F.lit(True).alias("left"), F.lit(True).alias("right"), "region", "cid", "shingles", "native")
        found.append(alone.groupBy("x", "y").applyInArrow(_linked(p, q), _LINKED))
    for some in dense:
        # every two blocks of a region meet; a block also meets itself
        blocks = F.greatest(F.ceil(F.col("size") / LEAF_CLASSES), F.ceil(F.col("weight") / LEAF_SHINGLES)).cast("int")
        dealt = some.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        pairs = dealt.select("region", low.cast("long").alias("x"), high.cast("long").alias("y"), (F.col("block") == low).alias("left"), (F.col("block") == high).alias("right"), "cid", "shingles", "native")
        found.append(pairs.groupBy("region", "x", "y").applyInArrow(_linked(p, q), _LINKED))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out)


def _homes(part: DataFrame, p: int, q: int) -> DataFrame:
    """(region, cid, native, sub): each document at home with its nearest pivot, and copied to those at most 2 eps further off."""
    order = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("cid", "region")))
    pivots = part.where("native").withColumn("at", order).where(F.col("at") <= FANOUT)
    chunks = F.greatest(F.ceil(F.col("size") / LEAF_CLASSES), F.ceil(F.col("weight") / LEAF_SHINGLES)).cast("int")
    chunked = part.withColumn("chunk", F.pmod(F.xxhash64("cid"), chunks).cast("int")).select("region", "chunk", "cid", "shingles", "native")
    pivots = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select(*(F.col(c).alias(f"by_{c}") for c in ("region", "chunk", "cid", "shingles")))

    def of(docs: pa.Table, by: pa.Table) -> pa.Table:
        none = pa.table({c: pa.array([], t) for c, t in (("region", pa.int64()), ("cid", pa.int64()), ("native", pa.bool_()), ("sub", pa.int64()))})
        if not len(docs) or not len(by):
            return none
        by = by.sort_by("by_cid")
        sets = pa.chunked_array([*docs["shingles"].chunks, *by["by_shingles"].chunks]).combine_chunks()
        left = np.arange(len(sets)) < len(docs)
        size, both = _common(sets, left, ~left)
        far = 1 - both / (size[left][:, None] + size[~left][None, :] - both)
        nearest = far.argmin(axis=1)
        slack = 2 * (q - p) / q + 1e-9
        copied = far <= far.min(axis=1)[:, None] + slack
        doc, to = np.nonzero(copied)
        native = docs["native"].to_numpy()[doc] & (to == nearest[doc])
        return pa.table({"region": pa.array(docs["region"].to_numpy()[doc]), "cid": pa.array(docs["cid"].to_numpy()[doc]), "native": pa.array(native), "sub": pa.array(by["by_cid"].to_numpy()[to])})

    return chunked.groupBy("region", "chunk").cogroup(pivots.groupBy("by_region", "by_chunk")).applyInArrow(of, "region long, cid long, native boolean, sub long")


def _common(sets: pa.Array, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all sets, and how many shingles those of ``left`` share with those of ``right``."""
    n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    _, cols = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    return n, _overlaps(np.repeat(np.arange(len(n)), n), cols, left, right)


_LINKED = "cid long, n_links long, root long"


def _linked(p: int, q: int):
    """Links that the native classes of a task have there, and a star for each group that they connect."""

    def of(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        cid, native = rows["cid"].to_numpy(), rows["native"].to_numpy()
        left, right, region = (rows[c].to_numpy() for c in ("left", "right", "region"))
        size, both = _common(rows["shingles"].combine_chunks(), left, right)
        link = both * q >= (size[left][:, None] + size[right][None, :] - both) * p
        link &= (cid[left][:, None] != cid[right][None, :]) & (region[left][:, None] == region[right][None, :])
        n_links = np.zeros(len(cid), np.int64)
        n_links[left] += link.sum(axis=1)
        if not (left & right).any():  # two blocks: each pair is seen once, and counts for both
            n_links[right] += link.sum(axis=0)
        n_links[~native] = 0
        names, node = np.unique(cid, return_inverse=True)
        x, y = np.nonzero(link & (native[left][:, None] | native[right][None, :]))
        root = _roots(node[left][x], node[right][y], len(names))[node]
        some = (n_links > 0) | (root != node)
        return pa.table({"cid": pa.array(cid[some]), "n_links": pa.array(n_links[some]), "root": pa.array(names[root[some]])})

    return of


def _overlaps(at: np.ndarray, cols: np.ndarray, left: np.ndarray, right: np.ndarray, dense: int = 500, step: int = 1 << 22) -> np.ndarray:
    """How many shingles the sets of the rows ``left`` share with those of the rows ``right``.

    Shingles of many rows are multiplied as a matrix, those of few are listed pair by pair.
    """
    width = int(cols.max()) + 1 if len(cols) else 0
    sides = []
    for side in (left, right):
        place = np.cumsum(side) - 1
        mine = side[at]
        col = cols[mine]
        order = np.argsort(col, kind="stable")
        sides.append((place[at[mine]][order], col[order], int(side.sum()), np.bincount(col, minlength=width)))
    (ax, cx, mx, dx), (ay, cy, my, dy) = sides
    out = np.zeros((mx, my), np.int64)
    often = dx * dy * dense > mx * my
    heavy = np.flatnonzero(often)
    for lo in range(0, len(heavy), 2048):
        spot = np.full(width, -1)
        spot[heavy[lo : lo + 2048]] = np.arange(len(heavy[lo : lo + 2048]))
        parts = []
        for a, c, m in ((ax, cx, mx), (ay, cy, my)):
            x = np.zeros((m, 2048), np.float32)
            here = spot[c] >= 0
            x[a[here], spot[c[here]]] = 1
            parts.append(x)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    few = ~often[cx] & (dy[cx] > 0)
    ax, cx = ax[few], cx[few]
    start, times = (np.cumsum(dy) - dy)[cx], dy[cx]
    ends = np.cumsum(times)
    lo = 0
    while lo < len(ax):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step)))
        t = times[lo:hi]
        nth = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        pairs = np.repeat(ax[lo:hi], t) * my + ay[np.repeat(start[lo:hi], t) + nth]
        out += np.bincount(pairs, minlength=mx * my).reshape(mx, my)
        lo = hi
    return out


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over all of ``documents``: five-word shingles, similarity 0.8."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("component")


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
ORACLES = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words
), shingle AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS c FROM sets
  UNION
  SELECT p.b, r.c FROM reach r JOIN pairs p ON p.a = r.doc_id
), class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS c FROM sets),
degree AS (
  SELECT p.a AS doc_id, count(DISTINCT y.c) AS n_links
  FROM pairs p JOIN class x ON x.doc_id = p.a JOIN class y ON y.doc_id = p.b WHERE x.c <> y.c GROUP BY p.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, CAST(coalesce(d.n_links, 0) AS BIGINT) AS n_links
FROM sets s JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) m USING (doc_id) LEFT JOIN degree d USING (doc_id)
"""
}
