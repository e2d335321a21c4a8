"""Spelling variants of the corpus vocabulary: words one inserted, deleted or replaced code point apart.

* **Counts.** Words of each whole text are counted inside the task and summed by Spark, so a word that
  fills a third of the corpus is a row for each task and not for each occurrence.
* **Groups.** A pair of words whose longer one has ``m`` code points differs at one place ``p``, the
  length of the words' common prefix.  For a segment ``[lo, hi)`` of places that holds ``p`` the two
  agree in their first ``lo`` code points and in their last ``m - hi``; this and the segment are the key
  of a group.  Each word is dealt to the two halves of ``[0, m)`` for both lengths ``m`` that it can have
  in a pair, so that each pair meets in exactly one group.
* **Hot groups.** A group of more than ``most`` words is dealt again to the halves of its own segment, until
  the segment is one place; words in such a group are all near each other.
* **Sorted-list dynamic programming.** A group's words arrive sorted, with the length of the prefix that each
  shares with the one before (LCP).  A word is compared with those after it by an edit matrix of band three,
  a row for each code point of the other word.  Rows up to the LCP are those of the word before; when
  all cells of a row pass one edit, every word with that prefix is skipped by the next smaller LCP.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BLOCK_WORDS = 400_000  # distinct words that a task holds at a time while it counts
GROUP_WORDS = 4_096  # larger groups are dealt again
KEY = ["m", "lo", "hi", "head", "tail"]


def word_counts(docs: DataFrame, least_chars: int = 6, every: int = 199) -> DataFrame:
    """(word, n) of the words of at least ``least_chars`` code points in all whole texts of (doc_id, text).

    Words are runs of Latin letters (those of U+00C0 to U+00FF as they are, A-Z as a-z), one of ``every`` (text, run) pairs
    without one code point.  A null text has none; a null doc_id counts as an empty name; rows that repeat count again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(((name.as_py() or "") + ":").encode())
                found: Counter[str] = Counter()
                for run, n in Counter(RUN.findall(text.as_py() or "")).items():
                    found[run.lower() if run.isascii() else run.translate(LOWER)] += n
                for run, n in found.items():
                    if len(run) >= least_chars:
                        h = zlib.crc32(run.encode(), start)
                        if h % every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < least_chars:
                                continue
                        seen[run] += n
                if len(seen) >= BLOCK_WORDS:
                    yield give()
                    seen.clear()
        if seen:
            yield give()

    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _dealt(words: DataFrame, segments) -> DataFrame:
    """A row of (word, n) for each (m, lo, hi) of the array column ``segments``, with its key."""
    rows = words.select("word", "n", F.explode(segments).alias("s")).select("word", "n", "s.*")
    return rows.select("word", "n", "m", "lo", "hi", F.expr("left(word, lo)").alias("head"), F.expr("right(word, m - hi)").alias("tail"))


def _halves(m, lo, hi):
    mid = F.floor((lo + hi) / 2).cast("int")
    part = lambda a, b: F.struct(m.cast("int").alias("m"), a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    return F.filter(F.array(part(lo, mid), part(mid, hi)), lambda s: s["lo"] < s["hi"])


def groups(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(word, n) with the keys of its groups, each of at most ``most`` words or of one place."""
    zero, size = F.lit(0), F.char_length("word")
    rows = cut(_dealt(words, F.concat(_halves(size, zero, size), _halves(size + 1, zero, size + 1))))
    done = None
    while True:
        large = cut(rows.where("hi - lo > 1").groupBy(*KEY).count().where(F.col("count") > most).select(*KEY))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, KEY, "left_anti")
        done = small if done is None else done.unionByName(small)
        again = rows.join(large, KEY, "left_semi").select("word", "n", F.col("m").alias("m0"), F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
        again = again.select("word", "n", F.explode(_halves(F.col("m0"), F.col("lo0"), F.col("hi0"))).alias("s")).select("word", "n", "s.*")
        rows = cut(again.select("word", "n", "m", "lo", "hi", F.expr("left(word, lo)").alias("head"), F.expr("right(word, m - hi)").alias("tail")))


def _common(a: str, b: str) -> int:
    i = 0
    for x, y in zip(a, b):
        if x != y:
            break
        i += 1
    return i


def pairs(words: list[str], m: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Places (i, j), i < j, of the sorted ``words`` that are one edit apart, the longer of ``m`` code points, with a common prefix of ``lo`` to ``hi - 1``.

    The list is scanned once for each word; the edit matrix's rows, three cells around the diagonal, lie on a stack by depth.
    """
    count = len(words)
    lcp = [0, *(_common(a, b) for a, b in zip(words, words[1:])), -1]
    later = [count] * (count + 1)  # the next place with a smaller LCP
    stack: list[int] = []
    for k in range(count + 1):
        while stack and lcp[stack[-1]] > lcp[k]:
            later[stack.pop()] = k
        stack.append(k)
    for i, word in enumerate(words):
        size = len(word)
        k = i + 1
        while lcp[k] >= hi:
            k = later[k]
        rows = [(1, 0, 1)] * (size + 1)  # of the word against itself; cells of one column less, the same and one more
        top = size
        while k < count and lcp[k] >= lo:
            other = words[k]
            top = min(top, lcp[k])
            dead = 0
            while top < len(other):
                a, b, c = rows[top]
                x = other[top]
                # columns top, top + 1 and top + 2 of the next row
                left = min(a + (top < 1 or top > size or word[top - 1] != x), b + 1) if top <= size else 2
                same = min(b + (word[top] != x), c + 1, left + 1) if top < size else 2
                right = min(c + (word[top + 1] != x), same + 1) if top + 1 < size else 2
                top += 1
                if top < len(rows):
                    rows[top] = (left, same, right)
                else:
                    rows.append((left, same, right))
                if left > 1 and same > 1 and right > 1:
                    dead = top
                    break
            if dead:
                k += 1
                while lcp[k] >= dead:
                    k = later[k]
                top = dead - 1
                continue
            off = size - len(other)
            if -1 <= off <= 1 and max(size, len(other)) == m and rows[top][1 + off] == 1:
                yield i, k
            k += 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word of each group: the number of its near words there, and the one of largest n (then the smallest)."""
    out: list[tuple] = []

    def close(key: tuple, words: list[str], counts: list[int]) -> None:
        best: dict[int, list] = {}
        for i, j in pairs(words, *key[:3]):
            for a, b in ((i, j), (j, i)):
                had = best.get(a)
                if had is None:
                    best[a] = [1, -counts[b], words[b]]
                else:
                    had[0] += 1
                    had[1:] = min(had[1:], [-counts[b], words[b]])
        out.extend((words[a], k, -n, near) for a, (k, n, near) in best.items())

    def give() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NEAR)], schema=_NEAR)
        out.clear()
        return done

    key, words, counts = None, [], []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for *now, word, n in zip(*cols):
            if now != key:
                if key is not None:
                    close(tuple(key), words, counts)
                    if len(out) >= 20_000:
                        yield give()
                key, words, counts = now, [], []
            words.append(word)
            counts.append(n)
    if key is not None:
        close(tuple(key), words, counts)
    if out:
        yield give()


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def near_words(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, near_n, near) of each of the distinct ``words`` (word, n) that has near ones."""
    rows = groups(words.select("word", "n"), most).select(*KEY, "word", "n")
    found = rows.repartition(*KEY).sortWithinPartitions(*KEY, "word").mapInArrow(_scan, "word string, n_near long, near_n long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def variants(words: DataFrame, ratio: int = 5, most: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of the distinct ``words`` (word, n).

    A word's form is its near word of largest n (of equal ones the first in code-point order) if that has at least ``ratio`` times
    the word's n, else null; its root is the last of its forms.  Words that are null or without code points are left out.
    """
    words = words.where("word <> '' AND n > 0")
    near = near_words(words, most)
    form = F.col("near_n") >= ratio * F.col("n")
    rows = cut(words.join(near, "word", "left").select("word", F.when(form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("near_n")).alias("form_n")))
    # forms grow ratio-fold, which bounds the length of a chain; each join doubles the steps taken
    top, least = rows.agg(F.max("n"), F.min("n")).first()
    longest = int(math.log((top or 1) / (least or 1), ratio) + 1e-9)
    links = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, longest - 1).bit_length()):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 6 code points and 5 occurrences in all ``documents``, with their forms and roots."""
    words = cut(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("n >= 5"))
    return variants(words)


QUERIES = {"op11_spelling": op11_spelling}
#: crc32 is linear: a byte's share is its value pushed through as many zero bytes as follow it, eight shifts each, and so is the initial register's.
ORACLES = {
    "op11_spelling": r"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS MATERIALIZED (SELECT name, run, count(*) AS c, hex(encode(name || ':' || run)) AS hx, row_number() OVER () AS id FROM runs GROUP BY name, run),
shifts AS (
  SELECT b, 0 AS j, b AS x FROM (SELECT unnest(range(256)) AS b UNION ALL SELECT 4294967295)
  UNION ALL SELECT b, j + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END) FROM shifts WHERE j < 8 * (SELECT max(length(hx)) // 2 FROM g)
), shares AS MATERIALIZED (SELECT b, j // 8 AS zeros, x FROM shifts WHERE j % 8 = 0),
bytes AS (SELECT id, CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT) AS b, length(hx) // 2 - i AS zeros FROM (SELECT id, hx, unnest(range(length(hx) // 2)) AS i FROM g)),
sums AS (SELECT id, bit_xor(x) AS x FROM bytes JOIN shares USING (b, zeros) GROUP BY id),
h AS (SELECT run, c, xor(xor(sums.x, shares.x), 4294967295) AS h FROM g JOIN sums USING (id) JOIN shares ON shares.b = 4294967295 AND shares.zeros = length(hx) // 2),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h) GROUP BY word HAVING length(word) >= 6 AND sum(c) >= 5),
gaps AS MATERIALIZED (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 2) AS z FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
shorter AS (SELECT DISTINCT gaps.word AS x, v.word AS y FROM gaps JOIN v ON v.word = a || z),
near AS MATERIALIZED (SELECT p.word AS x, q.word AS y FROM gaps p JOIN gaps q USING (i, a, z) WHERE p.word <> q.word UNION SELECT x, y FROM shorter UNION SELECT y, x FROM shorter),
best AS (SELECT x AS word, count(*) AS n_near, max(n) AS near_n, min(y) FILTER (WHERE n = top) AS near FROM (SELECT x, y, n, max(n) OVER (PARTITION BY x) AS top FROM near JOIN v ON v.word = y) GROUP BY x),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS at FROM f UNION ALL SELECT s.word, f.form FROM steps s JOIN f ON f.word = s.at AND f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM f JOIN steps s ON s.word = f.word JOIN f last ON last.word = s.at AND last.form IS NULL
"""
}
