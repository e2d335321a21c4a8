"""Templates of log lines by a tree that is learned first and matched again afterwards.

Lines with their numbers masked are counted, so that everything below works on distinct lines.

* **Tree.** Root, number of words, first word, leaf; below a node are the ``children - 1`` first words with most lines (then by
  name), and one child ``<*>`` for all others and for masked words.
* **Leaves.** In order of (n falling, text) a line joins the template of its leaf that agrees in most words (then with most
  wildcards, then the earliest), if these are at least ``similarity`` of all; words that differ become ``<*>``, which agrees with nothing.
  Else the line is a new template.  A leaf with more than ``part_lines`` distinct lines is learned in parts, dealt by content; the
  templates of the parts are then learned once more as lines, so that no task sees a whole hot leaf.  Leaves of one part are
  learned twice where their lines are.
* **Matching.** Every line gets, of the templates of its length that fit it word by word, the one with fewest
  wildcards, then most lines, then first by name.  A line that is a template itself is its own, as no other fits with as few
  wildcards; that is told in the leaf.  The others meet the templates with wildcards whose first own word they have at its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.shared import fresh_path, freed_shuffles
from ..plans.sized import small
from .selection import template

WILD = "<*>"
LEAF = ["length", "child"]


def masked(line: Column) -> Column:
    """A line with its numbers masked and one space between its words."""
    line = template(line)
    return F.when(line.rlike(r"[\t\n\x0B\f\r]|  "), F.regexp_replace(line, r"\s+", " ")).otherwise(line)


def masked_lines(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, template, n) of each distinct masked line of (key, line); blank lines don't count."""
    rows = lines.where(F.trim("line") != "").withColumn("template", masked(F.trim("line")))
    return rows.groupBy(*key, "template").agg(F.count("*").alias("n"))


def _words(line: str) -> Column:
    return F.split(line, " ")


def _placed(rows: DataFrame, line: str = "template") -> DataFrame:
    return rows.withColumns({"length": F.size(_words(line)), "first": F.substring_index(line, " ", 1)})


def in_tree(rows: DataFrame, key: list[str], children: int = 100, part_lines: int = 4096) -> DataFrame:
    """``rows`` (key, template, n) with the length and the child of their leaf, and in how many parts that is learned.

    Lines are not shuffled: they meet the words of nodes that have more than children, and the leaves of several parts.
    """
    rows = _placed(rows)
    order = Window.partitionBy(*key, "length").orderBy(F.col("first") == WILD, F.desc("of"), F.asc("first"))
    firsts = rows.groupBy(*key, "length", "first").agg(F.sum("n").alias("of"), F.count("*").alias("lines")).withColumn("place", F.row_number().over(order))
    firsts = stored(firsts.withColumn("child", F.when((F.col("first") != WILD) & (F.col("place") < children), F.col("first")).otherwise(WILD)), "firsts")
    full = firsts.groupBy(*key, "length").agg(F.max((F.col("first") != WILD) & (F.col("child") == WILD)).alias("full"), F.collect_list(F.when(F.col("child") != WILD, F.col("first"))).alias("own")).where("full").drop("full")
    parts = firsts.groupBy(*key, *LEAF).agg(F.ceil(F.sum("lines") / part_lines).alias("parts")).where("parts > 1")
    child = F.when((F.col("first") == WILD) | ~F.coalesce(F.array_contains("own", F.col("first")), F.lit(True)), WILD).otherwise(F.col("first"))
    rows = rows.join(small(stored(full, "nodes")), [*key, "length"], "left").withColumn("child", child).drop("first", "own")
    return rows.join(small(stored(parts, "parts")), [*key, *LEAF], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _learn(lines: list[tuple[list[str], int]], similarity: float) -> list[tuple[list[str], int]]:
    """Templates, with how many lines each stands for, of lines of one length in order."""
    size, count = len(lines[0][0]), 0
    ids: list[dict[str, int]] = [{} for _ in range(size)]  # of the words that were seen at a place; 0 is a wildcard
    held = np.zeros((size, 16), np.int32)
    wild, n, first = np.zeros(16, np.int64), [], []
    for line, of in lines:
        seen = [(j, i) for j, w in enumerate(line) if w != WILD and (i := ids[j].get(w))]
        # words that are new at their place agree with nothing
        if count and len(seen) >= similarity * size:
            same = np.zeros(count, np.int32)
            for j, i in seen:
                same += held[j, :count] == i
            most = int(same.max())
            if most >= similarity * size:
                ties = np.flatnonzero(same == most)
                best = int(ties[np.argmax(wild[ties])])
                row = np.zeros(size, np.int32)
                for j, i in seen:
                    row[j] = i
                held[held[:, best] != row, best] = 0
                wild[best] = int((held[:, best] == 0).sum())
                n[best] += of
                continue
        if count == held.shape[1]:
            held, wild = np.concatenate([held, np.zeros_like(held)], axis=1), np.concatenate([wild, np.zeros_like(wild)])
        for j, w in enumerate(line):
            if w != WILD:
                held[j, count] = ids[j].setdefault(w, len(ids[j]) + 1)
        wild[count] = sum(w == WILD for w in line)
        n.append(of)
        first.append(line)
        count += 1
    # a template keeps words of its first line or has wildcards
    return [([w if i else WILD for w, i in zip(first[k], held[:, k])], n[k]) for k in range(count)]


def _again(lines: dict[str, int], similarity: float) -> dict[str, int]:
    """The templates of ``lines`` (line: n), with how many lines each stands for; equal ones are one."""
    out: dict[str, int] = {}
    for t, n in _learn([(line.split(" "), n) for line, n in sorted(lines.items(), key=lambda x: (-x[1], x[0]))], similarity):
        out[" ".join(t)] = out.get(" ".join(t), 0) + n
    return out


def _settled(lines: dict[str, int], similarity: float) -> list[tuple]:
    """(template, n, of): lines of a leaf of one part, with the count of their own template where they are one, and its other templates without n."""
    found = lines if len(lines) == 1 else _again(_again(lines, similarity), similarity)
    return [(line, n, found.get(line)) for line, n in lines.items()] + [(t, None, of) for t, of in found.items() if t not in lines]


def _templates(lines: dict[str, int], similarity: float) -> list[tuple]:
    return [(t, None, of) for t, of in _again(lines, similarity).items()]


def learned(rows: DataFrame, group: list[str], similarity: float, told=_templates) -> DataFrame:
    """(group, template, n, of): what ``told`` says of each group of ``rows`` (group, template, n), whose lines have one length; of equal lines the counts are added."""
    keys = [F.col(c).cast("string") for c in group]
    kinds = rows.select(*group)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, lines = None, {}

        def close() -> None:
            out.extend((now, *r) for r in told(lines, similarity))

        def give() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)
            out.clear()
            return done

        for batch in batches:
            for one, line, n in zip(*(c.to_pylist() for c in batch.columns)):
                if one != now:
                    if lines:
                        close()
                        if len(out) > 10_000:
                            yield give()
                    now, lines = one, {}
                lines[line] = lines.get(line, 0) + n
        if lines:
            close()
        if out:
            yield give()

    from pyspark.sql.pandas.types import to_arrow_type

    struct = kinds.schema
    schema = pa.schema([("key", to_arrow_type(struct)), ("template", pa.string()), ("n", pa.int64()), ("of", pa.int64())])
    leaf = F.xxhash64(*(F.coalesce(k, F.lit("null")) for k in keys))
    dealt = rows.select(F.struct(*group).alias("key"), "template", "n", leaf.alias("leaf_")).repartition("leaf_").sortWithinPartitions("leaf_", "key")
    return dealt.drop("leaf_").mapInArrow(of, f"key {struct.simpleString()}, template string, n long, of long").select("key.*", "template", "n", "of")


def mined(rows: DataFrame, key: list[str], similarity: float = 0.4, children: int = 100, part_lines: int = 4096) -> DataFrame:
    """(key, template, n, of): the distinct masked ``rows`` (key, template, n), with the count of the template where a row is one, and the templates that are no row, without n."""
    dealt = in_tree(rows, key, children, part_lines)
    settled = learned(dealt.where("parts = 1"), [*key, *LEAF], similarity, _settled).select(*key, "template", "n", "of")
    large = dealt.where("parts > 1")
    part = F.conv(F.substring(F.md5("template"), 1, 8), 16, 10).cast("long") % F.col("parts")
    once = learned(large.withColumn("part", part), [*key, *LEAF, "part"], similarity).withColumn("n", F.col("of"))
    found = learned(once, [*key, *LEAF], similarity).select(*key, "template", "of")
    return settled.unionByName(large.select(*key, "template", "n").join(found, [*key, "template"], "full").select(*key, "template", "n", "of"))


def matched(rows: DataFrame, offered: DataFrame, key: list[str]) -> DataFrame:
    """(key, template, n, leader): each of ``rows`` (id, key, template, n) with the best of ``offered`` (key, template, of) that fits it; null if none."""
    words = _words("template")
    # the first place that is no wildcard, or none
    place = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) != WILD), F.lit(0)), F.lit(-1))
    offered = offered.select(*key, F.size(words).alias("length"), place.alias("place"), "of", F.col("template").alias("leader")).withColumn("word", F.coalesce(F.get(_words("leader"), F.col("place")), F.lit("")))
    places = offered.groupBy(*key, "length").agg(F.collect_set("place").alias("places"))
    asked = rows.select("id", *key, "template").withColumn("length", F.size(words)).join(places, [*key, "length"])
    asked = asked.withColumn("place", F.explode("places")).drop("places").withColumn("word", F.coalesce(F.get(words, F.col("place")), F.lit("")))
    fits = F.forall(F.zip_with(_words("template"), _words("leader"), lambda a, b: (a == b) | (b == WILD)), lambda x: x)
    wilds = F.size(F.filter(_words("leader"), lambda w: w == WILD))
    met = asked.join(offered, [*key, "length", "place", "word"]).where(fits)
    best = met.groupBy("id").agg(F.min(F.struct(wilds.alias("w"), (-F.col("of")).alias("o"), "leader")).alias("l"))
    return rows.join(best, "id", "left").select(*key, "template", "n", F.col("l.leader").alias("leader"))


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once and read again, however often what follows asks for it."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def line_templates(lines: DataFrame, key: list[str], similarity: float = 0.4, children: int = 100, part_lines: int = 4096) -> DataFrame:
    """(key, template, n, leader): every distinct masked line of (key, line), how often it comes, and its template.

    All lines are read, in groups of equal ``key``, whose columns must not be null.  The result does not depend on the order of lines.
    Distinct lines, and lines with their templates, are written below ``spark.checkpoint.dir``, once each; words are cut from the text where they are used, not shuffled beside it.
    """
    rows = stored(masked_lines(lines, key), "lines")
    told = stored(mined(rows, key, similarity, children, part_lines), "templates")
    left = stored(told.where("of IS NULL").withColumn("id", F.monotonically_increasing_id()).drop("of"), "left")
    own = told.where("n IS NOT NULL AND of IS NOT NULL").select(*key, "template", "n", F.col("template").alias("leader"))
    return own.unionByName(matched(left, told.where(F.col("of").isNotNull() & F.col("template").contains(WILD)), key))
