"""Quality rules as a learned decision list.

Counts of each whole text are taken once (vectorised over its bytes).  From the counts of
labelled documents, sequential covering learns an ordered list of rules that reject: grow a
conjunction of thresholds by information gain on two thirds of the rows, prune it on the
other third, keep it while it is precise there, take away what it covers, go on.  The list
becomes one Spark conditional expression, which is all that scoring runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bytewords as B

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_letters"]
#: Quotients that rules may put thresholds on.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "mark_share": ("n_marks", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
}
LABELLED_ROWS = 20_000  # the rules are learned from so many labelled rows at most, the first by a hash of doc_id


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [batch.column(i) for i in range(1, batch.num_columns)]
        for lo, hi, data, offsets in B.slices(batch.column(0)):
            rows = hi - lo
            starts, ends, row = B.runs(data, offsets, B.SPACE)
            inside = lambda flag: np.diff(np.r_[0, np.cumsum(flag, dtype=np.int64)][offsets])
            words = np.bincount(row, minlength=rows)
            out = {
                "n_words": words,
                "word_chars": inside(~B.SPACE[data] & ((data & 0xC0) != 0x80)),
                "n_symbols": inside(SYMBOLS[data]),
                "n_upper": inside((data >= 65) & (data <= 90)),
                "n_letters": inside(((data | 32) >= 97) & ((data | 32) <= 122)),
                "n_marks": inside((data == 33) | (data == 63)),
            }
            # words in three-word windows that the text has twice
            repeat = np.zeros(rows, np.int64)
            found, at = B.windows(B.hashes(data, starts, ends), row, 3) if len(starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if len(found):
                place = np.flatnonzero(row[:-2] == row[2:])
                twice = _repeated(found, at)
                covered = np.zeros(len(starts), bool)
                for j in range(3):
                    covered[place[twice] + j] = True
                repeat = np.bincount(row[covered], minlength=rows)
            # lines with a word that equal an earlier line
            line, stop, of = B.runs(data, offsets, _LINE_FEED)
            wordy = np.searchsorted(starts, stop) > np.searchsorted(starts, line)
            line, stop, of = line[wordy], stop[wordy], of[wordy]
            dup = np.zeros(rows, np.int64)
            if len(line):
                order = np.lexsort((B.hashes(data, line, stop), of))
                key = B.hashes(data, line, stop)[order]
                same = np.r_[False, (key[1:] == key[:-1]) & (of[order][1:] == of[order][:-1])]
                dup = np.bincount(of[order][same], minlength=rows)
            out |= {"n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": np.bincount(of, minlength=rows)}
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, rows) for c in rest), *(pa.array(out[c], pa.int64()) for c in COUNTS)], [*batch.schema.names[1:], *COUNTS])


_LINE_FEED = np.zeros(256, bool)
_LINE_FEED[10] = True


def _repeated(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which entries have an equal in their group."""
    order = np.lexsort((key, group))
    same = (key[order][1:] == key[order][:-1]) & (group[order][1:] == group[order][:-1])
    out = np.zeros(len(key), bool)
    out[order] = np.r_[False, same] | np.r_[same, False]
    return out


def text_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts of each row's whole text beside its columns ``keep``; a null text has none of anything.

    Rows are counted one by one, repeated ones too; an empty table gives no rows; a column to keep may not be named like a count.
    """
    if set(keep) & {*COUNTS, "base_failed", "kept", "rule"}:
        raise ValueError("a column to keep has the name of a result column")
    rows = docs.select(F.col("text").cast("string").alias("text"), *keep)
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]] + [f"{c} long" for c in COUNTS])
    return rows.mapInArrow(_counts, kinds)


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, is_above, threshold) holds."""

    terms: tuple[tuple[str, bool, float], ...]
    precision: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, above, t in self.terms:
            out &= (x[f] > t) if above else (x[f] <= t)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            out &= (feature(f) > t) if above else (feature(f) <= t)
        return out


def feature(name: str) -> Column:
    above, below = FEATURES[name]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, support: int = 5, most_rules: int = 12, most_terms: int = 3, tries: int = 4, least_checked: int = 3, seed: int = 7) -> list[Rule]:
    """A decision list for ``bad``.  Ties go to the earlier feature, then the smaller threshold.

    A rule must be precise on all rows it covers and on at least ``least_checked`` of the third that it was not grown on.
    """
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    failed = 0
    while len(rules) < most_rules and failed < tries and bad[left].sum() >= support:
        grow = left & (rng.random(len(bad)) < 2 / 3)
        prune = left & ~grow
        terms: list[tuple[str, bool, float]] = []
        covered = grow.copy()
        while len(terms) < most_terms and covered.any() and not bad[covered].all():
            best = _best_term(x, bad, covered)
            if best is None:
                break
            terms.append(best)
            covered &= Rule((best,), 0).holds(x)

        def worth(ts: tuple) -> float:
            hit = Rule(ts, 0).holds(x) & prune
            p, n = (bad & hit).sum(), (~bad & hit).sum()
            return (p - n) / max(1, p + n)

        kept = max((tuple(terms[:i]) for i in range(1, len(terms) + 1)), key=lambda ts: (worth(ts), -len(ts)), default=())
        hit = Rule(kept, 0).holds(x) & left
        got, checked = bad[hit].mean() if hit.any() else 0.0, hit & prune
        if not kept or hit.sum() < support or got < precision or checked.sum() < least_checked or bad[checked].mean() < precision:
            failed += 1  # another split may show a rule that holds on both parts
            continue
        rules.append(Rule(kept, float(got)))
        left &= ~hit
    return rules


def _best_term(x, bad, covered):
    p0, n0 = bad[covered].sum(), (~bad[covered]).sum()
    if not p0:
        return None
    before, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
    for f in FEATURES:
        v, y = x[f][covered], bad[covered]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        below = np.cumsum(y)[cuts], cuts + 1
        for above in (True, False):
            p = p0 - below[0] if above else below[0]
            size = len(v) - below[1] if above else below[1]
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(p > 0, p * (np.log2(p / size) - before), 0)
            if len(g) and g.max() > gain:
                i = int(g.argmax())
                gain, best = g[i], (f, above, float((v[cuts[i]] + v[cuts[i] + 1]) / 2))
    return best


def learned_rules(docs: DataFrame, labels: DataFrame, **settings) -> list[Rule]:
    """Rules from the labelled rows of ``docs``; labels are (doc_id, quality), null qualities and ids are left out.

    Repeated label rows count as often as they come, contradicting ones on both sides; without labelled rows there are no rules.
    """
    y = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h"), (F.col("quality") == 0).alias("bad")).orderBy("h", "doc_id", "bad").limit(LABELLED_ROWS)
    t = text_counts(docs.join(y, "doc_id"), "bad").select("bad", *(feature(f).alias(f) for f in FEATURES)).toArrow()
    x = {f: t[f].to_numpy() for f in FEATURES}
    order = np.lexsort([*x.values(), t["bad"].to_numpy()]) if len(t) else slice(0)
    return learn({f: v[order] for f, v in x.items()}, t["bad"].to_numpy()[order], **settings) if len(t) else []


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the rule that decides) of rows with the counts; the first rule that holds rejects."""
    kept, number = F.lit(True), F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        kept = F.when(rule.column(), F.lit(False)).otherwise(kept)
        number = F.when(rule.column(), F.lit(i)).otherwise(number)
    return kept, number


def judge(docs: DataFrame, rules: list[Rule], *keep: str, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """The counts, base_failed, kept and the deciding rule's number of each row."""
    counted = text_counts(docs, *keep)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    kept, number = verdict(rules)
    return counted.withColumn("base_failed", failed).withColumns({"kept": ~failed & kept, "rule": number})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, judged by the base limits and by rules learned from ``labels.quality``.

    A null text has no words and fails the base; a null doc_id stays null; rows are judged one by one.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = judge(docs, learned_rules(docs, labels), "doc_id")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
