"""A toxicity classifier that does not react to which group a text mentions.

A logistic model over the distinct words of a text, their stems, and the stems that two of its
words share, hashed to a fixed number of weights and kept sparse by FTRL-proximal updates with an L1 term.
Labelled texts that name an identity are also seen with their identity terms swapped for
others of the same kind, and the squared change of the score is penalised; what only tells
one group from another thus gets no weight, and neutral mentions stay below the threshold.

Scores are calibrated on labelled rows that the scoring model did not learn from, so that 0.7 means what it says.

Learning takes a bounded sample of labelled rows (``ROWS_PER_CLASS`` of each label, the first
by a hash of doc_id); scoring reads every row's whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS_PER_CLASS = 3_000
BITS = 18
WORD = re.compile(r"\w+")
CACHE = 300_000  # words whose features a task remembers at a time
#: Terms of one kind, which may stand for each other in a counterfactual text.
IDENTITIES = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("women", "men", "girls", "boys", "females", "males"),
    ("immigrant", "refugee", "foreigner", "migrant"),
    ("immigrants", "refugees", "foreigners", "migrants"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle", "transsexuelle"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("frau", "mann", "mädchen", "junge"),
    ("frauen", "männer", "jungen"),
    ("flüchtlinge", "einwanderer", "ausländer", "migranten"),
    ("blinde", "gehörlose", "behinderte", "autisten"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels", "transgenres"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("femme", "homme", "fille", "garçon"),
    ("femmes", "hommes", "filles", "garçons"),
    ("réfugiés", "immigrés", "étrangers"),
    ("aveugles", "sourds", "handicapés", "autistes"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales", "transexuales"),
    ("negros", "asiáticos", "árabes", "africanos", "europeos"),
    ("mujer", "hombre", "chica", "chico"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("refugiados", "inmigrantes", "extranjeros", "migrantes"),
    ("ciegos", "sordos", "discapacitados"),
)


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, its stems of 4 to 8 letters, and two of them with its length."""
    mask, n = (1 << BITS) - 1, len(word)
    names = [word + "$", *(word[:i] for i in range(4, min(9, n))), *(f"{word[:i]}#{n}" for i in (4, 6) if i < n)]
    return [zlib.crc32(x.encode()) & mask for x in names]


def twice(features: np.ndarray) -> np.ndarray:
    """The features that say that two distinct words of a text share a feature."""
    return ((features.astype(np.int64) + 1) * 2654435765) & ((1 << BITS) - 1)


def text_features(words: set[str]) -> np.ndarray:
    """The features of the distinct words of a text, and those that two of them share."""
    found, times = np.unique(np.array([f for w in words for f in set(word_features(w))], np.int64), return_counts=True)
    return np.unique(np.r_[found, twice(found[times > 1])]).astype(np.int32)


def swapped(words: set[str], identities) -> set[str] | None:
    """The words with each identity term replaced by another of its kind, chosen by the number of words; None where there is none."""
    to = {t: kind[(i + 1 + len(words) % (len(kind) - 1)) % len(kind)] for kind in identities for i, t in enumerate(kind)}
    return {to.get(w, w) for w in words} if not to.keys().isdisjoint(words) else None


def fit(rows: list[tuple[np.ndarray, np.ndarray | None, int]], strength: float = 1.0, l1: float = 8.0, l2: float = 1.0, rate: float = 0.3, passes: int = 8, seed: int = 5) -> tuple[float, np.ndarray]:
    """(bias, weights) from rows of features, counterfactual features or None, and a 0/1 label."""
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0

    def weights(at):
        s = z[at]
        return np.where(np.abs(s) > l1, (np.sign(s) * l1 - s) / ((1.0 + np.sqrt(n[at])) / rate + l2), 0.0)

    def step(at, w, g):
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate * w
        n[at] += g * g

    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            x, swap, y = rows[i]
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            step(x, w, g)
            bias -= 0.1 * g / np.sqrt(bias_n)
            bias_n += g * g
            if swap is not None and strength:
                only, other = np.setdiff1d(x, swap, True), np.setdiff1d(swap, x, True)
                wo, ws = weights(only), weights(other)
                apart = strength * (wo.sum() - ws.sum())
                step(only, wo, apart)
                step(other, ws, -apart)
    return float(bias), weights(np.arange(1 << BITS))


def calibrated(rows: list[tuple[np.ndarray, np.ndarray | None, int]], folds: int = 3, **settings) -> tuple[float, np.ndarray]:
    """The model of ``fit`` with its scores made probabilities: slope and offset by a logistic fit of scores of rows that it did not learn from.

    The penalties keep weights small, so that scores of toxic rows with few known words lie below their share of toxic rows.  Each of ``folds``
    parts of ``rows`` is scored by a model of the others.  With fewer than ten rows of a label the scores stay as they are.
    """
    bias, weights = fit(rows, **settings)
    y = np.array([r[2] for r in rows], float)
    if min(y.sum(), len(y) - y.sum()) < 10:
        return bias, weights
    x = np.empty(len(rows))
    for k in range(folds):
        b, w = fit([r for i, r in enumerate(rows) if i % folds != k], **settings)
        x[k::folds] = [b + w[r[0]].sum() for r in rows[k::folds]]
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's steps; a slight pull towards slope 1 keeps separable scores finite
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -35, 35)))
        v = p * (1 - p) + 1e-9
        down = np.array([((p - y) * x).sum() + 0.1 * (slope - 1), (p - y).sum()])
        slope, offset = np.array([slope, offset]) - np.linalg.solve([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum()]], down)
    return (bias * slope + offset, weights * slope) if slope > 0 else (bias, weights)


def train(docs: DataFrame, labels: DataFrame, identities=IDENTITIES, **settings) -> tuple[float, np.ndarray]:
    """A model from the labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); null labels and ids are left out.

    Label rows repeated as a whole count once; a document labelled both ways is seen both ways; one that ``docs`` repeats is seen as often.  What comes to
    the driver is bounded by ``ROWS_PER_CLASS`` and how often a labelled doc_id repeats, a few numbers for each distinct word.  Without labelled
    rows every score is a half.
    """
    from pyspark.sql import Window

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall((text or "").lower()))
                other = swapped(words, identities)
                for col, v in zip(out, (toxic, text_features(words), None if other is None else text_features(other))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int32()))], ["toxic", "x", "swap"])

    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    some = [known.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(ROWS_PER_CLASS).select("doc_id", "toxic") for y in (0, 1)]
    known = some[0].unionByName(some[1]).distinct()
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("toxic", "text").mapInArrow(features, "toxic int, x array<int>, swap array<int>").toArrow()
    x, swap = (_views(rows[c]) for c in ("x", "swap"))  # no number becomes a Python object
    ready = list(zip(x, swap, rows["toxic"].to_pylist()))
    ready.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
    return calibrated(ready, **settings)


def _views(column: pa.ChunkedArray) -> list[np.ndarray | None]:
    """The lists of a column as slices of its own buffer; None for null."""
    out: list[np.ndarray | None] = []
    for chunk in column.chunks:
        ends, values = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [None if null else values[a:b] for null, a, b in zip(chunk.is_null().to_pylist(), ends, ends[1:])]
    return out


def score(docs: DataFrame, model: tuple[float, np.ndarray], *keep: str) -> DataFrame:
    """``score`` (0 to 1) of each row's whole text beside its columns ``keep``; a null text has no words.

    Rows are scored one by one, repeated ones too; a column to keep may not be called ``score``; an empty table gives no rows.
    """
    if "score" in keep:
        raise ValueError("a column to keep is called score")
    held = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = held.value
        shared = weights[twice(np.arange(len(weights)))]
        matters = (weights != 0) | (shared != 0)
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            logits = np.empty(len(batch))
            for i, text in enumerate(batch.column(0)):
                times: dict[int, int] = {}
                for w in set(WORD.findall((text.as_py() or "").lower())):
                    found = seen.get(w)
                    if found is None:
                        if len(seen) >= CACHE:
                            seen.clear()
                        found = seen[w] = tuple(f for f in set(word_features(w)) if matters[f])
                    for f in found:
                        times[f] = times.get(f, 0) + 1
                active = np.array(sorted(times), np.int64)
                both = twice(np.array(sorted(f for f, n in times.items() if n > 1), np.int64))
                logits[i] = bias + float(weights[np.union1d(active, both)].sum()) if times else bias
            scores = 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*batch.schema.names[1:], "score"])

    rows = docs.select(F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(of, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]] + ["score double"]))


def held_out():
    """True where crc32 of the doc_id as text leaves 1 by 3; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, scored by a model of the labelled rows that are not held out.

    Empty and null texts get the score of a text without known words; a null doc_id is not held out.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(docs, labels.where(~held_out())), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
