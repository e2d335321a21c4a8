"""Long texts that share a few words by chance, and odd sketches against the sets themselves."""

import random

import numpy as np
import pyarrow as pa
import pytest

from galena.llm import bytewords, metric_join


def _texts(rng, n, words):
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def test_long_texts_with_a_line_in_common_are_not_connected(spark, monkeypatch):
    rng = random.Random(5)
    texts = [f"{t} one line that all of them hold" for t in _texts(rng, 24, 4000)]
    texts += [texts[0] + " end", "a b"]
    met, cells = [], metric_join._cells
    monkeypatch.setattr(metric_join, "_cells", lambda *a: (c := cells(*a), met.extend(r.cid for r in c.collect()))[0])
    # a sketch of one cell has the common line's shingles in the prefixes of some
    monkeypatch.setattr(metric_join, "SKETCH_BITS", 1)
    got = metric_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {i: (0 if i == 24 else i, int(i in (0, 24))) for i in range(26)}
    assert len(met) == 2, "texts that are nearly all different were connected"


@pytest.mark.parametrize("rows", [1, 60])
def test_regions_connect_all_that_link(rows):
    rng = random.Random(rows)
    base = [_texts(rng, 1, rng.choice([5, 40, 300, 340, 420, 1500]))[0].split() for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.02 else "x" for w in rng.choice(base)[: rng.choice([None, -3, -30])]) for _ in range(rows * 3)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    at, found = bytewords.shingles(data, offsets, 5)
    n = np.bincount(at, minlength=len(texts)).astype(np.int64)
    sets = [set(found[at == i].tolist()) for i in range(len(texts))]
    region = np.array([rng.randrange(2) for _ in texts])
    table = pa.table({"region": region, "cid": np.arange(len(texts)) * 7, "n": n, "rank": np.zeros(len(texts), np.int64), "odd": metric_join._odd(at, found, n)})
    got = metric_join._near(4, 5)(table)
    root = {i * 7: i * 7 for i in range(len(texts))} | dict(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if region[i] == region[j] and x and y and 5 * len(x & y) >= 4 * len(x | y):
                assert root[i * 7] == root[j * 7]
