"""What a stage of the pipeline decides shows in the rows of the last one."""

import random

import pytest

import corpus_pipeline
from galena.llm import mixing


def test_mixture_shows_in_the_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "text %d" % i, "en", "ab"[i % 2], 6) for i in range(200)] + [(None, "no id", "en", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    mix, found = mixing.mix, []
    for shares in ({"a": 9, "b": 1}, {"a": 1, "b": 9}):
        monkeypatch.setattr(corpus_pipeline.mixing, "mix", lambda d, shares=shares: mix(d, shares))
        rows = corpus_pipeline.encoded(spark, corpus_pipeline.mixed(spark, docs, ""), "").collect()
        place = {r.doc_id: (r.mix_slot, r.mix_seq) for r in rows}
        assert place == {r.doc_id: (r.mix_slot, r.mix_seq) for r in mix(docs, shares).collect()}
        assert len(rows) == len(place) == 201
        found.append(place)
    assert found[0] != found[1]


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents of all kinds and labels of some."""
    rng = random.Random(8)
    prose = lambda n, stem="w": " ".join("%s%d" % (stem, rng.randrange(900)) for _ in range(n))
    rows = [(i, prose(80), "en", "ab"[i % 2], 1) for i in range(60)]
    rows += [(100 + i, prose(70) + " idiot scum trash", "en", "a", 1) for i in range(40)]
    rows += [(200 + i, prose(40) + " #$ %& #### ||| <><>" * 12, "en", None, 1) for i in range(40)]
    base = prose(100, "v")
    rows += [(300 + i, base + " end%d" % i, "en", "b", 1) for i in range(6)]
    rows += [(301, rows[0][1], "en", "b", 1), (None, rows[1][1], None, None, None), (None, prose(60), "en", "c", 1), rows[2], rows[2]]
    rows += [(7, prose(60, "other"), "en", "a", 1), (400, None, None, None, None), (401, "", "en", "a", 0), (402, " \n\t", "en", "a", 3), (403, "x " * 40000, "en", "a", 80000)]
    labels = [(r[0], int(not 200 <= r[0] < 240), int(100 <= r[0] < 140)) for r in rows if r[0] is not None and r[0] < 240 and r[0] % 4] + [(None, 0, 1), (1, None, None)]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, KIND).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows


def key(rows):
    return sorted(map(str, rows))


def test_quality_stage(spark, corpus):
    where, rows = corpus
    kept = [tuple(r) for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, KIND), where).collect()]
    long_enough = [r for r in rows if len((r[1] or "").split()) >= 50]
    assert set(map(str, kept)) <= set(map(str, long_enough))
    assert not [r for r in kept if r[0] is not None and 200 <= r[0] < 240] and len([r for r in kept if r[0] is not None and r[0] < 60]) >= 60
    assert kept.count(rows[2]) == 3  # rows repeated as a whole are judged one by one


def test_toxicity_stage(spark, corpus):
    where, rows = corpus
    kept = [tuple(r) for r in corpus_pipeline.toxic(spark, spark.createDataFrame(rows, KIND), where).collect()]
    assert key(kept) == key(r for r in rows if r[0] is None or not 100 <= r[0] < 140)


def test_near_duplicate_stage(spark, corpus):
    where, rows = corpus
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, KIND), where).collect()]
    gone = [(None, rows[1][1], None, None, None), (301, rows[0][1], "en", "b", 1), rows[2], rows[2]] + [r for r in rows if r[0] is not None and 301 <= r[0] < 306 and r[1].startswith("v")]
    want = list(rows)
    for r in gone:
        want.remove(r)
    assert key(kept) == key(want)  # both texts of document 7 stay, and so do all documents without words
    assert corpus_pipeline.near_duplicates(spark, spark.createDataFrame([], KIND), where).count() == 0


def test_mixing_and_encoding_stages(spark, corpus):
    where, rows = corpus
    mixed = corpus_pipeline.mixed(spark, spark.createDataFrame(rows, KIND), where)
    assert mixed.columns == [*corpus_pipeline.DOCUMENT, *corpus_pipeline.PLACE]
    assert key(tuple(r)[:5] for r in mixed.collect()) == key(rows)
    got = corpus_pipeline.encoded(spark, mixed, where).collect()
    assert len(got) == len(rows) and all((r.n_tokens == 0) == (not next(x[1] for x in rows if x[0] == r.doc_id)) for r in got if r.doc_id is not None and r.doc_id >= 400)


def test_run_by_its_stages(spark, corpus):
    where, rows = corpus
    docs = spark.createDataFrame(rows, KIND)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, where).collect() or [], stage(spark, docs, where).schema)
    assert key(tuple(r) for r in corpus_pipeline.run(spark, where).collect()) == key(tuple(r) for r in docs.collect())
