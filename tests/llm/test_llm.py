"""Each dealt operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import chat, metric_join, mixing, pieces, quality, sharding, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, cid long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One  TWO"), (5, "▁ a  b "), (6, "x " * 30000), (7, "###!! " * 60)]
    for g in range(4):
        base = [word() for _ in range(60)]
        for _ in range(6):
            text = base[:]
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(60)] = word()
            out.append((100 + len(out), " ".join(text)))
    out.append(out[10])
    out.append((None, "no id here at all"))
    return [(i, t, "hot" if n % 3 else None, 7) for n, (i, t) in enumerate(out)]


def shingle_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def joined_by_brute_force(texts):
    """(set, number of the component, links) of each text."""
    sets = [shingle_set(t) for t in texts]
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    kinds = {x for x in sets if x}
    links = {a: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in kinds) for a in kinds}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                comp[root(i)] = root(j)
    return [(x, root(i), links.get(x, 0)) for i, x in enumerate(sets)]


def check_join(spark, data):
    ids = {}
    found = joined_by_brute_force([r[1] for r in data])
    for r, (_, c, _) in zip(data, found):
        if r[0] is not None:
            ids[c] = min(r[0], ids.get(c, r[0]))
    want = sorted(str((r[0], len(x), ids.get(c) if x else r[0], n)) for r, (x, c, n) in zip(data, found))
    got = metric_join.jaccard_join(spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.n_links)) for r in got) == want
    return found


def test_metric_join(spark, rows):
    check_join(spark, rows)
    assert metric_join.jaccard_join(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("small", [{"REGION_ROWS": 2}, {"REGION_ROWS": 2, "LEAF_CLASSES": 4, "PACK_ROWS": 3, "FANOUT": 3}, {"LEAF_SHINGLES": 300}])
def test_metric_join_cuts_large_cells(spark, monkeypatch, small):
    """Dense groups, chains of near copies and loose groups in one cell, with every limit so low that it is met."""
    rng = random.Random(5)
    base = ["w%d" % i for i in range(80)]
    data = [(1, None), (2, "one two"), (3, "One  TWO")]
    for i in range(20):  # two groups, in which all link
        text = base[:] if i < 15 else ["v" + w for w in base]
        text[rng.randrange(80)] = "x%d" % rng.randrange(1000)
        data.append((1000 + i, " ".join(text)))
    text = base[:]
    for i in range(25):  # a chain whose ends have nothing in common
        data.append((2000 + i, " ".join(text)))
        text[(3 * i) % 80] = "y%d" % i
    for name, value in small.items():
        monkeypatch.setattr(metric_join, name, value)
    found = check_join(spark, data)
    assert len({n for *_, n in found}) > 4


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_without_structural_collisions(spark, n):
    """Polynomial hashes modulo 2**64 take these two words for one."""
    a, b = thue_morse(n), thue_morse(n, 1)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{a}\n{a}"), (5, f"p q {a} p q {b}")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in metric_join.jaccard_join(docs).collect()}
    assert got == {i: (i, 0) for i in range(1, 6)}
    lines = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality.text_counts(docs, "doc_id").collect()}
    assert lines == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0), 5: (0, 0)}


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 90
    pages = [(1, None, None), (2, "u", "short"), (3, "u\nv", "short"), (4, "u", long), (5, "u", long), (None, None, long), (6, "u", "\r\n\r\n<" + long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(df), str(tmp_path / "a"))
    got = {r.page_id: r for r in warc.digests(warc.read_archives(spark, str(tmp_path / "a"))).withColumnRenamed("id", "page_id").collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("revisit", 4), None: ("revisit", 4), 6: ("response", None)}
    for i, _, html in pages:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].digest) == (len(data), hashlib.sha256(data).hexdigest())
    warc.write_archives(warc.plan_records(df.limit(0)), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_warc_repeated_ids(spark, tmp_path):
    a, b = "a" * 200, "b" * 300
    pages = [(1, a), (1, b), (2, a), (3, b), (3, b), (1, a)]
    df = spark.createDataFrame([(i, "u", h, "x", 1) for i, h in pages], "page_id long, url string, html string, digest string, salt int")
    warc.write_archives(warc.plan_records(df), str(tmp_path / "a"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(str((i, len(h), sha(h), "response" if i == 1 else "revisit", None if i == 1 else 1)) for i, h in pages)
    assert rows_of(warc.digests(warc.read_archives(spark, str(tmp_path / "a"))), "id", "payload_bytes", "digest", "record_type", "refers_to") == want


def test_warc_records_by_the_standard(spark, tmp_path):
    """Decompressed as a plain stream: each record has the fields that WARC/1.1 asks for, a name of its own, and the response that it refers to."""
    import zstandard

    data = [(1, "http://a/", "x" * 150), (2, "http://b/", "x" * 150), (2, "http://b/", "x" * 150), (3, None, None), (None, "http://c/", "y" * 120)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(df).coalesce(1), str(tmp_path / "a"), "2024-01-31T12:00:00Z")
    raw = next(f for f in (tmp_path / "a").iterdir() if f.name.startswith("part")).read_bytes()
    at, records = 0, []
    size = int.from_bytes(raw[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    frames = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw[8 + size :], read_across_frames=True).read()
    while at < len(frames):
        end = frames.index(b"\r\n\r\n", at)
        version, *lines = frames[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        block = frames[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 4 + len(block)
        assert version == "WARC/1.1" and frames[at : at + 4] == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n")
        assert {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"} <= set(fields) and fields["WARC-Date"] == "2024-01-31T12:00:00Z"
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
        records.append(fields)
        at += 4
    assert len({r["WARC-Record-ID"] for r in records}) == len(records) == len(data)
    first = next(r for r in records if r["X-Page"] == "1")
    assert [r["WARC-Refers-To"] for r in records if r["WARC-Type"] == "revisit"] == [first["WARC-Record-ID"]] * 2


def test_warc_archives_are_bounded(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    data = [(i, "u", "".join(rng.choice("abcdefghij") for _ in range(3000))) for i in range(400)] + [(1000, "u", "z" * 2_000_000)]
    for name, value in (("ROW_BYTES", 20_000), ("ARCHIVE_ROWS", 3), ("SAMPLE_BYTES", 10_000)):
        monkeypatch.setattr(warc, name, value)
    df = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.plan_records(df).coalesce(1), str(tmp_path / "a"))
    files = [f for f in (tmp_path / "a").iterdir() if f.name.startswith("part")]
    assert len(files) > 5 and max(f.stat().st_size for f in files) < 32_768 + 3 * 24_000
    got = warc.read_archives(spark, str(tmp_path / "a"))
    assert rows_of(got, "id", "payload") == sorted(str((i, h.encode())) for i, _, h in data)


def test_tokens(spark, rows):
    import sentencepiece

    path = pieces.model_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(rows, DOCS)
    ids = {t: model.encode(t or "") for _, t, *_ in rows}
    want = sorted(str((i, len((t or "").encode()), len(ids[t]), len(ids[t]) > 100)) for i, t, *_ in rows)
    named = df.withColumns({"row": F.lit(1), "n": F.lit(2), "pre_token": F.lit("x")})
    assert rows_of(pieces.token_counts(named, path, 100), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(str((i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(model.decode(ids[t])))) for i, t, *_ in rows)
    assert sorted(str(tuple(r)) for r in pieces.encoded_digests(df, path).collect()) == want
    assert sorted(str((r.doc_id, r.ids)) for r in pieces.encode(df, path).collect()) == sorted(str((i, ids[t])) for i, t, *_ in rows)


def test_quality_counts_and_rules(spark, rows):
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality.text_counts(spark.createDataFrame(rows, DOCS), "doc_id").collect())
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want.append(str((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))))
    assert got == sorted(want)
    rng = np.random.default_rng(1)
    x = {f: rng.random(2000) for f in quality.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["mark_share"] > 0.6))
    rules = quality.learn(x, bad)
    hit = np.any([r.holds(x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.97
    assert quality.learned_rules(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int")) == []


def test_quality_verdicts_by_brute_force(spark, rows):
    rules = [quality.Rule((("symbol_share", True, 0.5),), 1.0), quality.Rule((("upper_share", False, 0.1), ("chars_per_word", True, 1.5)), 1.0)]
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept, r.rule) for r in quality.judge(spark.createDataFrame(rows, DOCS).withColumn("text_", F.lit(1)), rules, "doc_id", "text_").collect()}
    want = set()
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        repeat = len({k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in range(3)})
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        chars, letters = sum(map(len, w)), len(re.findall("[A-Za-z]", t))
        first = len(re.findall(r"[#*$%&|<>]", t)) / max(1, chars) > 0.5
        second = len(re.findall("[A-Z]", t)) / max(1, letters) <= 0.1 and chars / max(1, len(w)) > 1.5
        want.add((i, len(w), failed, not failed and not first and not second, 1 if first else 2 if second else None))
    assert got == want
    assert quality.judge(spark.createDataFrame([], DOCS), rules, "doc_id").count() == 0
    with pytest.raises(ValueError):
        quality.text_counts(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit(1)), "n_words")


def test_quality_rules_hold_out_of_sample(spark):
    """Learned on labelled rows whose id isn't divisible by 3, right on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learned_rules(docs, labels.where("doc_id % 3 <> 0"))
    judged = quality.judge(docs, rules, "doc_id").join(labels.where("doc_id % 3 = 0 AND quality IS NOT NULL"), "doc_id").collect()
    rejected = [r.quality for r in judged if r.rule]
    bad = sum(r.quality == 0 for r in judged)
    assert bad > 100 and sum(rejected) <= 0.02 * len(rejected) and rejected.count(0) >= 0.9 * bad


def test_toxicity_query_by_a_plain_model(spark, tmp_path):
    """Scores, held-out rows, the 0.7 rule and recall, against the same model run over Python sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(1.0).alias("score_")).unionByName(spark.createDataFrame([(-1, None, 1.0), (-2, "", 1.0), (None, "x", 1.0)], "doc_id long, text string, score_ double"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op4_toxicity(spark, str(tmp_path)).collect()
    texts, marks = {r.doc_id: r.text or "" for r in docs.collect()}, {(r.doc_id, r.toxic) for r in labels.collect() if r.toxic is not None and r.doc_id is not None}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    seen = []
    for i, y in marks:
        if not held(i) and i in texts:
            other = toxicity.swapped(words(texts[i]), toxicity.IDENTITIES)
            seen.append((toxicity.text_features(words(texts[i])), None if other is None else toxicity.text_features(other), y))
    seen.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
    bias, weights = toxicity.calibrated(seen)
    assert len(got) == len(texts)
    for r in got:
        found = toxicity.text_features(words(texts[r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(bias + weights[found].sum()))), abs=1e-4)
        assert r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.7)


def test_toxicity_recall_on_labels_held_out(spark):
    """At least nine of ten toxic documents caught that were not learned from, at most one in 500 clean ones wrong."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    judged = toxicity.op4_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    caught = [r.predicted for r in judged if r.toxic == 1]
    wrong = [r.predicted for r in judged if r.toxic == 0]
    assert len(caught) > 100 and sum(caught) >= 0.9 * len(caught)
    assert len(wrong) > 1000 and sum(wrong) <= 0.002 * len(wrong)
    print("caught", sum(caught), len(caught), "wrong", sum(wrong), len(wrong))


def test_calibration_by_a_plain_fit():
    """The slope and offset are those that make the log loss of the scores of rows left out least."""
    rng = random.Random(9)
    data = []
    for i in range(240):
        toxic = i % 4 == 0
        words = {"w%d" % rng.randrange(200) for _ in range(12)} | ({rng.choice(("idiot", "scum", "loser"))} if rng.random() < (0.85 if toxic else 0.05) else set())
        data.append((toxicity.text_features(words), None, int(toxic)))
    (b0, w0), (b1, w1) = toxicity.fit(data), toxicity.calibrated(data)
    some = np.flatnonzero(w0)
    slope = float(np.median(w1[some] / w0[some]))
    offset = b1 - slope * b0
    assert np.allclose(w1, slope * w0) and slope > 0
    x, y = np.empty(len(data)), np.array([r[2] for r in data])
    for k in range(3):
        b, w = toxicity.fit([r for i, r in enumerate(data) if i % 3 != k])
        x[k::3] = [b + w[r[0]].sum() for r in data[k::3]]
    loss = lambda a, c: np.logaddexp(0, np.where(y == 1, -1, 1) * (a * x + c)).sum() + 0.05 * (a - 1) ** 2
    assert all(loss(slope, offset) <= loss(slope + da, offset + dc) + 1e-9 for da in (-0.01, 0, 0.01) for dc in (-0.01, 0, 0.01))


def test_toxicity_leaves_neutral_mentions_alone():
    """A group that toxic texts name more often: held-out clean texts that mention it stay clean with the penalty, and not all without."""
    rng = random.Random(4)

    def text(toxic):
        words = {"w%d" % rng.randrange(400) for _ in range(25)} | ({rng.choice(("idiot", "scum"))} if toxic else set())
        return words | ({rng.choice(("muslim", "frauen", "juifs", "mujeres"))} if rng.random() < (0.9 if toxic else 0.02) else set())

    data = []
    for i in range(900):
        words = text(i % 3 == 0)
        other = toxicity.swapped(words, toxicity.IDENTITIES)
        data.append((toxicity.text_features(words), None if other is None else toxicity.text_features(other), int(i % 3 == 0)))
    wrong = {}
    for strength in (0.0, 1.0):
        bias, weights = toxicity.fit(data, strength=strength)
        says = lambda words: 1 / (1 + math.exp(-(bias + weights[toxicity.text_features(words)].sum())))  # noqa: B023, E731
        wrong[strength] = sum(says({"w%d" % rng.randrange(400) for _ in range(25)} | {"muslim", "frauen"}) >= 0.7 for _ in range(200))
        assert sum(says({"w%d" % rng.randrange(400) for _ in range(25)} | {"idiot"}) >= 0.7 for _ in range(200)) > 190
    assert wrong[1.0] == 0 < wrong[0.0]


def test_toxicity_identity_swap(spark, rows):
    rng = random.Random(2)
    texts = [["w%d" % rng.randrange(300) for _ in range(20)] for _ in range(600)]
    data = []
    for i, words in enumerate(texts):
        toxic = i % 3 == 0
        if toxic:
            words = words + ["idiot"]
        if rng.random() < (0.8 if toxic else 0.1):  # a group that toxic texts name more often
            words = words + ["muslim"]
        words = set(words)
        other = toxicity.swapped(words, toxicity.IDENTITIES)
        data.append((toxicity.text_features(words), None if other is None else toxicity.text_features(other), int(toxic)))

    def says(model, words):
        return 1 / (1 + math.exp(-(model[0] + model[1][toxicity.text_features(set(words))].sum())))

    plain, fair = toxicity.fit(data, strength=0.0), toxicity.fit(data)
    neutral = ["w1", "w2", "muslim"]
    assert says(fair, neutral) < says(plain, neutral) and says(fair, neutral) < 0.5 < says(fair, ["w1", "idiot"])
    assert all(0 <= r.score <= 1 for r in toxicity.score(spark.createDataFrame(rows, DOCS), fair, "doc_id").collect())


def test_mixing(spark, rows):
    for shares in ({"a": 500, **{f"s{i:02}": 10 for i in range(50)}}, {"a": 900, "b": 100}, {"x": 333, "y": 333, "z": 334}):
        total, seen = sum(shares.values()), Counter()
        for s, j, release, deadline, slot in mixing.frame_slots(shares):
            assert release <= slot < deadline
            seen[s] += 1
            assert all(abs(seen[k] - shares[k] * (slot + 1) / total) < 1 for k in shares)
    got = mixing.mix(spark.createDataFrame(rows, DOCS), block_docs=2).collect()
    assert len(got) == len(rows) and len({r.mix_seq for r in got}) == len(rows)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert sum(mixing.shares_by_size({"s%04d" % i: 1 for i in range(1500)}).values()) == 1500


def test_mixing_places_by_brute_force(spark):
    """Names of the operator's own, a source called like the null one, and places counted again in Python."""
    kind = "doc_id long, text string, source string, name string, key int, bucket int, row int, block int, slot string, mix_slot int"
    data = [(i, "t%d" % i, (None, "null", "(none)", "a")[i % 4], "n", 1, 2, 3, 4, "s", 9) for i in range(90)] + [(None, "x", "a", "n", 1, 2, 3, 4, "s", 9), (5, "t5", "null", "n", 1, 2, 3, 4, "s", 9)]
    shares = {None: 1, "null": 2, "a": 5}
    got = mixing.mix(spark.createDataFrame(data, kind), shares, block_docs=3).collect()
    assert sorted(str(tuple(r)[:9]) for r in got) == sorted(str(r[:9]) for r in data)
    frame = {(s, j): slot for s, j, _, _, slot in mixing.frame_slots({mixing.source_key(s): w for s, w in shares.items()})}
    for source in (None, "null", "(none)", "a"):
        mine = sorted((hashlib.md5((("text:" + r[1]) if r[0] is None else str(r[0])).encode()).hexdigest(), n) for n, r in enumerate(data) if r[2] == source)
        places = []
        for rank in range(len(mine)):
            block, w = rank // 3, shares.get(source)
            slot = (1 << 52) + block if w is None else block // w * 8 + frame[(mixing.source_key(source), block % w)]
            places.append((block, slot, slot * 3 + rank % 3))
        assert sorted((r.mix_block, r.mix_slot, r.mix_seq) for r in got if r.mix_source == source and r.source == source) == places


def rows_of(df, *cols):
    return sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


def test_sharding(spark, rows, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame(rows, DOCS)
    for _ in range(3):
        table.append(df.repartition(3))
    before = table.version
    after = table.compact()
    assert after == before + 1 and table.shards().count() < table.shards(before).count()
    want = sorted(str((r[0], r[1])) for r in rows * 3)
    assert rows_of(table.read(), "doc_id", "text") == rows_of(table.read(before), "doc_id", "text") == want
    again = sharding.ShardedTable(spark, str(tmp_path / "t"))
    assert again.version == after and rows_of(again.read(), "doc_id", "text") == want


def test_sharding_two_writers(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, DOCS)
    one = sharding.ShardedTable(spark, str(tmp_path / "t"))
    one.append(df)
    two = sharding.ShardedTable(spark, str(tmp_path / "t"))
    one.append(df)
    with pytest.raises(sharding.CommitConflict):
        two.append(df)
    assert two.version == 1 and two.read().count() == len(rows)  # what it has open stays as it is
    two = sharding.ShardedTable(spark, str(tmp_path / "t"))
    assert two.append(df) == 3 and two.read().count() == 3 * len(rows)


def test_sharding_lost_job(spark, rows, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame(rows, DOCS)
    table.append(df)
    with pytest.raises(Exception):
        table.append(df.withColumn("text", F.raise_error(F.lit("lost")).cast("string")))
    assert table.version == 1 and sharding.ShardedTable(spark, str(tmp_path / "t")).version == 1
    assert table.append(df) == 2 and table.read().count() == 2 * len(rows)


def test_sharding_names_and_empty_tables(spark, tmp_path):
    kind = "doc_id long, shard string, run int, _run int, _arrival string, `_metadata` string, text string"
    data = [(i, "s", i % 3, 5, "a", "m", "t%d" % i) for i in range(20)]
    df = spark.createDataFrame(data, kind)
    table = sharding.ShardedTable(spark, str(tmp_path / "t"))
    table.append(df, F.col("run"))
    assert table.compact() == 2
    assert table.read().columns == df.columns and sorted(tuple(r) for r in table.read().collect()) == data
    none = sharding.ShardedTable(spark, str(tmp_path / "none"))
    for arrival in (None, F.col("run")):
        none.append(df.limit(0), arrival)
    assert none.compact() == 2 and none.read().count() == 0 and none.read().columns == df.columns


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, 0, "user", "a\\n<|b"), (1, 1, "user", None), (1, 2, "assistant", said), (1, 3, "assistant", "\\<\\|x\n"), (2, 0, None, "q"), (2, 0, None, "q"), (None, None, "as\nsistant<|", "é")]
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in (1, 2, None):
        mine = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(mine), sha("".join(f"{r}\n{t}\n" for r, t in mine)))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))


def test_chat_sorts_ties_by_what_was_said(spark):
    turns = [(1, 0, "user", x) for x in ("\\\\", "]", "<|", "<}", "\\")]
    got = chat.digest(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)))).collect()
    assert got[0].turns_sha256 == hashlib.sha256("".join(f"user\n{t}\n" for t in sorted(x[3] for x in turns)).encode()).hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def best_by_brute_force(v, step, k):
    fine = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x in v if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    want = []
    for i in sorted({i for i, _ in fine if i % step == 0}):
        scores = sorted((-int(x @ y), j) for n, x in fine if n == i for j, y in fine if j != i and len(x) == len(y))[:k]
        want += [(i, r, j, -score) for r, (score, j) in enumerate(scores, 1)]
    return sorted(want)


@pytest.mark.parametrize("block,queries", [(8192, 16384), (40, 3)])
def test_topk(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", queries)
    rng = np.random.default_rng(0)
    v = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(200)] + [(200, None), (201, [float("nan")] * 8), (202, [1.0, None] * 4), (None, [0.0] * 8), (203, [1.0]), (240, [0.5])]
    v += [v[0], v[7], (300, v[0][1]), (301, v[0][1]), (400, [0.0] * 8), (40, v[3][1])]
    q = topk.quantised(spark.createDataFrame([(*x, 1) for x in v], "vec_id long, embedding array<double>, rank int"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(q, q.where("vec_id % 20 = 0"), 5).collect())
    assert got == best_by_brute_force(v, 20, 5)
    assert topk.top_k(q.limit(0), q).count() == 0 == topk.top_k(q, q.limit(0)).count()


def test_topk_multiplies_less_than_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(8192, 64))
    v = np.floor(64 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    df = spark.createDataFrame([(64, 0, i, x.tolist()) for i, x in enumerate(v)], "d int, vb long, vec_id long, q array<long>")
    index = topk.build_index(df).toArrow()
    sizes = [np.abs(np.array(x)) for x in index["impacts"].to_pylist() if x]
    assert all(a.min() >= b.max() for a, b in zip(sizes, sizes[1:]))
    found, made = topk.search(index, v[:256], np.arange(256), np.full(256, -np.inf), 20)
    assert len(found) == 256 * 20 and made < 0.9 * 256 * v.size
    for i in (0, 255):
        best = sorted((-int(v[i] @ v[j]), j) for j in range(8192) if j != i)[:20]
        assert [(x, j) for n, j, x in found if n == i] == [(-s, j) for s, j in best]
    floor = np.array([min(x for n, _, x in found if n == i) for i in range(256)], float)
    again, fewer = topk.search(index, v[:256], np.arange(256), floor, 20)
    assert again == found and fewer < made
    print("multiplications, of brute force:", made / (256 * v.size), fewer / (256 * v.size))


def test_metric_join_is_linear_in_rows_without_ids(spark, monkeypatch):
    """Each class fetches the text of its own first row, not those of all rows without an id."""
    seen = spark.sparkContext.accumulator(0)
    whole = metric_join._whole

    def counted(k):
        run = whole(k)

        def of(batches):
            for batch in batches:
                seen.add(len(batch))
                yield from run([batch])

        return of

    monkeypatch.setattr(metric_join, "_whole", counted)
    rng = random.Random(7)
    data = []
    for _ in range(200):
        base = ["w%d" % rng.randrange(5000) for _ in range(60)]
        data += [(None, " ".join(base)), (None, " ".join([*base[:-1], "x"]))]
    data += [(5, "one id with " + " ".join("v%d" % rng.randrange(5000) for _ in range(40))) for _ in range(50)]
    got = metric_join.jaccard_join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sum(r.n_links for r in got) == 400 and len(got) == 450
    assert seen.value <= len(data)
