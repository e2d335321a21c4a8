"""Spelling variants, files of token ids and fill-in-middle against brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import idfiles, infill, spelling
from galena.llm.pieces import model_path

DOCS = "doc_id long, text string, word string, n long"


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def forms(counts, ratio=5):
    """word -> (form, root, n, n_near, form_n), from every pair."""
    found, form = defaultdict(list), {}
    for a in counts:
        for b in counts:
            if a != b and near(a, b):
                found[a].append(b)
    for w in counts:
        best = min(found[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(found[w]), counts.get(form.get(w))) for w, n in counts.items()}


def told(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("alphabet,most", [("ab", 4096), ("ab", 3), ("abé", 8), ("aβ漢𝒳", 4096)])
def test_forms_by_brute_force(spark, alphabet, most):
    """Dense groups, ties, and groups so small a limit that they are dealt again down to single places."""
    rng = random.Random(len(alphabet) + most)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))): rng.choice((5, 5, 25, 125, 626, 4000)) for _ in range(220)}
    words = spark.createDataFrame([*counts.items()], "word string, n long")
    assert told(spelling.variants(words, most=most)) == forms(counts)


def test_long_chains_of_forms(spark):
    counts = {"b" * i + "a" * (12 - i): 5**i for i in range(1, 12)}
    got = told(spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got == forms(counts) and {r[1] for r in got.values()} == {"b" * 11 + "a"}


def test_forms_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert spelling.variants(spelling.word_counts(none)).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, 3), ("", 3), ("abcdef", 5)], "word string, n long")).count() == 1


def counted(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return counts


def test_counts_of_whole_texts(spark):
    rng = random.Random(9)
    words = ["Straße", "ÉCOLE×x", "naïveté", "hundred", "HUNDRED", "a", "short", "sevenly"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice((",", "", "7", "ā")) for _ in range(60))) for i in range(150)]
    rows += [(None, "hundred hundreds"), (1, None), (2, ""), (3, "hundred " * 40_000), rows[5], rows[5]]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)).collect()}
    assert got == {w: n for w, n in counted(rows).items() if len(w) >= 6}
    assert any(len(w) == 6 for w in got if w not in {x.lower() for x in words})


def test_spelling_query_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    counts = {w: n for w, n in counted(docs).items() if len(w) >= 6 and n >= 5}
    assert told(spelling.op11_spelling(spark, "/root/testdata/sf0.001")) == forms(counts)


@pytest.mark.parametrize("top", [1, 255, 256, 65_536, 1 << 24, (1 << 32) - 1])
def test_codes_of_all_lengths(top):
    rng = np.random.default_rng(top % 1000)
    docs = [rng.integers(0, top, n, endpoint=True).astype(np.uint32) for n in (0, 1, 2, 3, 4, 5, 0, 1000, 1)]
    sizes = np.array([len(d) for d in docs])
    control, data = (np.frombuffer(x, np.uint8) for x in idfiles.code(np.concatenate(docs), sizes))
    got = idfiles.decode(control, data, sizes)
    assert got.tolist() == np.concatenate(docs).tolist()
    assert len(data) == sum(1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF) for v in got.tolist())
    assert len(control) == sum(-(-len(d) // 4) for d in docs)


def texts_with_traps():
    rng = random.Random(6)
    traps = ["<|endoftext|>", "<|startoftext|>x", "́e", "é", "É", "ﬁ", " ", " ", "\x1c", "\x85", "it's", "'ll", "1234", "¡hola!", "ΣΑΣ", "İ", "漢字", "🙂", "​", "\n\n", "\t", "\r\n", " "]
    return ["".join(rng.choice(traps) + rng.choice((" ", "", "a", "Bc")) for _ in range(rng.randint(0, 40))) for _ in range(150)]


@pytest.mark.parametrize("width", [2, 4])
def test_files_of_ids_by_the_library(spark, tmp_path, monkeypatch, width):
    from tokenizers import Tokenizer

    monkeypatch.setattr(idfiles, "BLOCK_IDS", 400)
    monkeypatch.setattr(idfiles, "FILE_BLOCKS", 2)
    path = model_path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    data = [(3 * i % 200, t) for i, t in enumerate(texts_with_traps())] + [(None, "no name"), (None, None), (7, ""), (7, None), (9, "word " * 3000), (9, "word " * 3000), (-5, "x")]
    df = spark.createDataFrame([(*r, "w", 1) for r in data], DOCS)
    idfiles.write(idfiles.encode(df.repartition(3), path, 2, width), str(tmp_path / "a"), width)
    ids = {t: model.encode(t or "", add_special_tokens=False).ids + [2] for _, t in data}
    assert sorted((str(r.doc_id), r.ids) for r in idfiles.read(spark, str(tmp_path / "a")).collect()) == sorted((str(i), ids[t]) for i, t in data)
    rows = sorted(idfiles.index(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()  # no two begin at one place, as each has its end
    names = [float("-inf") if r.doc_id is None else r.doc_id for r in rows]
    assert names == sorted(names)
    crc = lambda x: zlib.crc32(struct.pack("<%dI" % len(x), *x))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(i), len(ids[t]), crc(ids[t])) for i, t in data)
    assert len([f for f in (tmp_path / "a" / "ids").iterdir() if f.name.startswith("part")]) > 4


def test_quick_chunks_by_the_library():
    from tokenizers import Tokenizer

    path = model_path("word_bpe_49k.json")
    model, chunks = Tokenizer.from_file(path), idfiles._Chunks(path, 2)
    assert chunks.quick
    rng = random.Random(8)
    letters = "abcXYZ" + idfiles.LATIN + idfiles.LATIN.upper().replace("SS", "ß")
    for _ in range(4000):
        chunk = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) + "".join(rng.choice("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'7é<|") for _ in range(rng.randint(0, 4)))
        assert np.frombuffer(chunks[chunk], "<u2").tolist() == model.encode(chunk, add_special_tokens=False).ids, chunk
    with pytest.raises(OverflowError):
        chunks.bytes([1 << 16])


def test_files_of_no_ids_and_damage(spark, tmp_path):
    path = model_path("word_bpe_49k.json")
    none = spark.createDataFrame([], DOCS)
    idfiles.write(idfiles.encode(none, path, 2), str(tmp_path / "a"))
    assert idfiles.index(spark, str(tmp_path / "a")).count() == 0 == idfiles.read(spark, str(tmp_path / "a")).count()
    idfiles.write(idfiles.encode(spark.createDataFrame([(1, "a b c", "", 1), (2, "", "", 1)], DOCS), path), str(tmp_path / "b"))
    assert sorted((r.doc_id, len(r.ids)) for r in idfiles.read(spark, str(tmp_path / "b")).collect()) == [(1, 3), (2, 0)]
    for f in (tmp_path / "b" / "ids").iterdir():
        if f.name.startswith("part"):
            raw = bytearray(f.read_bytes())
            raw[-2] ^= 1
            f.write_bytes(raw)
    for f in (tmp_path / "b" / "ids").glob(".*.crc"):
        f.unlink()
    with pytest.raises(Exception, match="damaged"):
        idfiles.read(spark, str(tmp_path / "b")).collect()


def infilled(name, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if name is None else name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 16])
def test_infill_by_brute_force(spark, monkeypatch, size):
    """Frames down to one unit, so that markers and cuts fall on every kind of border."""
    monkeypatch.setattr(infill, "FRAME_UNITS", size)
    rng = random.Random(size)
    data = [(i, "".join(rng.choice("<>PSM<SPé🙂\n ") for _ in range(rng.randint(0, 50)))) for i in range(250)]
    data = [(i, re.sub("<[PSM]>", "", t) if i % 5 else t) for i, t in data] + [(None, "a<S"), (None, None), (4, ""), (5, "<P>"), data[3], (600, "long ́" * (3000 if size > 7 else 30))]
    kept = infill.store(spark.createDataFrame([(*r, "w", 1) for r in data], DOCS))
    outputs = infill.fill_in_middle(kept)
    want = [(i, *infilled(i, t), t or "") for i, t in data]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(str, map(tuple, infill.digests(outputs).collect()))) == sorted(str((i, n, f, p, m, sha(o), sha(t))) for i, n, f, p, m, o, t in want)
    assert sorted(str((r.doc_id, r.output)) for r in infill.texts(outputs).collect()) == sorted(str((w[0], w[5])) for w in want)
    assert sorted(str((r.doc_id, r.text)) for r in infill.rebuild(outputs).collect()) == sorted(str((w[0], w[6])) for w in want)
    assert infill.digests(infill.fill_in_middle(infill.store(spark.createDataFrame([], DOCS)))).count() == 0


def test_infill_decompresses_only_cut_frames(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(40 * infill.FRAME_UNITS + 9))
    press, unpress = infill._codec()
    frames = [press.compress(text[i : i + infill.FRAME_UNITS].encode()) for i in range(0, len(text), infill.FRAME_UNITS)]
    seen = []

    class Counted(infill._Seekable):
        def whole(self, i):
            seen.append(i)
            return super().whole(i)

    stored = Counted([*range(0, len(text), infill.FRAME_UNITS), len(text)], frames, unpress)
    out = infill._Writer(press)
    a, b = 5 * infill.FRAME_UNITS + 10, 30 * infill.FRAME_UNITS + 20
    for mark, lo, hi in (("<P>", 0, a), ("<S>", b, len(text)), ("<M>", a, b)):
        out.text(mark)
        stored.copy(lo, hi, out)
    units, made = out.done()
    assert set(seen) == {5, 30, 40} and len(set(made) & set(frames)) == 38
    assert b"".join(map(unpress.decompress, made)).decode() == f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    assert units[-1] == len(text) + 9 and max(np.diff(units)) <= infill.FRAME_UNITS + 3
