"""Fill-in-middle transformation over texts stored as seekable compressed frames.

A stored text is a list of independent Zstandard frames, ``FRAME_UNITS`` code points each, with
the cumulative number of units before every frame.  The two places where a text is cut lie in at most two
frames: only these are decompressed, cut and compressed again; whole frames of the prefix, the
suffix and the middle go into the output as they are, and the output is a stored text as well.
Digests, and the text rebuilt from an output, stream frames in order, one decompressed at a time.
A frame of the output may be shorter than ``FRAME_UNITS`` but is never longer than that and a marker.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import cut

FRAME_UNITS = 1 << 16
LEVEL = 7  # of compression: both the stored texts and the outputs lie on disk for a while
BATCH_BYTES = 4 << 20  # of frames given out at a time
MARKS = ("<P>", "<S>", "<M>")  # fixed values: before the prefix, the suffix and the middle
_STORED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("plain", pa.bool_()), ("units", pa.list_(pa.int64())), ("frames", pa.list_(pa.binary()))])
_OUTPUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("units", pa.list_(pa.int64())), ("frames", pa.list_(pa.binary()))])
STORED = "doc_id long, n long, plain boolean, units array<long>, frames array<binary>"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, units array<long>, frames array<binary>"


def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


class _Writer:
    """Frames one after the other, with the units before each and at the end."""

    def __init__(self, press):
        self.press, self.units, self.frames, self.held = press, [0], [], ""

    def frame(self, units: int, frame: bytes) -> None:
        self.flush()
        self._add(units, frame)

    def text(self, text: str) -> None:
        self.held += text
        while len(self.held) > FRAME_UNITS + 3:
            self._add(FRAME_UNITS, self.press.compress(self.held[:FRAME_UNITS].encode()))
            self.held = self.held[FRAME_UNITS:]

    def flush(self) -> None:
        if self.held:
            self._add(len(self.held), self.press.compress(self.held.encode()))
            self.held = ""

    def _add(self, units: int, frame: bytes) -> None:
        self.units.append(self.units[-1] + units)
        self.frames.append(frame)

    def done(self) -> tuple[list[int], list[bytes]]:
        self.flush()
        return self.units, self.frames


class _Seekable:
    """A stored text, read by ranges of units."""

    def __init__(self, units: list[int], frames: list[bytes], unpress):
        self.units, self.frames, self.unpress = units, frames, unpress

    def whole(self, i: int) -> str:
        return self.unpress.decompress(self.frames[i]).decode()

    def covering(self, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(frame, first unit inside, end unit inside) of the frames that [lo, hi) touches."""
        if lo >= hi:
            return
        for i in range(bisect_right(self.units, lo) - 1, len(self.frames)):
            start, end = self.units[i], self.units[i + 1]
            if start >= hi:
                return
            yield i, max(lo, start) - start, min(hi, end) - start

    def texts(self, lo: int, hi: int) -> Iterator[str]:
        for i, a, b in self.covering(lo, hi):
            text = self.whole(i)
            yield text if b - a == len(text) else text[a:b]

    def copy(self, lo: int, hi: int, out: _Writer) -> None:
        """[lo, hi) to ``out``: whole frames as they are, only cut ones (and ends that are joined to a marker) decompressed."""
        for i, a, b in self.covering(lo, hi):
            size = self.units[i + 1] - self.units[i]
            if b - a == size and size >= FRAME_UNITS // 2:
                out.frame(size, self.frames[i])
            else:
                out.text(self.whole(i)[a:b])


def _given(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    rows.clear()
    return out


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n, plain, units, frames) of each row of (doc_id, text); plain: the text is empty or holds a marker.

    A null text is empty; rows are stored one by one, repeated and null doc_ids too; other columns are not read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, _ = _codec()
        rows: list[list] = []
        held = 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                frames = [press.compress(text[i : i + FRAME_UNITS].encode()) for i in range(0, len(text), FRAME_UNITS)]
                units = [*range(0, len(text), FRAME_UNITS), len(text)]
                rows.append([name.as_py(), len(text), not text or any(m in text for m in MARKS), units, frames])
                held += sum(map(len, frames)) + 64
                if held >= BATCH_BYTES:
                    yield _given(rows, _STORED)
                    held = 0
        if rows:
            yield _given(rows, _STORED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, STORED)


def choose(n: int, name: int | None, seed: int, plain_from: int, spm_below: int) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text of ``n`` units without markers."""
    digest = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "plain" if h3 % 100 >= plain_from else "spm" if h4 % 100 < spm_below else "psm", a, b


def fill_in_middle(stored: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, units, frames) of each stored text: its output, stored likewise.

    psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, plain the text itself.
    The form and the cuts follow from ``seed`` and doc_id (a null one counts as an empty name), so repeated rows are cut alike.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = _codec()
        rows: list[list] = []
        held = 0
        for batch in batches:
            for row in zip(*batch.columns):
                name, n, plain, units, frames = (x.as_py() for x in row)
                form, a, b = ("plain", 0, 0) if plain else choose(n, name, seed, plain_from, spm_below)
                if form == "plain":
                    rows.append([name, n, form, None, None, units, frames])
                else:
                    text, out = _Seekable(units, frames, unpress), _Writer(press)
                    prefix, suffix, middle = ((MARKS[0], 0, a), (MARKS[1], b, n), (MARKS[2], a, b))
                    for mark, lo, hi in ((prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle)):
                        out.text(mark)
                        text.copy(lo, hi, out)
                    rows.append([name, n, form, a, b - a, *out.done()])
                held += sum(map(len, frames)) + 64
                if held >= BATCH_BYTES:
                    yield _given(rows, _OUTPUT)
                    held = 0
        if rows:
            yield _given(rows, _OUTPUT)

    return stored.select("doc_id", "n", "plain", "units", "frames").mapInArrow(of, OUTPUT)


def _places(output: _Seekable, form: str, see) -> list[int]:
    """Units at which the markers of an output begin, found in one pass over its frames; ``see`` gets each frame's text."""
    order = (MARKS[0], MARKS[1], MARKS[2]) if form == "psm" else (MARKS[1], MARKS[0], MARKS[2])
    places: list[int] = []
    tail, start = "", 0  # the last two units before this frame
    for i in range(len(output.frames)):
        text = output.whole(i)
        see(text)
        if form != "plain":
            window, at = tail + text, 0
            while len(places) < 3 and (found := window.find(order[len(places)], at)) >= 0:
                places.append(start - len(tail) + found)
                at = found + 3
            start += len(text)
            tail = window[max(at, len(window) - 2) :]
    if form != "plain" and (len(places) < 3 or places[0]):
        raise ValueError("an output lacks a marker")
    return places


def restored(output: _Seekable, form: str, places: list[int]) -> Iterator[str]:
    """The text that an output was made of, in parts."""
    end = output.units[-1]
    if form == "plain":
        yield from output.texts(0, end)
        return
    one, two, three = places
    first, second, middle = (one + 3, two), (two + 3, three), (three + 3, end)
    for lo, hi in (first, middle, second) if form == "psm" else (second, middle, first):
        yield from output.texts(lo, hi)


def rebuild(outputs: DataFrame) -> DataFrame:
    """(doc_id, text) rebuilt from each output and its form."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpress = _codec()
        for batch in batches:
            for name, form, units, frames in zip(*batch.columns):
                output = _Seekable(units.as_py(), frames.as_py(), unpress)
                text = "".join(restored(output, form.as_py(), _places(output, form.as_py(), len)))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.int64()), pa.array([text], pa.string())], ["doc_id", "text"])

    return outputs.select("doc_id", "form", "units", "frames").mapInArrow(of, "doc_id long, text string")


def texts(outputs: DataFrame) -> DataFrame:
    """(doc_id, form, output) of each output, as a string."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpress = _codec()
        for batch in batches:
            for name, form, frames in zip(*batch.columns):
                text = b"".join(map(unpress.decompress, frames.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.int64()), pa.array([form.as_py()]), pa.array([text.decode()])], ["doc_id", "form", "output"])

    return outputs.select("doc_id", "form", "frames").mapInArrow(of, "doc_id long, form string, output string")


def digests(outputs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of each output and of the text rebuilt from it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpress = _codec()
        for batch in batches:
            out, back = [], []
            for form, units, frames in zip(*batch.columns[5:]):
                output, form = _Seekable(units.as_py(), frames.as_py(), unpress), form.as_py()
                one, two = hashlib.sha256(), hashlib.sha256()
                places = _places(output, form, lambda text: one.update(text.encode()))  # noqa: B023
                for text in restored(output, form, places):
                    two.update(text.encode())
                out.append(one.hexdigest())
                back.append(two.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.string()), pa.array(back, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    rows = outputs.select(*kept, F.col("form").alias("form_"), "units", "frames")
    return rows.mapInArrow(of, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` stored as frames, transformed, and rebuilt from the outputs."""
    stored = cut(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return digests(cut(fill_in_middle(stored)))


QUERIES = {"op13_infill": op13_infill}
ORACLES = {
    "op13_infill": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS p, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS q FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1, n - b) || '<M>' || substring(t, a + 1, b - a)
              ELSE '<S>' || substring(t, b + 1, n - b) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
}
