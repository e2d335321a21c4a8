"""Token ids in files of byte-aligned variable-length codes with separate control bytes.

* **Ranks.** Ids are replaced by their rank in the corpus, the most frequent first, so that most take
  one byte.  The table of frequencies lies beside the files; its size is that of the vocabulary.
* **Codes.** Two control bits give the bytes (1 to 4) of a rank; four of them make a control byte.  The control
  bytes of all documents of a block come first, then the rank bytes, low byte first.  A reader takes
  the four lengths of each control byte from a table of 256 rows, their running sum gives the
  places, and numpy gathers all ranks of a block at once.
* **Files.** Spark sorts documents by doc_id (a range shuffle of ids in two bytes each, if the vocabulary allows); each
  partition is a file or several, of blocks of about ``BLOCK_IDS`` ids, at most ``FILE_BLOCKS`` each.  Spark's text writer puts
  the blocks out as they are, a line feed after each, through its commit protocol.

Block, little-endian: ``GID1``, crc32 of the rest, documents, control bytes, rank bytes (each 64 bits), then the doc_ids
(64 bits each), a byte for each that is null, the numbers of ids (64 bits each), control bytes, rank bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .pieces import model_path
from .storage import cut, fresh_path, release

HEAD = struct.Struct("<4sIQQQ")
MAGIC = b"GID1"
BLOCK_IDS, BLOCK_DOCS, FILE_BLOCKS = 1 << 20, 1 << 16, 64  # a document with more ids is a block of its own
CHUNK_TABLE = 800_000  # distinct chunks that a task holds while it encodes
TEXT_BYTES = 4 << 20  # of texts encoded at a time
VOCABULARY = 1 << 22  # ids that the rank table may hold
BIG = sys.byteorder == "big"
_BITS = np.arange(256, dtype=np.uint16)
LENGTHS = np.stack([(_BITS >> (2 * k) & 3) + 1 for k in range(4)], 1).astype(np.uint8)  # of each control byte


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of parts of about TEXT_BYTES; a null text is empty."""
    texts = batch.column(column).to_pylist()
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= TEXT_BYTES):
            size += len(texts[end] or "")
            end += 1
        yield at, [t or "" for t in texts[at:end]]
        at = end


#: What the quick way below knows to be the normaliser and the borders of pre-tokens.
QUICK = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters of Latin-1, then marks without the apostrophe: two pre-tokens at most, which no normalisation but lower case changes.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"


class _Chunks(dict):
    """The ids of chunks between spaces, tabs and line ends, each found once, as little-endian integers of ``width`` bytes.

    The tokenizer must see these four characters as nothing but borders: no normalisation or token may reach across them.
    That is tried on a few texts and refused where it fails.  Where the tokenizer is made as ``QUICK`` says, chunks of plain
    letters and marks go to its model directly; others pass the whole tokenizer.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__({"": b""})
        self.model, self.kind = Tokenizer.from_file(path), {2: "H", 4: "I"}[width]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        parts = [[x["type"] for x in ((made.get(a) or {}).get(b) or [])] for a, b in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        split = next((x.get("pattern", {}).get("Regex") for x in ((made.get("pre_tokenizer") or {}).get("pretokenizers") or []) if x["type"] == "Split"), None)
        self.quick, self.tokenize = (*parts, split) == QUICK, self.model.model.tokenize
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): bytes_of.pre_tokenize_str(c)[0][0] for c in LATIN}
        for text in ("a b\nc\td\re", " 's \u0301e é\n'll x1 2\t\t!? Öß, ab'c", "<|endoftext|> <|endoftext|>\nA"):
            if self.of(text) != self.bytes(self.model.encode(text, add_special_tokens=False).ids):
                raise ValueError("the tokenizer does not keep apart what white space separates")

    def bytes(self, ids: list[int]) -> bytes:
        """An id that does not fit in ``width`` bytes is an error."""
        found = array(self.kind, ids)
        if BIG:
            found.byteswap()
        return found.tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if self.quick and (chunk.isalpha() and chunk.isascii() or (plain := PLAIN.fullmatch(chunk))):
            letters, marks = (chunk, "") if chunk.isascii() and chunk.isalpha() else plain.groups()
            if letters and marks:
                found = self[letters] + self[marks]
            elif (low := chunk.lower()) != chunk:
                found = self[low]
            else:
                found = self.bytes([t.id for t in self.tokenize(chunk if chunk.isascii() else chunk.translate(self.letters))])
        else:
            found = self.bytes(self.model.encode(chunk, add_special_tokens=False).ids)
        self[chunk] = found
        return found

    def of(self, text: str) -> bytes:
        """The ids of a text."""
        if len(self) > CHUNK_TABLE:
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def encode(docs: DataFrame, path: str, end_id: int | None = None, width: int = 4) -> DataFrame:
    """(doc_id, n, crc, ids) of each row of (doc_id, text), ids as little-endian integers of ``width`` bytes, ``end_id`` after those of each text.

    A null text is empty; rows are encoded one by one, repeated and null doc_ids too; other columns are not read.  An id that
    ``width`` (2 or 4) cannot hold is an error.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(path, width)
        last = b"" if end_id is None else chunks.bytes([end_id])
        for batch in batches:
            for at, texts in _texts(batch, 1):
                ids = [chunks.of(t) + last for t in texts]
                columns = [pa.array([len(x) // width for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), *columns], ["doc_id", "n", "crc", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, n long, crc long, ids binary")


def _flat(column: pa.Array, width: int) -> np.ndarray:
    """All ids of a column, one row after the other."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", f"<u{width}", (offsets[-1] - offsets[0]) // width, offsets[0])


def frequencies(encoded: DataFrame, width: int = 4) -> DataFrame:
    """(id, n) of each id of (ids); summed in the tasks first."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        small = np.zeros(1 << 16, np.int64)  # two-byte ids are counted in a table
        for batch in batches:
            ids = _flat(batch.column(0), width)
            if width == 2:
                small += np.bincount(ids, minlength=len(small))
                continue
            found, n = np.unique(ids, return_counts=True)
            total.update(dict(zip(found.tolist(), n.tolist())))
        some = np.flatnonzero(small)
        total.update(dict(zip(some.tolist(), small[some].tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def ranked_ids(counts: DataFrame) -> np.ndarray:
    """The ids by falling frequency, then by id; at most VOCABULARY, else an error."""
    rows = counts.limit(VOCABULARY + 1).toArrow()
    if len(rows) > VOCABULARY:
        raise ValueError("more distinct ids than a rank table holds")
    ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def code(ranks: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and rank bytes of documents of ``sizes`` 32-bit ranks one after the other.

    Control bytes begin anew with each document; the unused lengths of its last one are 1.
    """
    ranks = ranks.astype("<u4")
    more = (ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    groups = -(-sizes // 4)
    padded = np.zeros(4 * int(groups.sum()), np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(np.cumsum(4 * groups - sizes) - (4 * groups - sizes), sizes)] = more
    fours = padded.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= more[:, None]].tobytes()


def decode(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranks of documents of ``sizes`` ids one after the other, whose control bytes begin anew with each."""
    lengths = LENGTHS[control].ravel()
    groups = -(-sizes // 4)
    if int(sizes.sum()) != len(lengths):  # leave out what fills up a document's last control byte
        spare = 4 * groups - sizes
        after = np.cumsum(4 * groups)
        used = np.ones(len(lengths), bool)
        for k in (1, 2, 3):
            used[after[spare >= k] - k] = False
        lengths = lengths[used]
    ends = np.cumsum(lengths, dtype=np.int64)
    at = ends - lengths
    out = np.zeros(len(lengths), np.uint32)
    for k in range(4):
        more = np.flatnonzero(lengths > k) if k else slice(None)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, width: int, most_ids: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (doc_id, n, ids) in their order."""

    def give(names: list, ids: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) // width for x in ids], "<i8")
        control, data = code(ranks[np.frombuffer(b"".join(ids), f"<u{width}")], sizes)
        null = np.array([x is None for x in names], np.uint8)
        body = struct.pack("<QQQ", len(names), len(control), len(data)) + np.array([x or 0 for x in names], "<i8").tobytes() + null.tobytes() + sizes.tobytes() + control + data
        return pa.RecordBatch.from_arrays([pa.array([MAGIC + struct.pack("<I", zlib.crc32(body)) + body], pa.binary())], ["value"])

    names, held, count = [], [], 0
    for batch in batches:
        for name, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (count + n > most_ids or len(held) >= BLOCK_DOCS):
                yield give(names, held)
                names, held, count = [], [], 0
            names.append(name)
            held.append(ids)
            count += n
    if held:
        yield give(names, held)


def write(encoded: DataFrame, path: str, width: int = 4) -> None:
    """Write (doc_id, n, crc, ids) below ``path`` in ascending doc_id order, null doc_ids first; equal doc_ids by n, then by crc.

    ``encoded`` is read three times: a written table serves best.  An empty table gives files without blocks, or none.
    """
    spark = encoded.sparkSession
    frequencies(encoded, width).write.parquet(f"{path}/ranks")
    ranked = ranked_ids(spark.read.parquet(f"{path}/ranks"))
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 0, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # four bytes for each id up to the largest
    order = [F.asc_nulls_first("doc_id"), F.asc("n"), F.asc("crc")]
    rows = encoded.select("doc_id", "n", "crc", "ids").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    most = BLOCK_IDS
    blocks = rows.mapInArrow(lambda batches: _blocks(batches, shared.value, width, most), "value binary")
    blocks.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/ids")


def _documents(content: bytes, ranked: np.ndarray) -> Iterator[tuple]:
    """(doc_id, null flag, sizes, ids) of each block of a file."""
    at = 0
    while at < len(content):
        magic, crc, docs, controls, bytes_ = HEAD.unpack_from(content, at)
        end = at + HEAD.size + 17 * docs + controls + bytes_
        if magic != MAGIC or end >= len(content) + 1 or zlib.crc32(memoryview(content)[at + 8 : end]) != crc:
            raise ValueError("a block of token ids is damaged")
        part = lambda kind, n, start: np.frombuffer(content, kind, n, at + HEAD.size + start)  # noqa: B023, E731
        names, null, sizes = part("<i8", docs, 0), part(np.uint8, docs, 8 * docs), part("<i8", docs, 9 * docs)
        ranks = decode(part(np.uint8, controls, 17 * docs), part(np.uint8, bytes_, 17 * docs + controls), sizes)
        yield names, null.astype(bool), sizes, ranked[ranks]
        at = end + 1


def _read(spark: SparkSession, path: str, kind: str, give) -> DataFrame:
    """Rows that ``give`` makes of each block: (file, ids of the file before the block, names, null, sizes, ids) -> columns."""
    shared = spark.sparkContext.broadcast(ranked_ids(spark.read.parquet(f"{path}/ranks")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                before = 0
                for names, null, sizes, ids in _documents(content.as_py(), shared.value):
                    columns = give(name.as_py(), before, names, null, sizes, ids)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                    before += len(ids)

    return spark.read.format("binaryFile").load(f"{path}/ids").select("path", "content").mapInArrow(of, kind)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of each document below ``path``, ids as an array."""

    def give(file, before, names, null, sizes, ids):
        return {"doc_id": pa.array(names, mask=null), "ids": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids.astype(np.int64)))}

    return _read(spark, path, "doc_id long, ids array<long>", give)


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document below ``path``."""

    def give(file, before, names, null, sizes, ids):
        ends = np.cumsum(sizes)
        raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
        return {"file": pa.array([file] * len(sizes), pa.string()), "doc_id": pa.array(names, mask=null), "inside": pa.array(before + ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())}

    rows = _read(spark, path, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long", give)
    number = lambda i: F.regexp_extract("file", r"part-(\d+)-.*-c(\d+)[^/]*$", i).cast("long")
    rows = cut(rows.withColumns({"part": number(1), "piece": number(2)}).drop("file"))
    # ids before each file: a running sum inside every thousand parts, and one over the thousands
    files = rows.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n")).withColumn("thousand", F.floor(F.col("part") / 1000))
    files = files.withColumn("upto", F.sum("n").over(Window.partitionBy("thousand").orderBy("part", "piece")))
    thousands = files.groupBy("thousand").agg(F.sum("n").alias("sum"))
    thousands = thousands.select("thousand", (F.sum("sum").over(Window.orderBy("thousand")) - F.col("sum")).alias("base"))
    files = files.join(thousands, "thousand").select("part", "piece", (F.col("base") + F.col("upto") - F.col("n")).alias("base"))
    return rows.join(files, ["part", "piece"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded, written as files and read back."""
    path = fresh_path(spark, "ids")
    width = 2  # this tokenizer has 49408 ids
    encoded = cut(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path("word_bpe_49k.json"), 2, width))
    write(encoded, path, width)
    release(encoded)
    return index(spark, path)


QUERIES = {"op12_token_files": op12_token_files}
ORACLES: dict[str, str] = {}
