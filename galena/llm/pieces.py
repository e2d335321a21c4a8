"""Token counts and ids of a sentencepiece model, by the distinct pre-tokens of the corpus.

In the model no piece has the white-space marker after another character, so no piece
crosses the start of a pre-token ``marker* other+`` (or a last run of markers), and a text's
pieces are those of its pre-tokens in turn.  ``_Segmenter`` checks this on the vocabulary and
refuses a model for which it isn't so.  The library puts one marker before a text; a
pre-token is therefore encoded without its first marker.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .storage import cut

MARK = "▁"
PRE_TOKEN = re.compile(" *[^ ]+| +")  # a run of spaces can only be last
HEAD = 1 << 17  # frequent pre-tokens whose counts every task holds: a fixed bound of a few MB
BLOCK_ENTRIES = 400_000  # distinct pre-tokens that a task holds at a time


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Segmenter:
    """A sentencepiece model whose pieces stay inside pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            if MARK in self.model.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece of this model crosses a white-space marker")
        if self.model.encode(" a  b ") != [x for p in self.ids(pre_tokens(" a  b ")) for x in p]:
            raise ValueError("this model does not keep white space as it is")

    def ids(self, pre_tokens: list[str]) -> list[list[int]]:
        """The ids of each pre-token; a last single marker is a piece that the library gives no empty text."""
        found = self.model.encode([p[1:] for p in pre_tokens], num_threads=1)
        return [x if p != " " else [self.model.piece_to_id(MARK)] for p, x in zip(pre_tokens, found)]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each with its leading markers as spaces; none of an empty text."""
    return PRE_TOKEN.findall(" " + text.replace(MARK, " ")) if text else []


def piece_table(docs: DataFrame, path: str) -> DataFrame:
    """(pre_token, n, freq) of each distinct pre-token of the corpus, each counted once."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "freq"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(pre_tokens(text.as_py() or ""))
                if len(seen) >= BLOCK_ENTRIES:
                    yield give()
                    seen.clear()
        if seen:
            yield give()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Segmenter(path)
        for batch in batches:
            n = [len(x) for x in model.ids(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(1)], ["pre_token", "n", "freq"])

    found = docs.select("text").mapInArrow(distinct, "pre_token string, freq long")
    return found.groupBy("pre_token").agg(F.sum("freq").alias("freq")).mapInArrow(count, "pre_token string, n long, freq long")


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of (doc_id, text).

    Pieces are counted once for each distinct pre-token of the corpus and joined to the
    pre-token frequencies of the documents.  The frequent pre-tokens, a fixed number, go to
    every task, which adds them up for its documents; the rest are joined by a shuffle.

    A null text is empty and has no tokens; rows are counted one by one, also where doc_id is
    null or repeated; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(piece_table(docs, path))
    # the most frequent ones by a histogram of frequencies in sixteenths of a power of two, at most 1024 rows: no global sort
    step = F.floor(F.log2("freq") * 16)
    least, taken = None, 0
    for bar, some in sorted(pieces.groupBy(step.alias("bar")).agg(F.count("*").alias("some")).collect(), reverse=True):
        taken += some
        if taken > HEAD:
            break
        least = bar
    top = pieces.where(step >= least if least is not None else F.lit(False)).select("pre_token", "n").toArrow()  # at most HEAD rows
    head = spark.sparkContext.broadcast(dict(zip(top["pre_token"].to_pylist(), top["n"].to_pylist())))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        row = TaskContext.get().partitionId() << 33  # rows are told apart within this one pass
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                counted, total, row = Counter(pre_tokens(text)), 0, row + 1
                for p, c in counted.items():
                    n = known.get(p)
                    if n is None:
                        for col, v in zip(cols, (row, None, None, None, p, c)):
                            col.append(v)
                    else:
                        total += n * c
                for col, v in zip(cols, (row, doc_id, len(text.encode()), total, str(row), None)):
                    col.append(v)
                if len(cols[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FREQ)], schema=_FREQ)
                    cols = [[], [], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FREQ)], schema=_FREQ)

    found = docs.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, n_tokens long, pre_token string, c long")
    joined = found.join(pieces.select("pre_token", "n"), "pre_token", "left")
    # the key of the document's own row is its number, which is no pre-token as these begin with a space; both kinds meet in the sum
    sums = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.coalesce("n_tokens", F.col("n") * F.col("c"))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_FREQ = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("pre_token", pa.string()), ("c", pa.int64())])


def _joined_back(path: str, give):
    """Segments the distinct pre-tokens of a block of documents once and joins them back by position.

    The table of a block goes on to the next one until it has BLOCK_ENTRIES entries.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Segmenter(path)
        table: dict[str, str] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= 4 << 20):
                    size += len(texts[end] or "")
                    end += 1
                block = [pre_tokens(t or "") for t in texts[at:end]]
                new = list({p for b in block for p in b if p not in table})
                table.update(zip(new, (",".join(map(str, x)) for x in model.ids(new))))
                yield give(model.model, ids.slice(at, end - at), [[table[p] for p in b] for b in block])
                if len(table) >= BLOCK_ENTRIES:
                    table.clear()
                at = end

    return of


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text); a null text has no ids."""

    def give(model, ids, rows):
        return pa.RecordBatch.from_arrays([ids, pa.array([[int(x) for x in ",".join(r).split(",")] if r else [] for r in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_joined_back(path, give), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""

    def of(batches):
        model = _Segmenter(path).model
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(of, "doc_id long, text string")


def encoded_digests(docs: DataFrame, path: str, keep: Iterable[str] = ()) -> DataFrame:
    """Number and digest of the ids of each row, and digest of what the library decodes from them.

    The digests equal those of ``encode`` and ``decode``, without moving the ids out of the task.
    The columns ``keep`` (whole numbers) of each row go with it.
    """

    keep = list(keep)

    def give(model, ids, rows):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        texts = [",".join(r) for r in rows]
        n = [t.count(",") + 1 if t else 0 for t in texts]
        decoded = (model.decode([int(x) for x in t.split(",")]) if t else "" for t in texts)
        return pa.RecordBatch.from_arrays([*ids.flatten(), pa.array(n, pa.int64()), pa.array([sha(t.encode()) for t in texts], pa.string()), pa.array([sha(t.encode()) for t in decoded], pa.string())], ["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    row = F.struct(*(F.col(c).cast("long").alias(c) for c in ("doc_id", *keep))).alias("row")
    columns = "".join(f"{c} long, " for c in ("doc_id", *keep)) + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(row, F.col("text").cast("string")).mapInArrow(_joined_back(path, give), columns)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all ``documents`` against a limit of 4096 tokens."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path("piece_bpe_32k.model"), 4096)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded and decoded again."""
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path("piece_bpe_32k.model"))


QUERIES = {"op3_token_counts": op3_token_counts, "op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
