"""From raw documents to token ids: quality, toxicity, near duplicates, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from galena.llm import metric_join, mixing, pieces, quality, toxicity
from galena.llm.storage import cut

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
PLACE = ["mix_slot", "mix_seq"]
WORD = r"[^\x20\x09-\x0D]"
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and that no rule, learned from the labelled rows of ``docs``, rejects."""
    rules = quality.learned_rules(docs, _labels(spark, sf_dir))
    return quality.judge(_kept_text(docs), rules, *DOCUMENT[:1], "kept_text", *DOCUMENT[2:]).where("kept").withColumnRenamed("kept_text", "text").select(DOCUMENT)


def _kept_text(docs: DataFrame) -> DataFrame:
    """The operators read ``text`` and hand on the columns they are told to; this one is ``text`` itself."""
    return docs.select("*", F.col("text").alias("kept_text"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model comes from the labelled rows of ``docs`` that aren't held out."""
    model = toxicity.train(docs, _labels(spark, sf_dir).where(~toxicity.held_out()))
    return toxicity.score(_kept_text(docs), model, *DOCUMENT[:1], "kept_text", *DOCUMENT[2:]).where("score < 0.7").withColumnRenamed("kept_text", "text").select(DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (null last), then the smallest text key.

    Different texts of one doc_id are documents of their own; rows equal in doc_id and text stay once.
    Documents without words have no component to stand for them and all stay.
    """
    keyed = docs.withColumn("text_key", F.md5("text"))
    found = metric_join.jaccard_join(keyed.select("doc_id", "text", "text_key"), keep=["text_key"]).where("component IS NOT NULL")
    stay = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("d")).select("d.doc_id", "d.text_key")
    # both keys and the text itself: one exchange for the join and for keeping one row of each
    same = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), "text_key"]
    wordy = keyed.where(F.col("text").rlike(WORD)).select(*DOCUMENT, *same).join(stay.select(*same), ["id_key", "text_key"], "left_semi")
    first = wordy.groupBy("id_key", "text_key").agg(F.min(F.struct(*DOCUMENT)).alias("d")).select("d.*")
    wordless = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return first.unionByName(wordless.select(DOCUMENT))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture, which the last stage returns."""
    return mixing.mix(docs).select(*DOCUMENT, *PLACE)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document as digests, and of what they decode to, beside its place in the mixture."""
    return pieces.encoded_digests(docs, pieces.model_path("piece_bpe_32k.model"), PLACE)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
