"""Operators of a training-data pipeline, built on Spark.  Nothing outside this package imports it."""

from . import chat, idfiles, infill, metric_join, mixing, pieces, quality, sharding, spelling, topk, toxicity, warc

_MODULES = (metric_join, warc, pieces, toxicity, sharding, mixing, chat, topk, quality, spelling, idfiles, infill)


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in _MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
