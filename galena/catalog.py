"""The queries of the analytics operators: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from .operators import absence_queries, assessment_queries, burst_queries, capture_queries, decompose, detection, evaluation, forecast_queries, grading_queries, grouped, guard_queries, judged_queries, queries, resource_queries, statements
from .operators.statements import DUCK_JOINS
from .plans.dialect import statement
from .sources import otlp, sink_queries


def _both(text: str):
    run, sql = statement(text)
    for spark_join, duck_join in DUCK_JOINS.items():
        sql = sql.replace(spark_join, duck_join)
    return run, sql


STATEMENTS = statements.STATEMENTS | detection.STATEMENTS | evaluation.STATEMENTS
QUERIES = {name: _both(text) for name, text in STATEMENTS.items()} | otlp.QUERIES | grouped.QUERIES | queries.QUERIES | judged_queries.QUERIES | capture_queries.QUERIES | assessment_queries.QUERIES | grading_queries.QUERIES | resource_queries.QUERIES | absence_queries.QUERIES | sink_queries.QUERIES | forecast_queries.QUERIES | burst_queries.QUERIES | guard_queries.QUERIES | {"decomposition_fold": (decompose.query, None)}
QUERIES |= {name: (run, QUERIES[name][1]) for name, run in absence_queries.INSTEAD.items()}
