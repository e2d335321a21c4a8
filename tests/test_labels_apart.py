"""Labels are for scoring: no operator, source or stream can read their table, and no runtime module imports a scoring one."""

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent / "galena"
#: Scoring, and the queries over test tables, which choose what an operator is given.
SCORING = {"grading", "evaluation", "grading_queries", "judged_queries", "queries", "assessment_queries", "capture_queries", "grouped", "statements", "detection"}
RUNTIME = sorted(p for part in ("operators", "sources", "streaming", "plans") for p in (ROOT / part).glob("*.py") if p.stem not in SCORING)


@pytest.mark.parametrize("path", RUNTIME, ids=lambda p: p.stem)
def test_runtime_module_knows_no_labels(path):
    tree = ast.parse(path.read_text())
    docs = {id(n.body[0].value) for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.FunctionDef, ast.ClassDef)) and n.body and isinstance(n.body[0], ast.Expr)}
    texts = [n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str) and id(n) not in docs]
    assert not [t for t in texts if "labels.parquet" in t or "{labels}" in t]
    named = {a.name.split(".")[-1] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names} | {(n.module or "").split(".")[-1] for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)}
    assert not named & {"grading", "evaluation", "grading_queries"}


def test_no_query_outside_the_training_data_reads_the_labels():
    found = [p.stem for p in ROOT.glob("*/*.py") if p.parent.name != "llm" and ("labels.parquet" in p.read_text() or "{labels}" in p.read_text())]
    assert found == []
