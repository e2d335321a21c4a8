"""All queries of the analytics operators, with their SQL oracles, by name."""

from __future__ import annotations

FLAGSHIP = "episode_hysteresis"


def queries() -> dict:
    from . import catalog

    return {k: f for k, (f, _) in catalog.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import catalog

    return {k: sql for k, (_, sql) in catalog.QUERIES.items() if sql}
