"""Registered queries of the interval engine, with their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with its SQL."""

    def register(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from intervalia.plans import analysis_queries, comparison_queries, file_queries, inference_queries, interval_queries, learning_queries, mode_queries, model_queries, recognition_queries, repeat_queries, rule_queries, signal_queries, source_queries, spectral_queries, wave_queries  # noqa: F401


def queries() -> dict:
    load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return ORACLES
