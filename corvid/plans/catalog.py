"""Registered queries: name -> (Spark callable, oracle SQL or None).

Every callable takes ``(spark, sf_dir)`` and reads the whole bound tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    """``sql`` may be a function, called when the SQL is asked for."""
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in ORACLE.items()}


def load_all() -> None:
    """Import the modules that register queries."""
    from corvid.plans import q_balance, q_claims, q_learners, q_loss, q_model, q_quality, q_sources, q_text  # noqa: F401
