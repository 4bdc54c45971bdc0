"""Registry of queries (Spark) and their DuckDB oracles.

``register(key, oracle)`` records a ``(spark, sf_dir) -> DataFrame`` callable;
the oracle is a DuckDB SQL string over the driver's views (or ``None`` for
iterative / model operators checked by invariants instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    # importing registers
    from . import (q_analytics, q_clean, q_decide, q_features, q_feedback, q_io, q_models, q_more,  # noqa: F401
                   q_planning, q_roads, q_spatial, q_stream)
