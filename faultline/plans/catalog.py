"""Registry of runnable queries: name → (spark builder, DuckDB oracle SQL or None).

A builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables of
``sf_dir``.  The oracle is ANSI SQL over the same parquet tables (registered as views by
the checker) and must return the same columns and values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register themselves."""
    from faultline.plans import (cluster_plans, findings_plans, ingest_plans,  # noqa: F401
                                 investigate_plans, kpi_plans,
                                 pattern_plans, streaming_plans, trend_plans)
