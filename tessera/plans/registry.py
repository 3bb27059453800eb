"""Registry of named queries: a Spark builder and, when SQL can express it,
the equivalent DuckDB oracle SQL over the driver's tables.

Query names start with the SURVEY §2 operator id they exercise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class QuerySpec:
    name: str
    build: Builder
    oracle: str | None
    headline: bool = False


_REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, oracle: str | None = None, headline: bool = False):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = QuerySpec(name, fn, oracle, headline)
        return fn
    return deco


def all_queries() -> dict[str, QuerySpec]:
    # importing the plan modules fills the registry
    from . import (  # noqa: F401
        backtest_plans,
        corpus_plans,
        eval_plans,
        metric_plans,
        report_plans,
        source_plans,
        stream_plans,
        trace_plans,
    )
    return dict(_REGISTRY)
