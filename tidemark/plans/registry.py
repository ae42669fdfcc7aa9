"""Query registry: each operator key maps to a Spark builder and, where SQL
can state it, an independent DuckDB oracle query over the same parquet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed evaluation times of the fixture (FIXTURES.md §2): reports use
# REPORT_AS_OF, the due-date list filters use LIST_AS_OF.
REPORT_AS_OF = "2024-05-15 00:00:00"
LIST_AS_OF = "2024-03-01 00:00:00"


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query key {name}")
        REGISTRY[name] = Query(name, fn, oracle)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every query module so that the registry is complete."""
    from tidemark.plans import (  # noqa: F401
        q_analytics, q_lists, q_quality, q_writes, q_text, q_search, q_streams,
    )
    return REGISTRY
