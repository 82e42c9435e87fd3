"""Where the runnable queries and their SQL twins are kept."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

MODULES = (
    "aggregate_queries chart_queries profile_queries scalar_queries window_queries join_queries sampling_queries "
    "preparation_queries integrity_queries event_queries streaming_queries lineage_queries text_queries "
    "source_queries sink_queries grid_queries model_queries"
).split()


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``covers`` lists the inventory lines it answers."""

    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, tuple(covers.split()), fn, sql.strip() if sql else None)
        return fn

    return keep


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"millrace.plans.{module}")
    return REGISTRY
