"""Registry of named queries: one Spark plan (+ optional oracle SQL) per operator key."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    op_id: str
    key: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(op_id: str, key: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(op_id, key, fn, sql, note)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from hearthlens.plans import (  # noqa: F401
        q_report, q_select, q_quality, q_clean, q_features, q_relational,
        q_stats, q_ml, q_scenario, q_sources, q_streaming)
    return REGISTRY
