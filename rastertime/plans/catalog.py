"""All registered queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rastertime.plans import areas, details, extras, history, margins, models, pipelines, preparation, primitives, scenes, space, stores  # noqa: F401  (they register their queries)
from rastertime.plans.registry import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
