"""Registry of named queries: a Spark builder and, where SQL can say it, the
equivalent DuckDB text over the same driver tables.

Names follow the inventory ID plus a short name (``fil_6_in_stock``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cartograph.sources.shop import with_views


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    bench: bool = False


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, bench: bool = False):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, with_views(oracle) if oracle else None, bench)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every plan module (each registers its queries)."""
    from cartograph.plans import (  # noqa: F401
        analytics, catalog, changes, quality, search, streams)
    return REGISTRY
