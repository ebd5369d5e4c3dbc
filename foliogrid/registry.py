"""All queries of the engine's own operators, with the SQL that checks them."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliogrid import plans
from foliogrid.plans import base

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    importlib.import_module(f"foliogrid.plans.{_module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for a question: indexed, ranked and blended."""
    return base.QUERIES["t07_hybrid_evidence"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
