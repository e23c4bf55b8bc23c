"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver's tables through ``fixtures`` and runs a library
operator over whole tables.  Column names match the DuckDB twins in
``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def _import_modules():
    # modules register their queries on import
    from tessera.plans import q_behavior, q_documents, q_evaluation, q_governance, q_monitoring, q_retrieval, q_routing  # noqa: F401


def _prepared(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tessera.session import ensure_checkpoint_dir, ship_package

        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries; each makes sure the package is on the executors and a checkpoint folder is set."""
    _import_modules()
    return {name: _prepared(fn) for name, fn in QUERIES.items()}


__all__ = ["register", "queries", "fx", "F"]
