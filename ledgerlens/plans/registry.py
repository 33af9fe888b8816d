"""Named queries over the canonical sales fact, each paired with DuckDB SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Results are rounded (doubles to
4 places) so two engines summing in different orders agree exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.functions.scalars import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, rounded: bool = True):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return round_doubles(out) if rounded else out

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None, rounded: bool = True):
    register(name, sql, rounded)(fn)


def load_all() -> None:
    """Import every catalogue module (they register on import)."""
    from ledgerlens.plans import (  # noqa: F401
        q_core, q_quality, q_profit, q_customer, q_time, q_forecast, q_decide, q_star, q_ingest, q_match, q_insights, q_scalars,
    )
