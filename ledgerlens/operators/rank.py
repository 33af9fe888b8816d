"""Rankings and top-k.

A ranking is the grouped table followed by ``orderBy().limit(n)``, which
Catalyst plans as TakeOrderedAndProject: each partition keeps its own top n,
so only n rows per partition ever move.  Every order has an explicit
tie-break (dimension value ascending).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.grouped import performance
from ledgerlens.roles import Roles

# metric name -> column of the grouped table (fixed values)
METRIC_COLUMNS = {"sales": "sales", "profit": "profit", "loss": "profit", "margin": "profit_margin_percent",
                  "discount": "average_discount", "cost": "cost", "quantity": "quantity",
                  "orders": "order_count", "customers": "customer_count"}


def _wanted(n: int) -> int:
    """The asked number of rows, as it is."""
    if int(n) < 1:
        raise ValueError("n must be at least 1")
    return int(n)


def rank_by(df: DataFrame, roles: Roles, dim: str, metric: str = "sales", ascending: bool | None = None,
            n: int = 10) -> DataFrame:
    """G1: top/bottom ``n`` groups of ``dim`` by ``metric``; ``loss`` keeps loss groups, worst first."""
    if metric not in METRIC_COLUMNS:
        raise ValueError(f"metric must be one of {sorted(METRIC_COLUMNS)}")
    n = _wanted(n)
    g = performance(df, roles, dim, customers=True, cost=True, sort=False)
    col = METRIC_COLUMNS[metric]
    if metric == "loss":
        g = g.where(F.col("profit") < 0)
        ascending = True
    asc = bool(ascending) if ascending is not None else False
    key = F.col(col).asc_nulls_last() if asc else F.col(col).desc_nulls_last()
    top = g.orderBy(key, F.col("dimension_value").asc_nulls_first()).limit(n)
    w = Window.orderBy(key, F.col("dimension_value").asc_nulls_first())
    return top.withColumn("rank", F.row_number().over(w)).withColumn("ranked_by", F.lit(col))


def top_records(df: DataFrame, sort_col: str, n: int = 10, ascending: bool = False) -> DataFrame:
    """Top ``n`` rows by a column; remaining columns break ties."""
    key = F.col(sort_col).asc() if ascending else F.col(sort_col).desc()
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c != sort_col]
    return df.orderBy(key, *rest).limit(n)


def drilldown(table: DataFrame, sort_col: str, n: int = 10, ascending: bool = False) -> DataFrame:
    """Any table, any sort column, top ``n``."""
    return top_records(table, sort_col, _wanted(n), ascending)


def loss_orders(df: DataFrame, roles: Roles, n: int = 250) -> DataFrame:
    """Worst loss rows by profit (first 250)."""
    p = roles.present("profit", df.columns)
    return top_records(df.where(F.col(p) < 0), p, n, ascending=True)


def compare_values(df: DataFrame, roles: Roles, dim: str, values: list[str]) -> DataFrame:
    """The grouped table restricted to >= 2 named values (case-insensitive)."""
    col = roles.present(dim, df.columns) or dim
    wanted = [str(v).lower() for v in values]
    sub = df.where(F.lower(F.col(col).cast("string")).isin(wanted))
    return performance(sub, roles, dim)


def available_values(df: DataFrame, roles: Roles, dim: str, limit: int = 25) -> DataFrame:
    """C10 fallback: the first ``limit`` available values when too few were named."""
    col = roles.present(dim, df.columns) or dim
    return df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()) \
             .distinct().orderBy("value").limit(limit)
