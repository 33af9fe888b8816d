"""Time and ordered computations.

Period tables are aggregated first (one row per period -- bounded by the
calendar, not by the data), so their windows are cheap.  The customer running
share (F4) can be as large as the customer base and uses the distributed
prefix sum in :mod:`ledgerlens.operators.windows`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import concentration_risk, msum, period_key, profit_margin, try_pct_change
from ledgerlens.operators.kpis import customer_column
from ledgerlens.operators.windows import global_prefix
from ledgerlens.roles import Roles


def _sum0(c):
    return F.coalesce(msum(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0))


def period_table(df: DataFrame, roles: Roles, frequency: str = "M", extra: bool = False) -> DataFrame:
    """Sales/profit per period (dated rows only)."""
    d, s, p = (roles.present(r, df.columns) for r in ("date", "sales", "profit"))
    aggs = [_sum0(s).alias("sales")]
    if p:
        aggs.append(_sum0(p).alias("profit"))
    if extra:
        aggs.append(F.count(F.lit(1)).alias("order_count"))
        dc = roles.present("discount", df.columns)
        if dc:
            aggs.append(F.avg(dc).alias("average_discount"))
    return df.where(F.col(d).isNotNull()).groupBy(period_key(F.col(d), frequency).alias("period")).agg(*aggs)


def performance_over_time(df: DataFrame, roles: Roles, frequency: str = "M") -> DataFrame:
    """per period sums and period-over-period % (observed periods, no gap filling)."""
    g = period_table(df, roles, frequency)
    w = Window.orderBy("period")
    g = g.withColumn("sales_growth_percent", try_pct_change(F.col("sales"), F.lag("sales").over(w)))
    if "profit" in g.columns:
        g = g.withColumn("profit_growth_percent", try_pct_change(F.col("profit"), F.lag("profit").over(w)))
    return g.orderBy("period")


def yoy_growth(df: DataFrame, roles: Roles, years: list[int] | None = None, year_range: tuple[int, int] | None = None) -> DataFrame:
    """per year sales, rows, profit, growth and margin; years are selected
    *before* growth, so the first selected year has NULL growth."""
    d, s, p = (roles.present(r, df.columns) for r in ("date", "sales", "profit"))
    y = F.year(F.col(d))
    g = df.where(y.isNotNull()).groupBy(y.alias("year")).agg(
        _sum0(s).alias("sales"), F.count(F.lit(1)).alias("order_count"), _sum0(p).alias("profit"))
    if years:
        g = g.where(F.col("year").isin(years))
    elif year_range:
        g = g.where(F.col("year").between(*year_range))
    w = Window.orderBy("year")
    return g.withColumn("sales_yoy_growth_percent", try_pct_change(F.col("sales"), F.lag("sales").over(w))) \
            .withColumn("profit_yoy_growth_percent", try_pct_change(F.col("profit"), F.lag("profit").over(w))) \
            .withColumn("profit_margin_percent", profit_margin("profit", "sales")).orderBy("year")


def category_year_profit(df: DataFrame, roles: Roles, dim: str = "category") -> DataFrame:
    """F3 table: per (dimension, year) profit with change vs the dimension's previous year."""
    d, s, p = (roles.present(r, df.columns) for r in ("date", "sales", "profit"))
    c = roles.present(dim, df.columns)
    y = F.year(F.col(d))
    g = df.where(y.isNotNull()).groupBy(F.col(c).alias(dim), y.alias("year")).agg(
        _sum0(p).alias("profit"), F.count(F.lit(1)).alias("order_count"), _sum0(s).alias("sales"))
    w = Window.partitionBy(dim).orderBy("year")
    prev = F.lag("profit").over(w)
    return g.withColumn("profit_yoy_change", F.col("profit") - prev) \
            .withColumn("profit_yoy_growth_percent", try_pct_change(F.col("profit"), prev))


def category_yoy_decline(df: DataFrame, roles: Roles, dim: str = "category") -> DataFrame:
    """groups whose profit fell in the latest year (of the whole table), worst first."""
    t = category_year_profit(df, roles, dim)
    latest = t.agg(F.max("year").alias("_latest"))
    return t.crossJoin(F.broadcast(latest)).where((F.col("year") == F.col("_latest")) & (F.col("profit_yoy_change") < 0)) \
            .drop("_latest").orderBy("profit_yoy_change", dim)


def customer_sales_share(df: DataFrame, roles: Roles) -> DataFrame:
    """customers by sales desc with share % and cumulative share % (distributed prefix sum)."""
    cust = customer_column(df, roles, prefer="name")
    s, p = roles.present("sales", df.columns), roles.present("profit", df.columns)
    aggs = [_sum0(s).alias("sales"), F.count(F.lit(1)).alias("order_count")]
    if p:
        aggs.append(_sum0(p).alias("profit"))
    g = df.groupBy(F.col(cust).alias("customer")).agg(*aggs)
    pref = global_prefix(g, [F.col("sales").desc(), F.col("customer").asc()], {"_cum": F.col("sales")})
    tot = g.agg(msum("sales").alias("_tot"))
    share = lambda x: F.when(F.col("_tot") != 0, x / F.col("_tot") * 100).otherwise(F.lit(0.0))
    return pref.crossJoin(F.broadcast(tot)).select(
        "customer", "sales", "order_count", *(["profit"] if p else []),
        share(F.col("sales")).alias("sales_share_percent"),
        share(F.col("_cum")).alias("cumulative_sales_share_percent")).orderBy(F.col("sales").desc(), "customer")


def customer_concentration(df: DataFrame, roles: Roles) -> DataFrame:
    """F4 summary: top-5 / top-10 customer share of sales and the risk label."""
    cust = customer_column(df, roles, prefer="name")
    s = roles.present("sales", df.columns)
    g = df.groupBy(F.col(cust).alias("customer")).agg(_sum0(s).alias("sales"))
    top = g.orderBy(F.col("sales").desc(), "customer").limit(10)
    w = Window.orderBy(F.col("sales").desc(), "customer")
    top = top.withColumn("_rn", F.row_number().over(w))
    t = top.agg(msum(F.when(F.col("_rn") <= 5, F.col("sales")).otherwise(0.0)).alias("t5"), msum("sales").alias("t10"))
    tot = g.agg(msum("sales").alias("_tot"))
    out = t.crossJoin(tot).select(
        F.when(F.col("_tot") != 0, F.col("t5") / F.col("_tot") * 100).otherwise(0.0).alias("top_5_customer_sales_share_percent"),
        F.when(F.col("_tot") != 0, F.col("t10") / F.col("_tot") * 100).otherwise(0.0).alias("top_10_customer_sales_share_percent"))
    return out.withColumn("concentration_risk", concentration_risk(F.col("top_10_customer_sales_share_percent")))


def metric_drop(df: DataFrame, roles: Roles, metric: str = "profit", grain: str = "M") -> DataFrame:
    """The last two periods: values, absolute and % change (NULL % when previous is 0)."""
    d, m = roles.present("date", df.columns), roles.present(metric, df.columns) or roles.present("profit", df.columns)
    g = df.where(F.col(d).isNotNull()).groupBy(period_key(F.col(d), grain).alias("period")).agg(msum(m).alias("value"))
    last2 = g.orderBy(F.col("period").desc()).limit(2)
    w = Window.orderBy("period")
    t = last2.withColumn("previous_period", F.lag("period").over(w)).withColumn("previous_value", F.lag("value").over(w))
    return t.where(F.col("previous_period").isNotNull()).select(
        F.col("period").alias("current_period"), "previous_period", F.col("value").alias("current_value"), "previous_value",
        (F.col("value") - F.col("previous_value")).alias("absolute_change"),
        F.when(F.col("previous_value") != 0, (F.col("value") - F.col("previous_value")) / F.col("previous_value") * 100)
         .alias("percent_change"))


def rank_periods(df: DataFrame, roles: Roles, metric: str = "profit", frequency: str = "M", n: int = 5,
                 weakest: bool = True) -> DataFrame:
    """Trend table ranked by a metric (weakest first by default)."""
    t = performance_over_time(df, roles, frequency)
    key = F.col(metric).asc() if weakest else F.col(metric).desc()
    return t.orderBy(key, "period").limit(n)
