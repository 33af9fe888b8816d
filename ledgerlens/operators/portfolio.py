"""Product and regional portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import msum, profit_margin
from ledgerlens.operators.grouped import performance
from ledgerlens.operators.windows import percent_rank_average
from ledgerlens.operators.quantiles import exact_quantiles
from ledgerlens.roles import Roles
from ledgerlens.session import materialise

# --- fixed values --------------------------------------------------------
PORTFOLIO_CLASSES = ("Problem Products", "Stars", "Volume Drivers", "Niche Winners", "Discount-Damaged Products",
                     "Review Products")
VOLUME_DRIVER_MARGIN = 8.0
NICHE_MARGIN = 20.0
DISCOUNT_DAMAGE_MARGIN = 10.0
# The discount threshold for "Discount-Damaged" is compared with the 0-100
# discount scale; the default 0.3 matches the original rule literally.
DISCOUNT_DAMAGE_THRESHOLD = 0.3
DOUBLE_DOWN_WEIGHTS = (0.4, 0.4, 0.2)   # sales, profit, margin percentile ranks
# ------------------------------------------------------------------------


def product_portfolio(df: DataFrame, roles: Roles, discount_threshold: float = DISCOUNT_DAMAGE_THRESHOLD) -> DataFrame:
    """Product classes from group medians (ordered rules)."""
    g = performance(df, roles, "product", sort=False, written=True)
    med = exact_quantiles(g, {"_ms": (F.col("sales"), 0.5), "_mp": (F.col("profit"), 0.5)})
    g = g.crossJoin(F.broadcast(med))
    s, p, m = F.col("sales"), F.col("profit"), F.col("profit_margin_percent")
    disc = F.coalesce(F.col("average_discount"), F.lit(0.0)) if "average_discount" in g.columns else F.lit(0.0)
    cls = (F.when(p < 0, PORTFOLIO_CLASSES[0])
           .when((s >= F.col("_ms")) & (p >= F.col("_mp")), PORTFOLIO_CLASSES[1])
           .when((s >= F.col("_ms")) & (m < VOLUME_DRIVER_MARGIN), PORTFOLIO_CLASSES[2])
           .when((s < F.col("_ms")) & (m >= NICHE_MARGIN), PORTFOLIO_CLASSES[3])
           .when((disc >= discount_threshold) & (m < DISCOUNT_DAMAGE_MARGIN), PORTFOLIO_CLASSES[4])
           .otherwise(PORTFOLIO_CLASSES[5]))
    return g.withColumn("portfolio_class", cls).drop("_ms", "_mp").orderBy(F.col("profit").desc(), "dimension_value")


def weak_regions(df: DataFrame, roles: Roles, dim: str = "region", n: int = 10) -> DataFrame:
    """Weakest groups by profit then margin."""
    g = performance(df, roles, dim, sort=False)
    return g.orderBy("profit", "profit_margin_percent", "dimension_value").limit(n)


def strong_regions(df: DataFrame, roles: Roles, dim: str = "region", n: int = 10) -> DataFrame:
    """Strongest groups by profit."""
    g = performance(df, roles, dim, sort=False)
    return g.orderBy(F.col("profit").desc(), "dimension_value").limit(n)


def high_sales_low_margin_regions(df: DataFrame, roles: Roles, dim: str = "region") -> DataFrame:
    """Sales >= median and margin <= median of the groups."""
    g = performance(df, roles, dim, sort=False)
    med = exact_quantiles(g, {"_ms": (F.col("sales"), 0.5), "_mm": (F.col("profit_margin_percent"), 0.5)})
    return g.crossJoin(F.broadcast(med)).where((F.col("sales") >= F.col("_ms")) & (F.col("profit_margin_percent") <= F.col("_mm"))) \
            .drop("_ms", "_mm").orderBy(F.col("profit").desc(), "dimension_value")


def bi_group(df: DataFrame, roles: Roles, dim: str) -> DataFrame:
    """E5: the BI shape: totals, distinct orders (rows without an order id), row-level loss amount, margin and shares
    of the whole table, worst profit first."""
    g = lambda r: roles.present(r, df.columns)
    s, p, q, d = (F.coalesce(F.col(g(r)), F.lit(0.0)) if g(r) else F.lit(0.0) for r in ("sales", "profit", "quantity", "discount"))
    orders = F.count_distinct(F.col(g("order_id")).cast("string")) if g("order_id") else F.count(F.lit(1))
    t = df.groupBy(F.col(g(dim)).cast("string").alias("dimension_value")).agg(
        msum(s).alias("sales"), msum(p).alias("profit"), F.sum(q).alias("quantity"), orders.alias("orders"),
        F.avg(F.col(g("discount")) if g("discount") else d).alias("average_discount"), msum(F.when(p < 0, p).otherwise(0.0)).alias("loss_amount"))
    tot = t.agg(msum("sales").alias("_s"), msum("profit").alias("_p"), msum("loss_amount").alias("_l"))
    part = lambda x, whole: F.when(F.col(whole) != 0, F.col(x) / F.col(whole) * 100).otherwise(F.lit(0.0))
    return (t.crossJoin(F.broadcast(tot)).withColumn("margin_percent", profit_margin("profit", "sales"))
            .withColumn("sales_contribution_percent", part("sales", "_s")).withColumn("profit_contribution_percent", part("profit", "_p"))
            .withColumn("loss_contribution_percent", part("loss_amount", "_l")).drop("_s", "_p", "_l").orderBy("profit", "dimension_value"))


def bi_stars(df: DataFrame, roles: Roles) -> DataFrame:
    """Sales >= median, profit > 0 and margin >= median."""
    g = performance(df, roles, "product", sort=False)
    med = exact_quantiles(g, {"_ms": (F.col("sales"), 0.5), "_mm": (F.col("profit_margin_percent"), 0.5)})
    return g.crossJoin(F.broadcast(med)).where((F.col("sales") >= F.col("_ms")) & (F.col("profit") > 0)
                                               & (F.col("profit_margin_percent") >= F.col("_mm"))) \
            .drop("_ms", "_mm").orderBy(F.col("profit").desc(), "dimension_value")


def bi_problems(df: DataFrame, roles: Roles) -> DataFrame:
    """Profit < 0 or margin < 0."""
    g = performance(df, roles, "product", sort=False)
    return g.where((F.col("profit") < 0) | (F.col("profit_margin_percent") < 0)).orderBy("profit", "dimension_value")


def bi_discount_damaged(df: DataFrame, roles: Roles) -> DataFrame:
    """Average discount above the median product discount and a loss."""
    g = performance(df, roles, "product", sort=False)
    med = exact_quantiles(g, {"_md": (F.col("average_discount"), 0.5)})
    return g.crossJoin(F.broadcast(med)).where((F.col("average_discount") > F.col("_md")) & (F.col("profit") < 0)) \
            .drop("_md").orderBy("profit", "dimension_value")


def double_down_products(df: DataFrame, roles: Roles) -> DataFrame:
    """Profitable products scored by average-tie percentile ranks of
    sales, profit and margin (0.4 / 0.4 / 0.2)."""
    prod, s, p = (roles.present(r, df.columns) for r in ("product", "sales", "profit"))
    g = df.groupBy(F.col(prod).alias("dimension_value")).agg(
        msum(F.coalesce(F.col(s), F.lit(0.0))).alias("sales"), msum(F.coalesce(F.col(p), F.lit(0.0))).alias("profit"),
        F.count(F.lit(1)).alias("order_count"))
    g = g.withColumn("profit_margin_percent", profit_margin("profit", "sales")).where((F.col("profit") > 0) & (F.col("sales") > 0))
    base = g = materialise(g, "profitable-products")   # aggregated once; the three ranks read it
    for c in ("sales", "profit", "profit_margin_percent"):
        g = g.join(percent_rank_average(base, c, f"_r_{c}").select("dimension_value", f"_r_{c}"), "dimension_value")
    ws, wp, wm = DOUBLE_DOWN_WEIGHTS
    g = g.withColumn("score", F.col("_r_sales") * ws + F.col("_r_profit") * wp + F.col("_r_profit_margin_percent") * wm) \
         .drop("_r_sales", "_r_profit", "_r_profit_margin_percent")
    from ledgerlens.operators.windows import row_number_global
    out = row_number_global(g, [F.col("score").desc(), F.col("dimension_value").asc()], "rank")
    return out.orderBy("rank")


__all__ = ["product_portfolio", "weak_regions", "strong_regions", "high_sales_low_margin_regions", "bi_group",
           "bi_stars", "bi_problems", "bi_discount_damaged", "double_down_products", "Window"]
