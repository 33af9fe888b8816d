"""What-if scenarios (J35): one aggregate each over the prepared table
(baseline and effect read the same prepared frame -- 2.13 #4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import cents, msum, profit_margin
from ledgerlens.roles import Roles

# --- fixed values --------------------------------------------------------
DISCOUNT_SAVING_SHARE = 0.05   # share of affected sales kept as profit
# ------------------------------------------------------------------------


def _result(base: DataFrame, name: str, ss, sp, assumption: str) -> DataFrame:
    out = base.select(F.lit(name).alias("scenario"), F.col("bs").alias("baseline_sales"), F.col("bp").alias("baseline_profit"),
                      ss.alias("simulated_sales"), sp.alias("simulated_profit"))
    return out.withColumn("baseline_margin", profit_margin("baseline_profit", "baseline_sales")) \
              .withColumn("simulated_margin", profit_margin("simulated_profit", "simulated_sales")) \
              .withColumn("estimated_profit_change", F.col("simulated_profit") - F.col("baseline_profit")) \
              .withColumn("assumption", F.lit(assumption))


def _base(df, roles, *extra):
    s, p = roles.present("sales", df.columns), roles.present("profit", df.columns)
    # money totals snapped to cents: the exact value of a sum of cent amounts
    return df.agg(cents(F.coalesce(F.sum(s), F.lit(0.0))).alias("bs"), cents(F.coalesce(F.sum(p), F.lit(0.0))).alias("bp"),
                  *[cents(e).alias(n) for n, e in extra])


def discount_reduction(df: DataFrame, roles: Roles, reduction_percent: float) -> DataFrame:
    b = _base(df, roles)
    lift = F.col("bs") * (reduction_percent / 100) * DISCOUNT_SAVING_SHARE if roles.present("discount", df.columns) else F.lit(0.0)
    return _result(b, "discount_reduction", F.col("bs"), F.col("bp") + lift,
                   f"reducing discount by {reduction_percent}% saves 5% of affected sales as profit")


def price_increase(df: DataFrame, roles: Roles, increase_percent: float) -> DataFrame:
    b = _base(df, roles)
    added = F.col("bs") * increase_percent / 100
    return _result(b, "price_increase", F.col("bs") + added, F.col("bp") + added,
                   f"volume stays constant after a {increase_percent}% price increase")


def remove_losses(df: DataFrame, roles: Roles) -> DataFrame:
    p = roles.present("profit", df.columns)
    b = _base(df, roles, ("loss", F.coalesce(F.sum(F.when(F.col(p) < 0, F.col(p))), F.lit(0.0))))
    return _result(b, "remove_loss_making", F.col("bs"), F.col("bp") - F.col("loss"),
                   "loss-making records are removed and no replacement sales occur")


def quantity_change(df: DataFrame, roles: Roles, change_percent: float) -> DataFrame:
    b = _base(df, roles)
    k = 1 + change_percent / 100
    return _result(b, "quantity_change", F.col("bs") * k, F.col("bp") * k,
                   f"sales and profit scale linearly with a quantity change of {change_percent}%")


def discount_cap(df: DataFrame, roles: Roles, max_discount: float) -> DataFrame:
    """Discounts are on the 0-100 scale after preparation, so the cap is compared directly."""
    d, s = roles.present("discount", df.columns), roles.present("sales", df.columns)
    b = _base(df, roles, ("affected", F.coalesce(F.sum(F.when(F.col(d) > max_discount, F.col(s))), F.lit(0.0))))
    return _result(b, "discount_cap", F.col("bs"), F.col("bp") + F.col("affected") * DISCOUNT_SAVING_SHARE,
                   f"capping discounts above {max_discount}% improves profit by 5% of affected sales")


def margin_improvement(df: DataFrame, roles: Roles, dim: str, value: str, margin_increase_percent: float) -> DataFrame:
    c, s = roles.present(dim, df.columns) or dim, roles.present("sales", df.columns)
    b = _base(df, roles, ("affected", F.coalesce(F.sum(F.when(F.col(c).cast("string") == str(value), F.col(s))), F.lit(0.0))))
    return _result(b, "margin_improvement", F.col("bs"), F.col("bp") + F.col("affected") * margin_increase_percent / 100,
                   f"{value} margin improves by {margin_increase_percent} percentage points")
