"""Customer analyses.

Everything is one customer-grain aggregate (the reference's four self-joins
collapse into it), plus one-row scalar tables (min/max, quantiles) that are
cross-joined back as broadcasts -- their size is one row by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import cents, churn_flag, msum, month_key, normalize_0_100, profit_margin, risk_level
from ledgerlens.operators.grouped import written_groups
from ledgerlens.operators.kpis import customer_column
from ledgerlens.operators.quantiles import exact_quantiles
from ledgerlens.roles import Roles

# --- fixed values --------------------------------------------------------
LOYALTY_WEIGHTS = {"order_count": 0.30, "total_sales": 0.20, "total_profit": 0.20,
                   "customer_lifespan_days": 0.15, "days_since_last_order": 0.15}  # recency is inverted
NO_DATE_RECENCY = 9999
SEGMENT_LABELS = ("Unprofitable Customer", "Loyal but Low Profit", "Loyal and Profitable", "At-Risk Loyal Customer",
                  "New Promising Customer", "High Value but Infrequent", "Regular Customer")
INACTIVE_MIN_DAYS = 90
CHURN_RISK_MIN_DAYS = 60
CHURN_RISK_TOP = 15
# ------------------------------------------------------------------------


def _sum0(c):
    return F.coalesce(msum(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0))


def customer_table(df: DataFrame, roles: Roles, written: bool = False) -> DataFrame:
    """Per-customer facts in one aggregate; ``written`` by slices of the customers when they are read more than once."""
    cust = customer_column(df, roles, prefer="name")
    s, p, d, o, dt = (roles.present(r, df.columns) for r in ("sales", "profit", "discount", "order_id", "date"))
    aggs = [_sum0(s).alias("total_sales"), _sum0(p).alias("total_profit")]
    if d:
        aggs.append(F.avg(d).alias("average_discount"))
    aggs.append((F.count_distinct(o) if o else F.count(F.lit(1))).alias("order_count"))
    if dt:
        aggs += [F.min(dt).alias("first_order_date"), F.max(dt).alias("last_order_date"),
                 F.count_distinct(month_key(F.col(dt))).alias("active_month_count")]
    aggs.append(F.sum((F.col(p) < 0).cast("long")).alias("loss_order_count"))
    groups = lambda rows: rows.groupBy(F.col(cust).alias("customer")).agg(*aggs)
    g = written_groups(df, F.col(cust), groups, "customers") if written else groups(df)
    g = g.withColumn("average_order_value", F.when(F.col("order_count") != 0, cents(F.col("total_sales")) / F.col("order_count"))) \
         .withColumn("profit_margin_percent", profit_margin("total_profit", "total_sales"))
    if dt:
        mx = df.agg(F.max(dt).alias("_max_date"))
        g = g.crossJoin(F.broadcast(mx)) \
             .withColumn("customer_lifespan_days", F.coalesce(F.datediff("last_order_date", "first_order_date"), F.lit(0))) \
             .withColumn("days_since_last_order", F.coalesce(F.datediff("_max_date", "last_order_date"), F.lit(NO_DATE_RECENCY))) \
             .drop("_max_date")
    else:
        g = g.withColumn("customer_lifespan_days", F.lit(0)).withColumn("days_since_last_order", F.lit(0)) \
             .withColumn("active_month_count", F.lit(0))
    return g.withColumn("loss_order_percent", F.when(F.col("order_count") != 0,
                                                     F.col("loss_order_count") / F.col("order_count") * 100))


def customer_loyalty(df: DataFrame, roles: Roles) -> DataFrame:
    """Customer table with the 0-100 loyalty score (rounded half-even to 2)."""
    g = customer_table(df, roles, written=True)
    mm = g.agg(*[x for c in LOYALTY_WEIGHTS for x in (F.min(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_lo_{c}"),
                                                      F.max(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_hi_{c}"))])
    g = g.crossJoin(F.broadcast(mm))
    score = None
    for c, w in LOYALTY_WEIGHTS.items():
        term = normalize_0_100(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), invert=(c == "days_since_last_order")) * w
        score = term if score is None else score + term
    return g.withColumn("loyalty_score", F.bround(score, 2)).drop(*[x for c in LOYALTY_WEIGHTS for x in (f"_lo_{c}", f"_hi_{c}")])


def customer_segments(df: DataFrame, roles: Roles) -> DataFrame:
    """Ordered segmentation rules with customer-level quantiles as broadcast scalars."""
    g = customer_loyalty(df, roles)
    q = exact_quantiles(g, {"_rec75": (F.col("days_since_last_order"), 0.75), "_aov_med": (F.col("average_order_value"), 0.5),
                            "_sales75": (F.col("total_sales"), 0.75), "_orders_med": (F.col("order_count"), 0.5)})
    g = g.crossJoin(F.broadcast(q))
    inactive = F.col("days_since_last_order") > F.greatest(F.lit(float(INACTIVE_MIN_DAYS)), F.col("_rec75"))
    seg = (F.when(F.col("total_profit") < 0, F.when(F.col("loyalty_score") < 70, F.lit(SEGMENT_LABELS[0])).otherwise(F.lit(SEGMENT_LABELS[1])))
           .when((F.col("loyalty_score") >= 70) & (F.col("total_profit") > 0), F.lit(SEGMENT_LABELS[2]))
           .when(inactive & (F.col("loyalty_score") >= 55), F.lit(SEGMENT_LABELS[3]))
           .when((F.col("order_count") <= 2) & (F.coalesce(F.col("average_order_value") >= F.col("_aov_med"), F.lit(False))), F.lit(SEGMENT_LABELS[4]))
           .when((F.col("total_sales") >= F.col("_sales75")) & (F.col("order_count") <= F.col("_orders_med")), F.lit(SEGMENT_LABELS[5]))
           .otherwise(F.lit(SEGMENT_LABELS[6])))
    return g.withColumn("customer_segment", seg).drop("_rec75", "_aov_med", "_sales75", "_orders_med") \
            .orderBy(F.col("loyalty_score").desc(), "customer")


def at_risk_customers(df: DataFrame, roles: Roles) -> DataFrame:
    return customer_segments(df, roles).where(F.col("customer_segment") == SEGMENT_LABELS[3])


def unprofitable_customers(df: DataFrame, roles: Roles) -> DataFrame:
    return customer_segments(df, roles).where(F.col("customer_segment").isin(SEGMENT_LABELS[0], SEGMENT_LABELS[1]))


def segment_counts(df: DataFrame, roles: Roles) -> DataFrame:
    return customer_segments(df, roles).groupBy("customer_segment").agg(F.count(F.lit(1)).alias("customers"))


def churn_status(df: DataFrame, roles: Roles, status_col: str) -> DataFrame:
    """A customer is churned if any of its rows has a churn status."""
    cust = customer_column(df, roles, prefer="name")
    g = df.groupBy(F.col(cust).alias("customer")).agg(F.max(churn_flag(F.col(status_col))).alias("is_churned_customer"))
    return g.withColumn("churn_status", F.when(F.col("is_churned_customer"), "Churned/Inactive").otherwise("Active/Retained"))


def churn_rates(df: DataFrame, roles: Roles, status_col: str) -> DataFrame:
    """Customer-level and row-level churn rates."""
    rows = df.agg((F.avg(churn_flag(F.col(status_col)).cast("double")) * 100).alias("row_churn_rate_percent"))
    cust = churn_status(df, roles, status_col).agg(
        (F.avg(F.col("is_churned_customer").cast("double")) * 100).alias("customer_churn_rate_percent"),
        F.count(F.lit(1)).alias("customers"))
    return cust.crossJoin(rows)


def churn_by(df: DataFrame, roles: Roles, status_col: str, dim: str) -> DataFrame:
    """Churn rate by a dimension at (dimension, customer) grain."""
    cust = customer_column(df, roles, prefer="name")
    c = roles.present(dim, df.columns)
    cd = df.groupBy(F.col(c).alias(dim), F.col(cust).alias("_cust")).agg(F.max(churn_flag(F.col(status_col))).alias("_ch"))
    return cd.groupBy(dim).agg((F.avg(F.col("_ch").cast("double")) * 100).alias("customer_churn_rate_percent")) \
             .orderBy(F.col("customer_churn_rate_percent").desc(), dim)


def churn_risk(df: DataFrame, roles: Roles, top: int = CHURN_RISK_TOP) -> DataFrame:
    """Inferred churn risk from inactivity and value (dated rows)."""
    dt = roles.present("date", df.columns)
    cust = customer_column(df, roles, prefer="name")
    s, p, o = (roles.present(r, df.columns) for r in ("sales", "profit", "order_id"))
    d = df.where(F.col(dt).isNotNull())
    g = d.groupBy(F.col(cust).alias("customer")).agg(
        F.max(dt).alias("last_purchase_date"), F.min(dt).alias("first_purchase_date"), _sum0(s).alias("total_sales"),
        _sum0(p).alias("total_profit"), (F.count_distinct(o) if o else F.count(F.lit(1))).alias("order_count"))
    mx = d.agg(F.max(dt).alias("_max"))
    g = g.crossJoin(F.broadcast(mx)).withColumn("days_since_last_order", F.datediff("_max", "last_purchase_date")) \
         .withColumn("customer_lifespan_days", F.datediff("last_purchase_date", "first_purchase_date")).drop("_max")
    th = exact_quantiles(g, {"_cut": (F.col("days_since_last_order"), 0.75), "_smed": (F.col("total_sales"), 0.5)}) \
        .withColumn("_cut", F.greatest(F.lit(float(CHURN_RISK_MIN_DAYS)), F.col("_cut")))
    g = g.crossJoin(F.broadcast(th))
    score = (F.when(F.col("days_since_last_order") >= F.col("_cut"), 50).otherwise(0)
             + F.when(F.col("order_count") >= 2, 20).otherwise(0)
             + F.when(F.col("total_sales") >= F.col("_smed"), 20).otherwise(0)
             + F.when(F.col("total_profit") > 0, 10).otherwise(0))
    g = g.withColumn("churn_risk_score", score).withColumn("risk_level", risk_level(F.col("churn_risk_score"))) \
         .withColumn("inactive_cutoff_days", F.col("_cut")).drop("_cut", "_smed")
    order = [F.col("churn_risk_score").desc(), F.col("days_since_last_order").desc(), F.col("total_sales").desc(), F.col("customer")]
    from pyspark.sql import Window
    top_rows = g.orderBy(*order).limit(top)
    return top_rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def customer_discount_decision(df: DataFrame, roles: Roles, customer: str | None = None, top: int = 10) -> DataFrame:
    """Per customer vs overall margin/discount -> verdict.  A named customer
    gives that customer's row; otherwise the top customers by sales."""
    cust = customer_column(df, roles, prefer="name")
    s, p, d = (roles.present(r, df.columns) for r in ("sales", "profit", "discount"))
    g = df.groupBy(F.col(cust).alias("customer")).agg(
        _sum0(s).alias("sales"), _sum0(p).alias("profit"), F.avg(d).alias("average_discount"),
        F.count(F.lit(1)).alias("order_count"), F.sum((F.col(p) < 0).cast("long")).alias("loss_orders"))
    g = g.withColumn("profit_margin_percent", profit_margin("profit", "sales"))
    overall = df.agg(profit_margin(_sum0(p), _sum0(s)).alias("overall_margin"), F.avg(d).alias("overall_discount"))
    g = g.crossJoin(F.broadcast(overall))
    if customer is not None:
        g = g.where(F.lower(F.col("customer").cast("string")) == str(customer).lower())
    else:
        g = g.orderBy(F.col("sales").desc(), F.col("profit").desc(), "customer").limit(top)
    verdict = (F.when((F.col("profit") > 0) & (F.col("profit_margin_percent") >= F.col("overall_margin"))
                      & (F.col("average_discount") <= F.col("overall_discount")), F.lit("targeted offers only"))
               .when(F.col("profit") > 0, F.lit("selective discounts"))
               .otherwise(F.lit("no more discounts")))
    return g.withColumn("verdict", verdict)
