"""Profit leakage chain.

All per-dimension scans share :func:`grouped.dim_perf` (one aggregate for
many dimensions).  "Worst k per dimension" is ``row_number() <= k`` over a
window partitioned by dimension, which Spark executes with a partial group
limit before the shuffle, so only k rows per dimension per task move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import BAND_LABELS, cents, msum, ci_equals, discount_band, profit_margin
from ledgerlens.operators.grouped import dim_perf, performance, with_synthetic
from ledgerlens.operators.quantiles import exact_quantiles, with_quantiles
from ledgerlens.roles import Roles

# --- fixed values --------------------------------------------------------
LEAKAGE_DIMS = ("category", "subcategory", "product", "region", "segment")
LOSS_TABLE_DIMS = ("category", "subcategory", "product", "region", "segment", "customer")
# J10 tie-break priority among dimensions
TOP_LEAKAGE_PRIORITY = {"subcategory": 0, "product": 1, "category": 2, "region": 3, "segment": 4, "customer": 5}
# J11 candidate order for in-context drivers
CONTEXT_DRIVER_DIMS = ("region", "segment", "product", "subcategory", "category", "customer")
# J12 priority of area types
OTHER_AREA_PRIORITY = {"subcategory": 0, "category": 1, "product": 2, "region": 3, "segment": 4, "customer": 5}
# E11 dimension pairs and the labels used for the dimensions a pair leaves out
COMBO_SPECS = (("Category + Sub-Category", "category", "subcategory"), ("Category + Region", "category", "region"),
               ("Sub-Category + Region", "subcategory", "region"), ("Sub-Category + Segment", "subcategory", "segment"),
               ("Product + Region", "product", "region"), ("Product + Segment", "product", "segment"))
COMBO_DEFAULTS = {"category": "All Categories", "subcategory": "All Sub-Categories", "product": "All Products",
                  "region": "All Regions", "segment": "All Segments"}
LEAKAGE_MARGIN = 5.0
DIAGNOSTIC_DIMS = ("category", "subcategory", "product", "region", "state", "segment", "customer", "ship_mode",
                   "discount_band", "month")
# ------------------------------------------------------------------------


def _avail(df, roles, dims):
    return [d for d in dims if d in ("discount_band", "month", "quarter", "year") or roles.present(d, df.columns)]


def loss_summary(df: DataFrame, roles: Roles) -> DataFrame:
    """E10 header: total loss amount and loss rows."""
    p = F.col(roles.present("profit", df.columns))
    return df.where(p < 0).agg(F.coalesce(msum(p), F.lit(0.0)).alias("total_loss_amount"),
                               F.count(F.lit(1)).alias("total_loss_orders"))


def loss_by(df: DataFrame, roles: Roles, dim: str) -> DataFrame:
    """The grouped table computed on loss rows only."""
    p = roles.present("profit", df.columns)
    return performance(df.where(F.col(p) < 0), roles, dim)


def loss_combinations(df: DataFrame, roles: Roles, top: int = 10) -> DataFrame:
    """Six dimension pairs on loss rows, worst ``top`` per pair, unioned;
    dimensions a pair leaves out read 'All <X>'."""
    p = roles.present("profit", df.columns)
    specs = [(n, a, b) for n, a, b in COMBO_SPECS if roles.present(a, df.columns) and roles.present(b, df.columns)]
    dims = [d for d in COMBO_DEFAULTS if roles.present(d, df.columns)]
    loss = df.where(F.col(p) < 0)
    # one pass: each loss row expanded once per pair (a GROUPING SETS shape)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("combination_type"),
                                         *[(F.col(roles.get(d)).cast("string") if d in (a, b) else F.lit(None).cast("string")).alias(d)
                                           for d in dims]) for n, a, b in specs])).alias("_c")
    ex = loss.select(F.col(p).alias("_profit"), pairs).select("_profit", "_c.*")
    g = ex.groupBy("combination_type", *dims).agg(msum("_profit").alias("loss"), F.count(F.lit(1)).alias("orders"))
    w = Window.partitionBy("combination_type").orderBy(F.col("loss").asc(), *[F.col(d).asc_nulls_first() for d in dims])
    g = g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top).drop("_rn")
    for d in dims:
        g = g.withColumn(d, F.coalesce(F.col(d), F.lit(COMBO_DEFAULTS[d])))
    return g.select("combination_type", *dims, "loss", "orders").orderBy("loss", "combination_type", *dims)


RELATED_DIMS = ("category", "subcategory", "product", "region", "segment", "customer")
WEAK_DIMS = ("category", "subcategory", "product", "region")


def low_margin(df: DataFrame, roles: Roles, dim: str) -> DataFrame:
    """Grouped table ordered by margin ascending."""
    return performance(df, roles, dim, sort=False).orderBy("profit_margin_percent", "dimension_value")


def leakage_points(df: DataFrame, roles: Roles) -> DataFrame:
    """Groups with a loss or margin below 5 %, over five dimensions."""
    t = dim_perf(df, roles, _avail(df, roles, LEAKAGE_DIMS))
    return t.where((F.col("profit") < 0) | (F.col("profit_margin_percent") < LEAKAGE_MARGIN))


def high_sales_low_profit(df: DataFrame, roles: Roles, dim: str = "category") -> DataFrame:
    """Sales >= 60th percentile of groups and margin <= the median group margin."""
    g = performance(df, roles, dim, sort=False)
    th = exact_quantiles(g, {"_s": (F.col("sales"), 0.6), "_m": (F.col("profit_margin_percent"), 0.5)})
    return g.crossJoin(F.broadcast(th)).where((F.col("sales") >= F.col("_s")) & (F.col("profit_margin_percent") <= F.col("_m"))) \
            .drop("_s", "_m").orderBy(F.col("sales").desc(), F.col("profit_margin_percent").asc(), "dimension_value")


def high_sales_weak_margin(df: DataFrame, roles: Roles, dim: str = "product", n: int = 10) -> DataFrame:
    """Sales >= p50 (<= 5 groups) else p70; margin <= max(median, overall);
    when nothing qualifies, the 10 lowest margins."""
    g = performance(df, roles, dim, customers=True, cost=True, sort=False)
    th = with_quantiles(g.agg(F.count(F.lit(1)).alias("_n"), profit_margin(msum("profit"), msum("sales")).alias("_overall")), g, {
        "_p50": (F.col("sales"), 0.5), "_p70": (F.col("sales"), 0.7), "_med": (F.col("profit_margin_percent"), 0.5)})
    t = g.crossJoin(F.broadcast(th))
    hit = (F.col("sales") >= F.when(F.col("_n") <= 5, F.col("_p50")).otherwise(F.col("_p70"))) & \
          (F.col("profit_margin_percent") <= F.greatest(F.col("_med"), F.col("_overall")))
    t = t.withColumn("_hit", hit)
    any_hit = t.agg(F.max(F.col("_hit").cast("int")).alias("_any"))
    t = t.crossJoin(F.broadcast(any_hit)).where(F.col("_hit") | (F.col("_any") == 0))
    w = Window.orderBy(F.col("profit_margin_percent").asc(), F.col("sales").desc(), F.col("dimension_value"))
    top = t.orderBy(F.col("profit_margin_percent").asc(), F.col("sales").desc(), F.col("dimension_value")).limit(n)
    return top.withColumn("rank", F.row_number().over(w)).drop("_n", "_p50", "_p70", "_med", "_overall", "_hit", "_any")


def _priority(mapping: dict, col: str):
    expr = F.lit(99)
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, F.lit(v)).otherwise(expr)
    return expr


def top_leakage(df: DataFrame, roles: Roles, points: DataFrame | None = None) -> DataFrame:
    """The single strongest leakage point (profit, then dimension priority, then margin)."""
    t = (leakage_points(df, roles) if points is None else points).withColumn("_prio", _priority(TOP_LEAKAGE_PRIORITY, "dimension"))
    return t.orderBy("profit", "_prio", "profit_margin_percent", "dimension_value").limit(1).drop("_prio")


def _slice(df: DataFrame, roles: Roles, ctx: DataFrame) -> DataFrame:
    """Rows of ``df`` inside the (one-row) context ``ctx`` (dimension, dimension_value)."""
    conds = None
    for d in set(TOP_LEAKAGE_PRIORITY) | set(LEAKAGE_DIMS):
        c = roles.present(d, df.columns)
        if not c:
            continue
        cond = (F.col("_ctx_dim") == d) & (F.lower(F.col(c).cast("string")) == F.lower(F.col("_ctx_val")))
        conds = cond if conds is None else conds | cond
    ctx1 = ctx.select(F.col("dimension").alias("_ctx_dim"), F.col("dimension_value").alias("_ctx_val"))
    return df.crossJoin(F.broadcast(ctx1)).where(conds)


def leakage_drivers(df: DataFrame, roles: Roles, top: DataFrame | None = None) -> DataFrame:
    """Inside the top leakage slice only -- the worst loss-making discount
    band, then the largest loss in up to two other dimensions."""
    ctx = (top_leakage(df, roles) if top is None else top).select("dimension", "dimension_value")
    sl = _slice(df, roles, ctx)
    p, s, d = (roles.present(r, df.columns) for r in ("profit", "sales", "discount"))
    parts = []
    if d:
        b = sl.withColumn("_band", discount_band(F.col(d))).groupBy("_band").agg(msum(p).alias("profit"), msum(s).alias("sales"))
        b = b.where(F.col("profit") < 0).orderBy("profit", "_band").limit(1)
        parts.append(b.select(F.lit("discount_band").alias("driver_dimension"), F.col("_band").alias("driver_value"),
                              "profit", F.lit(0).alias("_order")))
    dims = [x for x in CONTEXT_DRIVER_DIMS if roles.present(x, df.columns)]
    ex = sl.select("*", F.explode(F.array(*[F.struct(F.lit(x).alias("_d"), F.col(roles.get(x)).cast("string").alias("_v"),
                                                     F.lit(i + 1).alias("_o")) for i, x in enumerate(dims)])).alias("_e"))
    g = ex.where(F.col("_e._d") != F.col("_ctx_dim")).groupBy("_e._d", "_e._v", "_e._o").agg(msum(p).alias("profit"))
    g = g.where(F.col("profit") < 0)
    w = Window.partitionBy("_d").orderBy("profit", "_v")
    worst = g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    w2 = Window.orderBy("_o")
    first2 = worst.withColumn("_k", F.row_number().over(w2)).where(F.col("_k") <= 2)
    parts.append(first2.select(F.col("_d").alias("driver_dimension"), F.col("_v").alias("driver_value"), "profit",
                               F.col("_o").alias("_order")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.crossJoin(F.broadcast(ctx.select(F.col("dimension").alias("context_dimension"),
                                                F.col("dimension_value").alias("context_value")))) \
              .orderBy("_order").drop("_order")


def other_loss_areas(df: DataFrame, roles: Roles, limit: int = 8) -> DataFrame:
    """Worst three loss groups per dimension (six incl. customer), excluding
    the top problem value, in area priority order, first ``limit``."""
    t = dim_perf(df, roles, _avail(df, roles, LOSS_TABLE_DIMS)).where(F.col("profit") < 0)
    w = Window.partitionBy("dimension").orderBy("profit", "dimension_value")
    t = t.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 3)
    top = top_leakage(df, roles).agg(F.max(F.lower(F.col("dimension_value"))).alias("_top"))  # always one row
    t = t.crossJoin(F.broadcast(top)).where(F.col("_top").isNull() | (F.lower(F.col("dimension_value")) != F.col("_top")))
    t = t.withColumn("_prio", _priority(OTHER_AREA_PRIORITY, "dimension"))
    return t.orderBy("_prio", "profit", "dimension_value").limit(limit).select(
        F.col("dimension").alias("area_type"), F.col("dimension_value").alias("area"), "sales", "profit",
        "profit_margin_percent", "loss_contribution_percent")


def profit_summary(df: DataFrame, roles: Roles, top: DataFrame | None = None) -> DataFrame:
    """Overall profit facts plus the top leakage point."""
    s, p = roles.present("sales", df.columns), roles.present("profit", df.columns)
    base = df.agg(F.coalesce(msum(s), F.lit(0.0)).alias("total_sales"), F.coalesce(msum(p), F.lit(0.0)).alias("total_profit"),
                  F.count(F.lit(1)).alias("rows"), F.sum((F.col(p) < 0).cast("long")).alias("loss_rows"),
                  F.coalesce(msum(F.when(F.col(p) < 0, F.col(p))), F.lit(0.0)).alias("total_loss_amount"))
    base = base.withColumn("profit_margin_percent", profit_margin("total_profit", "total_sales")) \
               .withColumn("profit_per_row", cents(F.col("total_profit")) / F.col("rows"))
    top = (top_leakage(df, roles) if top is None else top).agg(F.first("dimension").alias("top_leakage_dimension"),  # always one row
                                     F.first("dimension_value").alias("top_leakage_value"),
                                     F.first("profit").alias("top_leakage_profit"))
    return base.crossJoin(top)


def profit_diagnostic(df: DataFrame, roles: Roles) -> DataFrame:
    """Per dimension the weakest 7 by profit and 5 by margin (sales > 0),
    de-duplicated, loss-making first, then by profit."""
    t = dim_perf(df, roles, _avail(df, roles, DIAGNOSTIC_DIMS), customers=True)
    t = t.where(F.col("dimension_value").isNotNull())
    wp = Window.partitionBy("dimension").orderBy("profit", "dimension_value")
    wm = Window.partitionBy("dimension").orderBy("profit_margin_percent", "dimension_value")
    by_profit = t.withColumn("_rn", F.row_number().over(wp)).where(F.col("_rn") <= 7).drop("_rn")
    by_margin = t.where(F.col("sales") > 0).withColumn("_rn", F.row_number().over(wm)).where(F.col("_rn") <= 5).drop("_rn")
    u = by_profit.unionByName(by_margin).dropDuplicates(["dimension", "dimension_value"])
    u = u.withColumn("diagnostic_priority", F.when(F.col("profit") < 0, 0).otherwise(1))
    w = Window.orderBy("diagnostic_priority", "profit", "dimension", "dimension_value")
    return u.withColumn("rank", F.row_number().over(w)).orderBy("rank")


def profit_diagnostic_dims(df: DataFrame, roles: Roles) -> DataFrame:
    """J14 summary: groups checked, loss groups, total loss, lowest profit/margin group per dimension."""
    t = dim_perf(df, roles, _avail(df, roles, DIAGNOSTIC_DIMS)).where(F.col("dimension_value").isNotNull())
    return t.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("groups_checked"), F.sum((F.col("profit") < 0).cast("long")).alias("loss_making_groups"),
        F.coalesce(msum(F.when(F.col("profit") < 0, F.col("profit"))), F.lit(0.0)).alias("total_loss_amount"),
        F.min_by("dimension_value", F.struct("profit", "dimension_value")).alias("lowest_profit_group"),
        F.min("profit").alias("lowest_profit"),
        F.min_by(F.when(F.col("sales") > 0, F.col("dimension_value")),
                 F.when(F.col("sales") > 0, F.struct("profit_margin_percent", "dimension_value"))).alias("lowest_margin_group"),
        F.min(F.when(F.col("sales") > 0, F.col("profit_margin_percent"))).alias("lowest_margin_percent"))


def profit_by_discount_band(df: DataFrame, roles: Roles) -> DataFrame:
    """Sales, profit, rows, margin per band; all six bands kept (empty ones as 0)."""
    s, p, d = (roles.present(r, df.columns) for r in ("sales", "profit", "discount"))
    g = df.withColumn("_band", discount_band(F.col(d))).groupBy("_band").agg(
        msum(s).alias("sales"), msum(p).alias("profit"), F.count(F.lit(1)).alias("order_count"))
    bands = df.sparkSession.createDataFrame([(b, i) for i, b in enumerate(BAND_LABELS, 1)], "discount_band string, band_order int")
    out = bands.join(F.broadcast(g), bands.discount_band == g._band, "left").select(
        "discount_band", "band_order", F.coalesce("sales", F.lit(0.0)).alias("sales"),
        F.coalesce("profit", F.lit(0.0)).alias("profit"), F.coalesce("order_count", F.lit(0)).alias("order_count"))
    return out.withColumn("margin_percent", profit_margin("profit", "sales")).orderBy("band_order")


def discount_band_profile(df: DataFrame, roles: Roles) -> DataFrame:
    """Observed bands with average discount, rows, sales, profit, margin; by average discount."""
    s, p, d = (roles.present(r, df.columns) for r in ("sales", "profit", "discount"))
    g = df.withColumn("dimension_value", discount_band(F.col(d))).groupBy("dimension_value").agg(
        F.avg(d).alias("average_discount"), F.count(F.lit(1)).alias("order_count"),
        msum(s).alias("sales"), msum(p).alias("profit"))
    return g.withColumn("profit_margin_percent", profit_margin("profit", "sales")).orderBy("average_discount", "dimension_value")


def worst_groups(df: DataFrame, roles: Roles, dims=("category", "subcategory", "product", "region", "segment", "customer")) -> DataFrame:
    """The worst group by profit in each dimension."""
    t = dim_perf(df, roles, _avail(df, roles, dims))
    w = Window.partitionBy("dimension").orderBy("profit", "dimension_value")
    return t.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn").orderBy("dimension")


def relationship_summary(df: DataFrame, roles: Roles, n: int = 8) -> DataFrame:
    """The report's first ``n`` findings: the discount band with the largest loss, the worst group of each dimension,
    and the strongest high-sales group of weak margin in the first dimension that has one."""
    cols = ["dimension", "dimension_value", "profit", "profit_margin_percent"]
    bands = profit_by_discount_band(df, roles).where(F.col("profit") < 0).orderBy("profit", "band_order").limit(1) \
        .withColumn("_m", profit_margin("profit", "sales"))
    parts = [bands.select(F.lit(0).alias("_at"), F.lit("discount_band").alias("dimension"), F.col("discount_band").alias("dimension_value"), "profit",
                          F.col("_m").alias("profit_margin_percent"), F.lit("largest loss by discount").alias("finding"))]
    dims = _avail(df, roles, RELATED_DIMS)
    at = F.lit(99)
    for i, d in enumerate(dims):
        at = F.when(F.col("dimension") == d, F.lit(1 + i)).otherwise(at)
    parts.append(worst_groups(df, roles, tuple(dims)).select(at.alias("_at"), *cols, F.lit("worst group").alias("finding")))
    for i, d in enumerate(_avail(df, roles, WEAK_DIMS)):
        top = high_sales_low_profit(df, roles, d).limit(1)
        parts.append(top.select(F.lit(10 + i).alias("_at"), F.lit(d).alias("dimension"), F.col("dimension_value").cast("string").alias("dimension_value"),
                                "profit", "profit_margin_percent", F.lit("high sales, weak margin").alias("finding")))
    u = reduce(DataFrame.unionByName, parts)
    # only the first dimension with a high-sales weak-margin group counts
    first = u.where(F.col("_at") >= 10).agg(F.min("_at").alias("_first"))
    kept = u.crossJoin(F.broadcast(first)).where((F.col("_at") < 10) | (F.col("_at") == F.col("_first"))).drop("_first")
    w = Window.orderBy("_at")   # at most a dozen rows
    return kept.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).drop("_at").orderBy("position")


def loss_concentration(df: DataFrame, roles: Roles) -> DataFrame:
    """Product table ordered by loss contribution (largest first)."""
    dim = "product" if roles.present("product", df.columns) else ("subcategory" if roles.present("subcategory", df.columns) else "category")
    return performance(df, roles, dim, sort=False).orderBy(F.col("loss_contribution_percent").desc(), "dimension_value")


def monthly_profit(df: DataFrame, roles: Roles) -> DataFrame:
    """Profit per month (dated rows)."""
    d, p = roles.present("date", df.columns), roles.present("profit", df.columns)
    return df.where(F.col(d).isNotNull()).groupBy(F.date_format(F.col(d), "yyyy-MM").alias("period")) \
             .agg(msum(F.coalesce(F.col(p), F.lit(0.0))).alias("profit")).orderBy("period")


def slice_root_cause(df: DataFrame, roles: Roles, dim: str, value: str) -> DataFrame:
    """One slice's sales, profit, margin, loss, rows, discount and cause flags."""
    c = roles.present(dim, df.columns) or dim
    s, p, d = (roles.present(r, df.columns) for r in ("sales", "profit", "discount"))
    f = df.where(ci_equals(c, value))
    out = f.agg(msum(s).alias("sales"), msum(p).alias("profit"),
                F.coalesce(msum(F.when(F.col(p) < 0, F.col(p))), F.lit(0.0)).alias("loss_amount"),
                F.count(F.lit(1)).alias("order_count"), F.avg(d).alias("average_discount"))
    out = out.where(F.col("order_count") > 0)
    return out.withColumn("margin", F.when(F.col("sales") != 0, profit_margin("profit", "sales"))) \
              .withColumn("loss_making", F.col("profit") < 0) \
              .withColumn("discount_pressure", F.col("average_discount") > 20) \
              .select(F.lit(dim).alias("target_dimension"), F.lit(value).alias("target_value"), "*")


def slice_breakdown(df: DataFrame, roles: Roles, dim: str, value: str,
                    by=("subcategory", "product", "region", "segment")) -> DataFrame:
    """E34 breakdowns: grouped tables inside the slice for four dimensions."""
    c = roles.present(dim, df.columns) or dim
    return dim_perf(df.where(ci_equals(c, value)), roles, _avail(df, roles, by))


def combo_profit(df: DataFrame, roles: Roles, a: str, b: str) -> DataFrame:
    from ledgerlens.operators.grouped import combo_performance
    return combo_performance(df, roles, a, b)


__all__ = [n for n in dir() if not n.startswith("_")] + ["with_synthetic"]
