"""Decision questions (J23-J34) and correlations.

Composite answers ("worst sub-category, worst band, worst products") read a
single multi-dimension aggregate (:func:`grouped.dim_perf`) and pick with
``min_by``/``max_by`` on ``(metric, value)`` structs -- deterministic ties,
no global sort, no driver round-trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import cents, ci_equals, correlation_strength, msum, profit_margin
from ledgerlens.operators.grouped import dim_perf, performance
from ledgerlens.roles import Roles

# --- fixed values --------------------------------------------------------
CONSISTENT_MIN_ROWS = 2
CONSISTENT_LOSS_SHARE = 60.0        # percent, inclusive (>=)
EXIT_DIMENSIONS = ("state", "region", "city")
NUMERIC_ROLES = ("order_id", "customer_id", "cost", "unit_price", "margin_percent", "profit", "sales", "revenue",
                 "quantity", "discount")
# ------------------------------------------------------------------------


def _col(df, roles, r) -> str | None:
    return roles.present(r, df.columns)


def consistent_losers(df: DataFrame, roles: Roles, dim: str = "product") -> DataFrame:
    """Groups with >= 2 rows and loss-row share >= 60 %."""
    c = _col(df, roles, dim) or _col(df, roles, "subcategory") or _col(df, roles, "category")
    p, s = _col(df, roles, "profit"), _col(df, roles, "sales")
    g = df.groupBy(F.col(c).alias("dimension_value")).agg(
        F.count(F.lit(1)).alias("total_orders"), F.sum((F.col(p) < 0).cast("long")).alias("loss_orders"),
        msum(p).alias("total_profit"), msum(s).alias("sales"))
    g = g.withColumn("profit_margin_percent", profit_margin("total_profit", "sales")) \
         .withColumn("loss_order_percent", F.col("loss_orders") / F.col("total_orders") * 100)
    g = g.where((F.col("total_orders") >= CONSISTENT_MIN_ROWS) & (F.col("loss_order_percent") >= CONSISTENT_LOSS_SHARE))
    order = [F.col("loss_order_percent").desc(), F.col("total_profit").asc(), F.col("dimension_value").asc()]
    from ledgerlens.operators.windows import row_number_global
    return row_number_global(g, order, "rank").orderBy("rank")


def exit_candidates(df: DataFrame, roles: Roles) -> DataFrame:
    """States (else regions, cities) with negative total profit."""
    c = next(_col(df, roles, d) for d in EXIT_DIMENSIONS if _col(df, roles, d))
    p, s, d = _col(df, roles, "profit"), _col(df, roles, "sales"), _col(df, roles, "discount")
    g = df.groupBy(F.col(c).alias("dimension_value")).agg(
        msum(F.coalesce(F.col(p), F.lit(0.0))).alias("profit"), F.count(F.lit(1)).alias("order_count"),
        F.sum((F.col(p) < 0).cast("long")).alias("loss_orders"), msum(F.coalesce(F.col(s), F.lit(0.0))).alias("sales"),
        F.avg(d).alias("average_discount"))
    g = g.withColumn("profit_margin_percent", profit_margin("profit", "sales")) \
         .withColumn("loss_order_percent", F.col("loss_orders") / F.col("order_count") * 100).where(F.col("profit") < 0)
    w = Window.orderBy(F.col("profit").asc(), F.col("loss_order_percent").desc(), F.col("dimension_value"))
    return g.withColumn("rank", F.row_number().over(w)).orderBy("rank")   # groups with a loss: bounded by the dimension


def ship_mode_comparison(df: DataFrame, roles: Roles) -> DataFrame:
    """Per ship mode sales, profit, rows, AOV, discount, margin; best margin first."""
    c, s, p, d = (_col(df, roles, r) for r in ("ship_mode", "sales", "profit", "discount"))
    g = df.groupBy(F.col(c).alias("dimension_value")).agg(
        msum(F.coalesce(F.col(s), F.lit(0.0))).alias("sales"), msum(F.coalesce(F.col(p), F.lit(0.0))).alias("profit"),
        F.count(F.lit(1)).alias("order_count"), F.avg(d).alias("average_discount"))
    g = g.withColumn("average_order_value", cents(F.col("sales")) / F.col("order_count")) \
         .withColumn("profit_margin_percent", profit_margin("profit", "sales"))
    w = Window.orderBy(F.col("profit_margin_percent").desc(), F.col("dimension_value"))
    return g.withColumn("rank", F.row_number().over(w)).orderBy("rank")


def _moments(x: Column, y: Column, tag: str) -> list[Column]:
    """Aggregates over the complete pairs of two columns: count, bounds, co-moment and spreads (all combined before any shuffle)."""
    x, y = x.cast("double"), y.cast("double")
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return [F.count(a).alias(f"n{tag}"), (F.min(a) < F.max(a)).alias(f"u{tag}"), (F.min(b) < F.max(b)).alias(f"v{tag}"),
            F.covar_pop(a, b).alias(f"c{tag}"), F.stddev_pop(a).alias(f"a{tag}"), F.stddev_pop(b).alias(f"b{tag}")]


def _correlation(tag: str, least: int = 3) -> Column:
    """E27 guard: >= 3 complete pairs and both sides non-constant, else NULL."""
    ok = (F.col(f"n{tag}") >= least) & F.col(f"u{tag}") & F.col(f"v{tag}")
    return F.when(ok, F.try_divide(F.col(f"c{tag}"), F.col(f"a{tag}") * F.col(f"b{tag}")))


def _guarded_corr(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: correlation and valid_rows, from one scan."""
    return df.agg(*_moments(x, y, "0")).select(_correlation("0").alias("correlation"), F.col("n0").alias("valid_rows"))


def metric_correlation(df: DataFrame, roles: Roles, driver: str = "discount", target: str = "profit") -> DataFrame:
    """Correlation of two metrics (``margin`` = row margin, NULL on zero sales) with strength text."""
    def metric(m):
        if m == "margin":
            s, p = F.col(_col(df, roles, "sales")), F.col(_col(df, roles, "profit"))
            return F.when(s != 0, p / s * 100)
        return F.col(_col(df, roles, m))
    out = _guarded_corr(df, metric(driver), metric(target))
    return out.select(F.lit(driver).alias("driver"), F.lit(target).alias("target"), "correlation", "valid_rows",
                      correlation_strength(F.col("correlation")).alias("strength"))


def profit_correlations(df: DataFrame, roles: Roles) -> DataFrame:
    """Correlation of every numeric role column with profit (undefined ones omitted), ascending."""
    p = _col(df, roles, "profit")
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal")}
    cols = []
    for r in NUMERIC_ROLES:
        c = _col(df, roles, r)
        if c and c in numeric and c not in cols:
            cols.append(c)
    one = df.agg(*[m for i, c in enumerate(cols) for m in _moments(F.col(c), F.col(p), str(i))])
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), _correlation(str(i)).alias("correlation_with_profit")) for i, c in enumerate(cols)])
    u = one.select(F.explode(rows).alias("r")).select("r.*")
    return u.where(F.col("correlation_with_profit").isNotNull()).orderBy("correlation_with_profit", "metric")


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Pearson correlation over numeric columns that have >= 2 distinct values, long format."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short")]
    if not numeric:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    pairs = [(i, j) for i in range(len(numeric)) for j in range(len(numeric)) if i < j]
    # all pairs and every column's own bounds from one scan; constant columns go afterwards
    one = df.agg(*[(F.min(c) < F.max(c)).alias(f"use{i}") for i, c in enumerate(numeric)],
                 *[m for i, j in pairs for m in _moments(F.col(numeric[i]), F.col(numeric[j]), f"{i}_{j}")])
    rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), (F.col(f"use{i}") & F.col(f"use{j}")).alias("use"),
                     (F.lit(1.0) if i == j else _correlation(f"{min(i, j)}_{max(i, j)}", 2)).alias("correlation"))
            for i, a in enumerate(numeric) for j, b in enumerate(numeric)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("use").drop("use")


def discount_summary(df: DataFrame, roles: Roles) -> DataFrame:
    """Average discount, discount/profit correlation, worst discount band."""
    d, p = _col(df, roles, "discount"), _col(df, roles, "profit")
    avg = df.agg(F.avg(d).alias("average_discount"))
    corr = _guarded_corr(df, F.col(d), F.col(p)).select(F.col("correlation").alias("discount_profit_correlation"))
    band = dim_perf(df, roles, ["discount_band"]).agg(
        F.min_by("dimension_value", F.struct("profit", "dimension_value")).alias("worst_discount_band"),
        F.min("profit").alias("worst_discount_band_profit"))
    return avg.crossJoin(corr).crossJoin(band)


def category_discounts(df: DataFrame, roles: Roles) -> DataFrame:
    """Mean discount (0-100) per category, highest first."""
    c, d = _col(df, roles, "category"), _col(df, roles, "discount")
    return df.groupBy(F.col(c).alias("category")).agg(F.avg(d).alias("average_discount_percent")) \
             .orderBy(F.col("average_discount_percent").desc(), "category")


def category_comparison(df: DataFrame, roles: Roles, categories: list[str]) -> DataFrame:
    """Named categories (>= 2) with metrics, first-to-last-year sales growth and the margin winner."""
    c, s, dt = _col(df, roles, "category"), _col(df, roles, "sales"), _col(df, roles, "date")
    wanted = [x.lower() for x in categories]
    sub = df.where(F.lower(F.col(c).cast("string")).isin(wanted))
    g = performance(sub, roles, "category", sort=False)
    y = sub.where(F.col(dt).isNotNull()).groupBy(F.col(c).alias("dimension_value"), F.year(dt).alias("_y")).agg(
        msum(F.coalesce(F.col(s), F.lit(0.0))).alias("_s"))
    gr = y.groupBy("dimension_value").agg(F.count(F.lit(1)).alias("_n"), F.min_by("_s", "_y").alias("_first"),
                                          F.max_by("_s", "_y").alias("_last"))
    gr = gr.where(F.col("_n") >= 2).select("dimension_value", profit_margin(F.col("_last") - F.col("_first"), F.col("_first"))
                                          .alias("sales_growth_percent"))
    out = g.join(gr, "dimension_value", "left")
    best = out.agg(F.max_by("dimension_value", F.struct("profit_margin_percent", F.col("dimension_value"))).alias("_w"))
    return out.crossJoin(F.broadcast(best)).withColumn("is_winner", F.col("dimension_value") == F.col("_w")).drop("_w") \
              .orderBy(F.col("profit_margin_percent").desc(), "dimension_value")


def _picks(df: DataFrame, roles: Roles) -> DataFrame:
    """One row of worst/best picks from one multi-dimension aggregate."""
    dims = [d for d in ("subcategory", "product", "category", "region") if _col(df, roles, d)] + ["discount_band"]
    t = dim_perf(df, roles, dims)
    def pick(dim, metric, best, name):
        key = F.struct(-F.col(metric) if best else F.col(metric), F.col("dimension_value"))
        v = F.when(F.col("dimension") == dim, F.col("dimension_value"))
        k = F.when(F.col("dimension") == dim, key)
        m = F.when(F.col("dimension") == dim, F.col(metric))
        return [F.min_by(v, k).alias(name), (F.max(m) if best else F.min(m)).alias(f"{name}_{metric}")]
    return t.agg(*pick("subcategory", "profit", False, "worst_subcategory"), *pick("discount_band", "profit", False, "worst_discount_band"),
                 *pick("product", "profit", False, "worst_product"), *pick("category", "profit_margin_percent", False, "lowest_margin_category"),
                 *pick("category", "profit_margin_percent", True, "best_margin_category"), *pick("region", "profit", True, "best_profit_region"))


def _totals(df: DataFrame, roles: Roles) -> DataFrame:
    s, p = _col(df, roles, "sales"), _col(df, roles, "profit")
    t = df.agg(F.coalesce(msum(s), F.lit(0.0)).alias("sales"), F.coalesce(msum(p), F.lit(0.0)).alias("profit"),
               F.sum((F.col(p) < 0).cast("long")).alias("loss_rows"), F.count(F.lit(1)).alias("rows"),
               F.coalesce(msum(F.when(F.col(p) < 0, F.col(p))), F.lit(0.0)).alias("loss_amount"))
    return t.withColumn("profit_margin_percent", profit_margin("profit", "sales")) \
            .withColumn("loss_row_percent", F.col("loss_rows") / F.col("rows") * 100)


def business_health(df: DataFrame, roles: Roles) -> DataFrame:
    """Health metrics plus the lowest-margin category and the worst sub-category."""
    return _totals(df, roles).crossJoin(_picks(df, roles).select(
        "lowest_margin_category", "lowest_margin_category_profit_margin_percent", "worst_subcategory", "worst_subcategory_profit"))


def profit_killers(df: DataFrame, roles: Roles, n_products: int = 5) -> DataFrame:
    """Worst sub-category, worst discount band and the worst ``n`` loss-making products."""
    t = dim_perf(df, roles, [d for d in ("subcategory", "product") if _col(df, roles, d)] + ["discount_band"])
    w = Window.partitionBy("dimension").orderBy("profit", "dimension_value")
    t = t.withColumn("_rn", F.row_number().over(w))
    keep = ((F.col("dimension") != "product") & (F.col("_rn") == 1)) | \
           ((F.col("dimension") == "product") & (F.col("_rn") <= n_products) & (F.col("profit") < 0))
    return t.where(keep).select("dimension", "dimension_value", "sales", "profit", "profit_margin_percent",
                                F.col("_rn").alias("position")).orderBy("dimension", "position")


def category_check(df: DataFrame, roles: Roles, category: str) -> DataFrame:
    """One category's metrics, whether it is the lowest-margin category, its worst sub-category."""
    c = _col(df, roles, "category")
    g = performance(df, roles, "category", sort=False)
    low = g.agg(F.min_by("dimension_value", F.struct("profit_margin_percent", "dimension_value")).alias("_low"))
    row = g.crossJoin(F.broadcast(low)).where(F.lower(F.col("dimension_value").cast("string")) == category.lower()) \
           .withColumn("is_lowest_margin_category", F.col("dimension_value") == F.col("_low")).drop("_low")
    sub = performance(df.where(ci_equals(c, category)), roles, "subcategory", sort=False).agg(
        F.min_by("dimension_value", F.struct("profit", "dimension_value")).alias("worst_subcategory"),
        F.min("profit").alias("worst_subcategory_profit"))
    return row.crossJoin(sub)


def category_subcategories(df: DataFrame, roles: Roles, category: str) -> DataFrame:
    """Sub-categories inside a category, weakest profit first."""
    c = _col(df, roles, "category")
    return performance(df.where(F.col(c).cast("string") == category), roles, "subcategory", sort=False) \
        .orderBy("profit", "dimension_value")


def region_profile(df: DataFrame, roles: Roles, region: str, n: int = 5) -> DataFrame:
    """A region's row in the region comparison, its top products by sales and
    top sub-categories by profit (``section`` tells which)."""
    r = _col(df, roles, "region")
    comp = performance(df, roles, "region", sort=False).withColumn("section", F.lit("region_comparison")) \
        .withColumn("position", F.row_number().over(Window.orderBy(F.col("profit").desc(), "dimension_value")))
    sub = df.where(ci_equals(r, region))
    t = dim_perf(sub, roles, ["product", "subcategory"])
    w = Window.partitionBy("dimension").orderBy(
        F.when(F.col("dimension") == "product", -F.col("sales")).otherwise(-F.col("profit")), "dimension_value")
    t = t.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n) \
         .withColumn("section", F.concat(F.lit("top_"), F.col("dimension"))).drop("dimension")
    cols = ["section", "position", "dimension_value", "sales", "profit", "profit_margin_percent", "row_count"]
    return comp.select(*cols).unionByName(t.select(*cols)).orderBy("section", "position")


def fix_list(df: DataFrame, roles: Roles) -> DataFrame:
    """Total sales and what to fix first (worst sub-category, band, product)."""
    return _totals(df, roles).select("sales").crossJoin(_picks(df, roles).select(
        "worst_subcategory", "worst_subcategory_profit", "worst_discount_band", "worst_discount_band_profit",
        "worst_product", "worst_product_profit"))


def loss_order_diagnosis(df: DataFrame, roles: Roles) -> DataFrame:
    """Loss rows and amount with the worst band, sub-category and product."""
    return _totals(df, roles).select("loss_rows", "loss_amount").crossJoin(_picks(df, roles).select(
        "worst_discount_band", "worst_discount_band_profit", "worst_subcategory", "worst_subcategory_profit",
        "worst_product", "worst_product_profit"))


def executive_top3(df: DataFrame, roles: Roles) -> DataFrame:
    """Company totals and the three actions (worst band, worst sub-category, best-margin category)
    plus the best region by profit."""
    return _totals(df, roles).select("sales", "profit", "profit_margin_percent").crossJoin(_picks(df, roles).select(
        "worst_discount_band", "worst_discount_band_profit", "worst_subcategory", "worst_subcategory_profit",
        "best_margin_category", "best_margin_category_profit_margin_percent", "best_profit_region", "best_profit_region_profit"))
