"""Whole-table KPIs and basic answers.

Each is a single global aggregate (partial per partition, one tiny final
stage) -- no shuffle of rows.  Medians come from ``quantiles.exact_quantiles``,
which is exact and never gathers the values in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import cents, msum, profit_margin, safe_div
from ledgerlens.operators.digests import row_counts
from ledgerlens.operators.quantiles import with_quantiles
from ledgerlens.roles import Roles


def _c(df, roles, role) -> Column | None:
    c = roles.present(role, df.columns)
    return F.col(c) if c else None


def customer_column(df: DataFrame, roles: Roles, prefer: str = "id") -> str | None:
    """2.13 #20: one customer key, id first by default, else name."""
    order = ("customer_id", "customer") if prefer == "id" else ("customer", "customer_id")
    for r in order:
        c = roles.present(r, df.columns)
        if c:
            return c
    return None


def kpis(df: DataFrame, roles: Roles) -> DataFrame:
    """One-row KPI table."""
    s, p, q, d, o = (_c(df, roles, r) for r in ("sales", "profit", "quantity", "discount", "order_id"))
    cust = customer_column(df, roles)
    zero = F.lit(0.0)
    aggs = [F.count(F.lit(1)).alias("total_orders")]
    if s is not None:
        aggs += [F.coalesce(msum(s), zero).alias("total_sales"), (cents(F.sum(s)) / F.count(s)).alias("average_order_value"),
                 F.sum(s.isNull().cast("long")).alias("unresolved_sales_rows")]
    if p is not None:
        aggs += [F.coalesce(msum(p), zero).alias("total_profit"),
                 F.sum((p < 0).cast("long")).alias("loss_making_orders_count"),
                 (F.avg(F.when(p < 0, 1.0).otherwise(0.0)) * 100).alias("loss_making_orders_percent"),
                 F.coalesce(msum(F.when(p < 0, p)), zero).alias("total_loss_amount"),
                 F.sum((p > 0).cast("long")).alias("profitable_orders_count"),
                 (F.avg(F.when(p > 0, 1.0).otherwise(0.0)) * 100).alias("profitable_orders_percent"),
                 F.sum(p.isNull().cast("long")).alias("unresolved_profit_rows")]
    if q is not None:
        aggs.append(F.coalesce(F.sum(q), zero).alias("total_quantity"))
    if d is not None:
        aggs.append(F.avg(d).alias("average_discount"))
    aggs.append((F.count_distinct(o) if o is not None else F.count(F.lit(1))).alias("unique_orders"))
    if cust:
        aggs.append(F.count_distinct(F.col(cust)).alias("unique_customers"))
    k = with_quantiles(df.agg(*aggs), df, {"median_order_value": (s, 0.5)} if s is not None else {})
    out = k.withColumn("order_rows", F.col("total_orders")) \
           .withColumn("order_count_basis", F.lit("row_count" if o is not None else "row_count_proxy_no_order_id"))
    if s is not None:
        out = out.withColumn("unique_order_average_value",
                             F.when(F.col("unique_orders") > 0, cents(F.col("total_sales")) / F.col("unique_orders")))
    if s is not None and p is not None:
        out = out.withColumn("profit_margin_percent",
                             F.when(F.col("total_sales") != 0, profit_margin("total_profit", "total_sales")))
    if cust:
        for m in ("sales", "profit"):
            if f"total_{m}" in out.columns:
                out = out.withColumn(f"{m}_per_customer", F.when(F.col("unique_customers") > 0,
                                                                 cents(F.col(f"total_{m}")) / F.col("unique_customers")))
    return out


def best_worst(df: DataFrame, roles: Roles) -> DataFrame:
    """Arg-max/arg-min by dimension; ties broken by value ascending."""
    specs = [("best_category_by_sales", "category", "sales", True), ("best_region_by_sales", "region", "sales", True),
             ("best_category_by_profit", "category", "profit", True), ("worst_category_by_profit", "category", "profit", False),
             ("worst_region_by_profit", "region", "profit", False), ("best_product_by_profit", "product", "profit", True),
             ("worst_product_by_profit", "product", "profit", False)]
    parts = []
    for dim in ("category", "region", "product"):
        col = roles.present(dim, df.columns)
        if not col:
            continue
        g = df.groupBy(F.col(col).cast("string").alias("v")).agg(
            F.coalesce(msum(_c(df, roles, "sales")), F.lit(0.0)).alias("sales"),
            F.coalesce(msum(_c(df, roles, "profit")), F.lit(0.0)).alias("profit"))
        picks = [(F.min_by("v", F.struct(-F.col(m), F.col("v"))) if best else F.min_by("v", F.struct(F.col(m), F.col("v")))).alias(name)
                 for name, d, m, best in specs if d == dim]
        parts.append(g.agg(*picks))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out.select(*[n for n, *_ in specs if n in out.columns])


def _long(one_row: DataFrame, metrics: list[str], fields: list[str]) -> DataFrame:
    """Reshape a one-row aggregate ``<metric>__<field>`` into one row per metric."""
    structs = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}__{f}").alias(f) for f in fields]) for m in metrics]
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def basic_stat(df: DataFrame, roles: Roles) -> DataFrame:
    """total/average/min/max/median per metric."""
    metrics = [r for r in ("sales", "profit", "quantity", "discount", "cost") if roles.present(r, df.columns)]
    aggs = []
    for m in metrics:
        x = _c(df, roles, m)
        aggs += [F.coalesce(msum(x) if m in ("sales", "profit", "cost") else F.sum(x), F.lit(0.0)).alias(f"{m}__total"), (cents(F.sum(x)) / F.count(x) if m in ("sales", "profit", "cost") else F.avg(x)).alias(f"{m}__average"),
                 F.min(x).cast("double").alias(f"{m}__minimum"), F.max(x).cast("double").alias(f"{m}__maximum")]
    one = with_quantiles(df.agg(*aggs), df, {f"{m}__median": (_c(df, roles, m), 0.5) for m in metrics})
    return _long(one, metrics, ["total", "average", "minimum", "maximum", "median"])


def basic_aggregation(df: DataFrame, roles: Roles) -> DataFrame:
    """Total sales, profit, cost, quantity; mean discount."""
    specs = [("total_sales", "sales", msum), ("total_profit", "profit", msum), ("total_cost", "cost", msum),
             ("total_quantity", "quantity", F.sum), ("average_discount", "discount", F.avg)]
    aggs, names = [], []
    for name, role, fn in specs:
        x = _c(df, roles, role)
        if x is not None:
            aggs.append(fn(x).cast("double").alias(f"{name}__value"))
            names.append(name)
    return _long(df.agg(*aggs), names, ["value"])


def unique_count(df: DataFrame, roles: Roles, what: str) -> DataFrame:
    """Distinct customers (id preferred) or orders."""
    col = customer_column(df, roles) if what == "customers" else roles.present("order_id", df.columns)
    return df.agg(F.count_distinct(F.col(col)).alias(f"unique_{what}"), F.lit(col).alias("column_used"))


def unique_values(df: DataFrame, roles: Roles, dim: str) -> DataFrame:
    """Sorted non-empty distinct values of a dimension."""
    col = roles.present(dim, df.columns) or dim
    v = F.trim(F.col(col).cast("string"))
    return df.select(v.alias("value")).where(F.col("value").isNotNull() & (F.col("value") != "")) \
             .distinct().orderBy("value")


def aov(df: DataFrame, roles: Roles) -> DataFrame:
    """Mean and median line value, total/distinct orders."""
    s, o = _c(df, roles, "sales"), _c(df, roles, "order_id")
    out = df.agg((cents(F.sum(s)) / F.count(s)).alias("mean_line_value"),
                 F.coalesce(msum(s), F.lit(0.0)).alias("total_sales"),
                 (F.count_distinct(o) if o is not None else F.count(F.lit(1))).alias("distinct_orders"),
                 F.count(s).alias("rows_used"))
    out = with_quantiles(out, df, {"median_line_value": (s, 0.5)})
    return out.withColumn("sales_per_order", safe_div(cents(F.col("total_sales")), "distinct_orders", None))


def date_range(df: DataFrame, roles: Roles) -> DataFrame:
    """Min, max and invalid (NULL) date count."""
    d = _c(df, roles, "date")
    return df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"),
                  F.sum(d.isNull().cast("long")).alias("invalid_dates"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing count and % per column that has any, most first."""
    n = F.count(F.lit(1))
    aggs = [F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__missing") for c in df.columns]
    one = df.agg(n.alias("_rows"), *aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__missing").alias("missing_count")) for c in df.columns]
    out = one.select("_rows", F.explode(F.array(*structs)).alias("r")).select("_rows", "r.*")
    return out.where(F.col("missing_count") > 0) \
              .withColumn("missing_percent", F.col("missing_count") / F.col("_rows") * 100).drop("_rows") \
              .orderBy(F.col("missing_count").desc(), "column")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first occurrence (NULL-safe: groupBy treats NULLs equal)."""
    return row_counts(df).select("duplicate_rows", F.col("rows").alias("row_count"))


def non_unique_profile(df: DataFrame, roles: Roles) -> DataFrame:
    """Duplicate rows, rows, distinct orders, rows beyond distinct orders."""
    o = _c(df, roles, "order_id")
    dup = duplicate_rows(df)
    orders = df.agg(F.count_distinct(o).alias("distinct_orders"))
    return dup.crossJoin(orders).withColumn("rows_beyond_distinct_orders", F.col("row_count") - F.col("distinct_orders"))


LISTED = 50   # values that a profile names; how many there are stands beside them


def _value_list(df: DataFrame, col: str | None, role: str) -> DataFrame:
    """One row: the first LISTED values in order, and the number of all."""
    if not col:
        return df.sparkSession.range(1).select(F.lit(None).cast("string").alias(f"{role}_list"), F.lit(0).cast("long").alias(f"{role}_values"))
    d = df.select(F.col(col).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    named = d.orderBy("v").limit(LISTED).agg(F.array_join(F.sort_array(F.collect_list("v")), ", ").alias(f"{role}_list"))
    return named.crossJoin(d.agg(F.count("v").alias(f"{role}_values")))


def dataset_profile(df: DataFrame, roles: Roles) -> DataFrame:
    """One-row quick profile."""
    s, p, o, d = (_c(df, roles, r) for r in ("sales", "profit", "order_id", "date"))
    cust = customer_column(df, roles)
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0)).alias("missing_cells"),
                  F.min(d).alias("min_date"), F.max(d).alias("max_date"),
                  F.coalesce(msum(s), F.lit(0.0)).alias("total_sales"), F.coalesce(msum(p), F.lit(0.0)).alias("total_profit"),
                  F.count_distinct(o).alias("unique_orders"), F.count_distinct(F.col(cust)).alias("unique_customers"))
    out = base.crossJoin(duplicate_rows(df).select("duplicate_rows"))
    for role in ("category", "region", "segment"):
        out = out.crossJoin(_value_list(df, roles.present(role, df.columns), role))
    return out


def health_metrics(df: DataFrame, roles: Roles) -> DataFrame:
    """Sales, profit, loss rows/%, margin, distinct orders, shared rows."""
    s, p, o = (_c(df, roles, r) for r in ("sales", "profit", "order_id"))
    out = df.agg(F.coalesce(msum(s), F.lit(0.0)).alias("sales"), F.coalesce(msum(p), F.lit(0.0)).alias("profit"),
                 F.sum((p < 0).cast("long")).alias("loss_rows"), F.count(F.lit(1)).alias("rows"),
                 F.count_distinct(o).alias("distinct_orders"))
    return out.withColumn("loss_row_percent", safe_div(F.col("loss_rows") * 100.0, "rows")) \
              .withColumn("profit_margin_percent", profit_margin("profit", "sales")) \
              .withColumn("rows_sharing_an_order", F.col("rows") - F.col("distinct_orders"))


