"""Grouped performance tables (E2-E6, D1-D3 eliminated).

The reference builds a grouped table and then left-joins three more grouped
tables onto it (order counts, unresolved counts).  Here it is one
``groupBy().agg()``: partial aggregation happens map-side, one shuffle on the
group key, and grand totals come from a one-row aggregate over the (already
aggregated) groups, broadcast back with a cross join -- a one-row side is the
only thing ever broadcast, so its size is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import discount_band, month_key, msum, profit_margin, quarter_key, year_key
from ledgerlens.roles import Roles
from ledgerlens.session import in_slice, materialise, slice_count

# fixed values: what stands in for a dimension that the data lacks, first match wins
STAND_INS = {"product": ("subcategory", "category"), "region": ("state", "city", "country")}


def _c(df: DataFrame, roles: Roles, role: str) -> Column | None:
    c = roles.present(role, df.columns)
    return F.col(c) if c else None


def with_synthetic(df: DataFrame, roles: Roles, dim: str) -> tuple[DataFrame, str]:
    """Resolve a dimension name: a role, a column, or a derived key
    (``discount_band``, ``month``, ``quarter``, ``year``)."""
    if dim == "discount_band":
        d = _c(df, roles, "discount")
        if d is None:
            raise ValueError("discount role required for discount_band")
        return df.withColumn("discount_band", discount_band(d)), "discount_band"
    if dim in ("month", "quarter", "year"):
        dt = _c(df, roles, "date")
        if dt is None:
            raise ValueError("date role required for a period dimension")
        key = {"month": month_key, "quarter": quarter_key, "year": year_key}[dim](dt)
        # 2.13 #10: rows without a valid date are dropped from period grouping
        return df.filter(dt.isNotNull()).withColumn(dim, key), dim
    col = roles.present(dim, df.columns) or (dim if dim in df.columns else None)
    if col is None:   # G2: a coarser dimension stands in
        col = next((c for r in STAND_INS.get(dim, ()) if (c := roles.present(r, df.columns))), None)
    if col is None:
        raise ValueError(f"dimension {dim!r} not available")
    return df, col


def distinct_keys(df: DataFrame, roles: Roles, customers: bool = False) -> dict[str, str]:
    """The columns whose distinct values are counted, by the name of the count."""
    keys = {"order_count": roles.present("order_id", df.columns)}
    if customers:
        keys["customer_count"] = roles.customer_id if roles.present("customer_id", df.columns) else roles.present("customer", df.columns)
    return {n: k for n, k in keys.items() if k}


def metric_aggs(df: DataFrame, roles: Roles, *, customers: bool = False, cost: bool = False) -> list[Column]:
    """The shared aggregate list (missing roles are simply left out)."""
    distinct = distinct_keys(df, roles, customers)
    s, p, q, d = (_c(df, roles, r) for r in ("sales", "profit", "quantity", "discount"))
    aggs: list[Column] = []
    if s is not None:
        aggs.append(F.coalesce(msum(F.coalesce(s, F.lit(0.0))), F.lit(0.0)).alias("sales"))
    if p is not None:
        aggs.append(F.coalesce(msum(F.coalesce(p, F.lit(0.0))), F.lit(0.0)).alias("profit"))
    if q is not None:
        aggs.append(F.coalesce(F.sum(F.coalesce(q, F.lit(0.0))), F.lit(0.0)).alias("quantity"))
    if cost:
        c = _c(df, roles, "cost")
        if c is not None:
            aggs.append(F.coalesce(msum(F.coalesce(c, F.lit(0.0))), F.lit(0.0)).alias("cost"))
        elif s is not None and p is not None:
            aggs.append(F.coalesce(msum(F.coalesce(s, F.lit(0.0)) - F.coalesce(p, F.lit(0.0))), F.lit(0.0)).alias("cost"))
    if d is not None:
        aggs.append(F.avg(d).alias("average_discount"))
    aggs.append((F.count_distinct(F.col(distinct["order_count"])) if "order_count" in distinct else F.count(F.lit(1))).alias("order_count"))
    aggs.append(F.count(F.lit(1)).alias("row_count"))
    if s is not None:
        aggs.append(F.sum(s.isNull().cast("long")).alias("unresolved_sales_rows"))
    if p is not None:
        aggs.append(F.sum(p.isNull().cast("long")).alias("unresolved_profit_rows"))
        aggs.append(F.sum((p < 0).cast("long")).alias("loss_rows"))
    if "customer_count" in distinct:
        aggs.append(F.count_distinct(F.col(distinct["customer_count"])).alias("customer_count"))
    return aggs


def add_shares(g: DataFrame) -> DataFrame:
    """Margin, contribution and loss-share columns on an aggregated table."""
    if "profit" not in g.columns or "sales" not in g.columns:
        return g
    g = g.withColumn("profit_margin_percent", profit_margin("profit", "sales")) \
         .withColumn("loss_amount", F.when(F.col("profit") < 0, F.col("profit")).otherwise(F.lit(0.0)))
    tot = g.agg(msum("sales").alias("_ts"), msum("profit").alias("_tp"),
                F.abs(msum("loss_amount")).alias("_tl"))
    g = g.crossJoin(F.broadcast(tot))
    share = lambda num, den: F.when(F.col(den) != 0, num / F.col(den) * F.lit(100.0)).otherwise(F.lit(0.0))
    return (g.withColumn("sales_contribution_percent", share(F.col("sales"), "_ts"))
             .withColumn("profit_contribution_percent", share(F.col("profit"), "_tp"))
             .withColumn("loss_contribution_percent", share(F.abs(F.col("loss_amount")), "_tl"))
             .drop("_ts", "_tp", "_tl"))


def written_groups(df: DataFrame, key: Column, groups, name: str = "groups", slices: int | None = None) -> DataFrame:
    """``groups(df)``, a table by ``key``, written in slices of the keys: only a slice's rows are shuffled at a time."""
    n = slice_count(df) if slices is None else slices
    return materialise([groups(df.where(in_slice(key, i, n))) for i in range(n)], name)


def performance(df: DataFrame, roles: Roles, dim: str, *, customers: bool = False, cost: bool = False,
                sort: bool = True, written: bool = False) -> DataFrame:
    """One row per dimension value, ordered by profit desc (value asc on ties).  ``written``: the groups are read more
    than once, so they are written first (:func:`written_groups`)."""
    df, key = with_synthetic(df, roles, dim)
    aggs = metric_aggs(df, roles, customers=customers, cost=cost)
    groups = lambda rows: rows.groupBy(F.col(key).alias("dimension_value")).agg(*aggs)
    g = written_groups(df, F.col(key), groups) if written else groups(df)
    g = add_shares(g)
    g = g.withColumn("order_count_basis", F.lit("distinct_order_id" if roles.present("order_id", df.columns) else "row_count"))
    if sort:
        order = "profit" if "profit" in g.columns else "sales"
        g = g.orderBy(F.col(order).desc(), F.col("dimension_value").asc_nulls_first())
    return g


PERF_COLUMNS = ["dimension_value", "sales", "profit", "quantity", "average_discount", "order_count", "row_count",
                "unresolved_sales_rows", "unresolved_profit_rows", "loss_rows", "profit_margin_percent",
                "loss_amount", "sales_contribution_percent", "profit_contribution_percent",
                "loss_contribution_percent", "order_count_basis"]


def performance_over(df: DataFrame, roles: Roles, dims: list[str], **kw) -> DataFrame:
    """Several dimensions at once, tagged with ``dimension`` (H1 union)."""
    parts = [performance(df, roles, d, sort=False, **kw)
             .withColumn("dimension_value", F.col("dimension_value").cast("string"))
             .withColumn("dimension", F.lit(d)) for d in dims]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def combo_performance(df: DataFrame, roles: Roles, dim_a: str, dim_b: str) -> DataFrame:
    """Any two dimensions -> sales, profit, rows, margin."""
    df, a = with_synthetic(df, roles, dim_a)
    df, b = with_synthetic(df, roles, dim_b)
    s, p = _c(df, roles, "sales"), _c(df, roles, "profit")
    g = df.groupBy(F.col(a).alias(dim_a), F.col(b).alias(dim_b)).agg(
        F.coalesce(msum(F.coalesce(s, F.lit(0.0))), F.lit(0.0)).alias("sales"),
        F.coalesce(msum(F.coalesce(p, F.lit(0.0))), F.lit(0.0)).alias("profit"),
        F.count(F.lit(1)).alias("row_count"))
    return g.withColumn("profit_margin_percent", profit_margin("profit", "sales")) \
            .orderBy(F.col("profit").desc(), F.col(dim_a), F.col(dim_b))


def _distinct_counts(ex: DataFrame, key: str, name: str) -> DataFrame:
    """(dimension, dimension_value, ``name``): the distinct values of ``key``; pairs that come again meet before the shuffle."""
    own = ex.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "dimension", "dimension_value").distinct()
    return own.groupBy("dimension", "dimension_value").agg(F.count(F.lit(1)).alias(name))


def dim_perf(df: DataFrame, roles: Roles, dims: list[str], *, customers: bool = False, cost: bool = True) -> DataFrame:
    """One pass for many dimensions (the GROUPING SETS shape): every row is
    expanded to one ``(dimension, dimension_value)`` pair per dimension, then a
    single aggregate runs with map-side partial aggregation.  Distinct counts
    have a pass of their own each (:func:`_distinct_counts`).  The groups are
    written once (in slices, :func:`written_groups`): they are read for the per-dimension
    totals, a small (one row per dimension) broadcast join, and by the caller, often more than once."""
    cols = {}
    for d in dims:
        df, key = with_synthetic(df, roles, d) if d not in ("month", "quarter", "year") else _period_col(df, roles, d)
        cols[d] = key
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(k).cast("string").alias("dimension_value"))
                                for d, k in cols.items()])).alias("_p")
    distinct = distinct_keys(df, roles, customers)
    ex = df.select("*", pairs).select("*", "_p.dimension", "_p.dimension_value").drop("_p")
    aggs = metric_aggs(ex, roles.with_roles(order_id=None), cost=cost)

    def groups(rows: DataFrame) -> DataFrame:
        g = rows.groupBy("dimension", "dimension_value").agg(*aggs)
        names = g.columns
        for name, key in distinct.items():
            found = _distinct_counts(rows, key, "_n").select(F.col("dimension").alias("_d"), F.col("dimension_value").alias("_v"), "_n")
            same = (F.col("dimension") == F.col("_d")) & F.col("dimension_value").eqNullSafe(F.col("_v"))
            g = g.drop(name).join(found, same, "left").withColumn(name, F.coalesce("_n", F.lit(0).cast("long"))).drop("_d", "_v", "_n")
        return g.select(*names, *[n for n in distinct if n not in names])

    g = written_groups(ex, F.struct("dimension", "dimension_value"), groups, slices=slice_count(df))
    g = g.withColumn("profit_margin_percent", profit_margin("profit", "sales")) \
         .withColumn("loss_amount", F.when(F.col("profit") < 0, F.col("profit")).otherwise(F.lit(0.0)))
    tot = g.groupBy("dimension").agg(msum("sales").alias("_ts"), msum("profit").alias("_tp"),
                                     F.abs(msum("loss_amount")).alias("_tl"))
    share = lambda num, den: F.when(F.col(den) != 0, num / F.col(den) * F.lit(100.0)).otherwise(F.lit(0.0))
    return (g.join(F.broadcast(tot), "dimension")
             .withColumn("sales_contribution_percent", share(F.col("sales"), "_ts"))
             .withColumn("profit_contribution_percent", share(F.col("profit"), "_tp"))
             .withColumn("loss_contribution_percent", share(F.abs(F.col("loss_amount")), "_tl"))
             .drop("_ts", "_tp", "_tl"))


def _period_col(df: DataFrame, roles: Roles, dim: str) -> tuple[DataFrame, str]:
    """Period key that stays NULL (instead of dropping the row) for undated rows,
    so other dimensions in a multi-dimension pass keep every row."""
    dt = _c(df, roles, "date")
    key = {"month": month_key, "quarter": quarter_key, "year": year_key}[dim](dt)
    return df.withColumn(f"__{dim}", key), f"__{dim}"
