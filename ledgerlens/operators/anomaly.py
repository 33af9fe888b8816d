"""Anomalies.

IQR bounds and row-level percentiles are exact global scalars
(``quantiles.exact_quantiles``) broadcast back as a one-row table.  "First 20 rows" needs a
total order: all columns, ascending.  Per-metric samples use
``row_number() <= 20`` over a window partitioned by metric (partial group
limit before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import msum, profit_margin, severity_from_pct_drop
from ledgerlens.operators.quantiles import exact_quantiles, iqr_bounds, outside
from ledgerlens.roles import Roles

# --- fixed values --------------------------------------------------------
ANOMALY_METRICS = ("sales", "profit", "quantity", "discount")
SAMPLE_ROWS = 20
DROP_THRESHOLD = -0.25
SPIKE_THRESHOLD = 0.25
SPIKE_HIGH = 0.50
# ------------------------------------------------------------------------


def _metric_cols(df, roles):
    return [(m, roles.present(m, df.columns)) for m in ANOMALY_METRICS if roles.present(m, df.columns)]


def _is_out(m, c):
    return outside(m, F.col(c))


def metric_outliers(df: DataFrame, roles: Roles) -> DataFrame:
    """IQR outlier count per metric with severity (metrics with no outlier omitted)."""
    cols = _metric_cols(df, roles)
    t = df.crossJoin(F.broadcast(iqr_bounds(df, cols)))
    aggs = [F.first("_rows").alias("_rows")]
    for m, c in cols:
        aggs.append(F.sum(_is_out(m, c).cast("long")).alias(f"{m}__count"))
        for b in ("q1", "q3"):
            aggs.append(F.first(f"{m}_{b}").alias(f"{m}__{b}"))
    one = t.agg(*aggs)
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}__count").alias("outlier_count"),
                     (F.col(f"{m}__q1") - 1.5 * (F.col(f"{m}__q3") - F.col(f"{m}__q1"))).alias("lower_bound"),
                     (F.col(f"{m}__q3") + 1.5 * (F.col(f"{m}__q3") - F.col(f"{m}__q1"))).alias("upper_bound")) for m, _ in cols]
    out = one.select("_rows", F.explode(F.array(*rows)).alias("r")).select("_rows", "r.*").where(F.col("outlier_count") > 0)
    sev = F.when(F.col("outlier_count") < F.greatest(F.lit(5.0), F.col("_rows") * 0.05), "Medium").otherwise("High")
    return out.withColumn("severity", sev).drop("_rows")


def unusual_rows(df: DataFrame, roles: Roles, n: int = SAMPLE_ROWS) -> DataFrame:
    """J3 + J5 samples: first ``n`` outlier rows per metric, and first ``n``
    high-sales low-margin rows, tagged with ``anomaly_metric``."""
    cols = _metric_cols(df, roles)
    base = df.columns
    t = df.crossJoin(F.broadcast(iqr_bounds(df, cols)))
    parts = [t.where(_is_out(m, c)).select(*base, F.lit(roles.get(m)).alias("anomaly_metric")) for m, c in cols]
    parts.append(high_sales_low_margin_rows(df, roles).select(*base, F.lit("high_sales_low_margin").alias("anomaly_metric")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("anomaly_metric").orderBy(*[F.col(c).asc_nulls_first() for c in base])
    return u.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def high_sales_low_margin_rows(df: DataFrame, roles: Roles) -> DataFrame:
    """J5 rows: sales >= p75(sales) and row margin < median row margin."""
    s, p = roles.present("sales", df.columns), roles.present("profit", df.columns)
    s0, p0 = F.coalesce(F.col(s), F.lit(0.0)), F.coalesce(F.col(p), F.lit(0.0))
    t = df.withColumn("_s", s0).withColumn("_m", profit_margin(p0, s0))
    th = exact_quantiles(t, {"_q": (F.col("_s"), 0.75), "_med": (F.col("_m"), 0.5)})
    return t.crossJoin(F.broadcast(th)).where((F.col("_s") >= F.col("_q")) & (F.col("_m") < F.col("_med"))) \
            .drop("_s", "_m", "_q", "_med")


def high_sales_low_margin(df: DataFrame, roles: Roles) -> DataFrame:
    """J5 summary: count and severity (High when more than 10 % of rows)."""
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    bad = high_sales_low_margin_rows(df, roles).agg(F.count(F.lit(1)).alias("flagged_rows"))
    return bad.crossJoin(rows).where(F.col("flagged_rows") > 0).select(
        F.lit("profit_margin").alias("metric"), "flagged_rows",
        F.when(F.col("flagged_rows") > F.col("_rows") * 0.1, "High").otherwise("Medium").alias("severity"))


def period_anomalies(df: DataFrame, roles: Roles) -> DataFrame:
    """Monthly sales/profit drops below -25 % and mean-discount rises above 25 %."""
    d = roles.present("date", df.columns)
    specs = [(m, roles.present(m, df.columns)) for m in ("sales", "profit", "discount") if roles.present(m, df.columns)]
    aggs = [(F.avg(c) if m == "discount" else msum(c)).alias(m) for m, c in specs]
    g = df.where(F.col(d).isNotNull()).groupBy(F.date_format(F.col(d), "yyyy-MM").alias("period")).agg(*aggs)
    w = Window.orderBy("period")
    parts = []
    for m, _ in specs:
        prev = F.lag(m).over(w)
        t = g.select("period", F.col(m).alias("value"), F.when(prev != 0, (F.col(m) - prev) / prev).alias("change"))
        if m == "discount":
            t = t.where(F.col("change") > SPIKE_THRESHOLD).withColumn(
                "severity", F.when(F.col("change") < SPIKE_HIGH, "Medium").otherwise("High")).withColumn("kind", F.lit("spike"))
        else:
            t = t.where(F.col("change") < DROP_THRESHOLD).withColumn("severity", severity_from_pct_drop(F.col("change"))) \
                 .withColumn("kind", F.lit("drop"))
        parts.append(t.withColumn("metric", F.lit(roles.get(m))))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.withColumn("change_percent", F.col("change") * 100).drop("change").orderBy("metric", "period")
