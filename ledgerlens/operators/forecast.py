"""Forecast and backtest (J1, J2) as Spark aggregates over the period history.

The history has one row per period (bounded by the calendar, not the data).
Every ensemble part is a plain aggregate or window over it:
  MA(3)      avg over the last three indices
  EWM(.45)   closed form: weight .45*.55^(n-1-i) for i >= 1, .55^(n-1) for i = 0
  trend      regr_slope / regr_intercept on the index
  seasonal   self-lookup of the value 12 periods back (or the last value)
  backtest   one-step MA(3) via a rows(-3, -1) window, from index 3, n >= 5
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import cents, period_key
from ledgerlens.roles import Roles

# --- fixed values --------------------------------------------------------
W_MA, W_EWM, W_TREND, W_SEASONAL = 0.35, 0.30, 0.20, 0.15
EWM_ALPHA = 0.45
EWM_DECAY = 0.55          # 1 - alpha
SEASON = 12
MIN_PERIODS = 3
BACKTEST_MIN_POINTS = 5
VARIABILITY_DEFAULT, VARIABILITY_MIN, VARIABILITY_MAX = 0.15, 0.10, 0.35
METHOD = "ensemble: moving average + exponential smoothing + trend + seasonal naive"
# ------------------------------------------------------------------------


def history(df: DataFrame, roles: Roles, frequency: str = "M") -> DataFrame:
    """Per-period sales/profit with a 0-based index (dated rows; money snapped to cents)."""
    d, s, p = (roles.present(r, df.columns) for r in ("date", "sales", "profit"))
    g = df.where(F.col(d).isNotNull()).groupBy(period_key(F.col(d), frequency).alias("period")).agg(
        cents(F.sum(F.coalesce(F.col(s), F.lit(0.0)))).alias("sales"),
        cents(F.sum(F.coalesce(F.col(p), F.lit(0.0)))).alias("profit"))
    return g.withColumn("idx", F.row_number().over(Window.orderBy("period")) - 1)


def _after(period, step, frequency: str):
    """The key of the period ``step`` periods later."""
    f = frequency.upper()[0]
    if f == "M":
        return F.date_format(F.add_months(F.to_date(F.concat(period, F.lit("-01"))), step), "yyyy-MM")
    year = F.substring(period, 1, 4).cast("int")
    if f == "Q":
        at = year * 4 + F.substring(period, 6, 1).cast("int") - 1 + step
        return F.concat(F.floor(at / 4).cast("string"), F.lit("Q"), (at % 4 + 1).cast("string"))
    return (year + step).cast("string")


def _series_stats(h: DataFrame, m: str) -> DataFrame:
    """One row: n, last, ma3, ewm, slope, intercept, mae, mape for metric ``m``."""
    n = h.agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last_idx"), F.max("period").alias("last_period"))
    t = h.crossJoin(F.broadcast(n))
    w3 = Window.orderBy("idx").rowsBetween(-3, -1)
    t = t.withColumn("_ma_prev", F.avg(m).over(w3))
    ewm_w = F.when(F.col("idx") == 0, F.pow(F.lit(EWM_DECAY), F.col("n") - 1)) \
             .otherwise(F.lit(EWM_ALPHA) * F.pow(F.lit(EWM_DECAY), F.col("n") - 1 - F.col("idx")))
    err = F.when((F.col("idx") >= 3) & (F.col("n") >= BACKTEST_MIN_POINTS), F.abs(F.col(m) - F.col("_ma_prev")))
    act = F.when((F.col("idx") >= 3) & (F.col("n") >= BACKTEST_MIN_POINTS), F.abs(F.col(m)))
    return t.groupBy("n", "last_idx", "last_period").agg(
        F.avg(F.when(F.col("idx") >= F.col("n") - 3, F.col(m))).alias("ma"),
        F.sum(ewm_w * F.col(m)).alias("ewm"),
        F.regr_slope(F.col(m), F.col("idx").cast("double")).alias("slope"),
        F.regr_intercept(F.col(m), F.col("idx").cast("double")).alias("intercept"),
        F.max(F.when(F.col("idx") == F.col("last_idx"), F.col(m))).alias("last_value"),
        F.avg(err).alias("mae"),
        (F.avg(F.when(act > 0, err / act)) * 100).alias("mape"))


def _predict(h: DataFrame, m: str, periods: int) -> DataFrame:
    st = _series_stats(h, m)
    steps = h.sparkSession.range(1, periods + 1).select(F.col("id").cast("int").alias("step"))
    t = steps.crossJoin(F.broadcast(st))
    seas_idx = F.when(F.col("n") >= SEASON, F.col("n") - SEASON + (F.col("step") - 1) % SEASON).otherwise(F.col("last_idx"))
    t = t.withColumn("_sidx", seas_idx)
    hv = h.select(F.col("idx").alias("_sidx"), F.col(m).alias("seasonal"))
    t = t.join(F.broadcast(hv), "_sidx", "left")
    trend = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step")))
    trend = F.coalesce(trend, F.col("ma"))
    pred = F.greatest(F.lit(0.0), F.lit(W_MA) * F.col("ma") + F.lit(W_EWM) * F.col("ewm") + F.lit(W_TREND) * trend
                      + F.lit(W_SEASONAL) * F.col("seasonal"))
    return t.select("step", "last_period", pred.alias(f"predicted_{m}"), F.col("mae").alias(f"{m}_mae"),
                    F.col("mape").alias(f"{m}_mape_percent"), "n")


def variability(h: DataFrame) -> DataFrame:
    """clip(std(pct_change(sales)), .10, .35); .15 when undefined or zero."""
    w = Window.orderBy("idx")
    prev = F.lag("sales").over(w)
    pc = h.select(F.when(prev != 0, (F.col("sales") - prev) / prev).alias("pc"))
    sd = pc.agg(F.stddev_samp("pc").alias("sd"))
    v = F.when(F.col("sd").isNull() | (F.col("sd") == 0), F.lit(VARIABILITY_DEFAULT)).otherwise(F.col("sd"))
    return sd.select(F.least(F.greatest(v, F.lit(VARIABILITY_MIN)), F.lit(VARIABILITY_MAX)).alias("variability"))


def forecast(df: DataFrame, roles: Roles, periods: int = 3, frequency: str = "M") -> DataFrame:
    """Next ``periods`` months, quarters or years with bands and a confidence label (empty below 3 periods)."""
    h = history(df, roles, frequency)
    ps, pp = _predict(h, "sales", periods), _predict(h, "profit", periods).select("step", "predicted_profit",
                                                                                 "profit_mae", "profit_mape_percent")
    t = ps.join(pp, "step").crossJoin(F.broadcast(variability(h))).where(F.col("n") >= MIN_PERIODS)
    nxt = _after(F.col("last_period"), F.col("step"), frequency)
    v = F.col("variability")
    s, p = F.col("predicted_sales"), F.col("predicted_profit")
    conf = (F.when(F.col("sales_mape_percent").isNull(), "Medium").when(F.col("sales_mape_percent") <= 15, "High")
            .when(F.col("sales_mape_percent") <= 30, "Medium").otherwise("Low"))
    return t.select(
        "step", nxt.alias("forecast_period"), s.alias("predicted_sales"), p.alias("predicted_profit"),
        (s * (1 - v)).alias("sales_lower_estimate"), (s * (1 + v)).alias("sales_upper_estimate"),
        F.when(p < 0, p * (1 + v)).otherwise(p * (1 - v)).alias("profit_lower_estimate"),
        F.when(p < 0, p * (1 - v)).otherwise(p * (1 + v)).alias("profit_upper_estimate"),
        F.lit(METHOD).alias("method_used"), conf.alias("confidence"), "variability").orderBy("step")


def backtest(df: DataFrame, roles: Roles) -> DataFrame:
    """One-step MA(3) backtest errors for sales and profit."""
    h = history(df, roles)
    s = _series_stats(h, "sales").select("n", F.col("mae").alias("sales_mae"), F.col("mape").alias("sales_mape_percent"))
    p = _series_stats(h, "profit").select(F.col("mae").alias("profit_mae"), F.col("mape").alias("profit_mape_percent"))
    return s.crossJoin(p).withColumnRenamed("n", "periods")
