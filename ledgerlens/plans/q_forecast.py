"""Catalogue: forecast, backtest, anomalies, scenarios."""

from __future__ import annotations

from ledgerlens.operators import anomaly as A
from ledgerlens.operators import forecast as FC
from ledgerlens.operators import scenario as S
from ledgerlens.plans.registry import add
from ledgerlens.plans.sqlfrag import with_fact
from ledgerlens.sources.testview import prepared_fact


def _op(fn, *a, **kw):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return fn(df, roles, *a, **kw)
    return q


def _stats(m):
    return f"""AVG(CASE WHEN idx >= n - 3 THEN {m} END) AS ma_{m},
       SUM(CASE WHEN idx = 0 THEN POW(0.55, n - 1) ELSE 0.45 * POW(0.55, n - 1 - idx) END * {m}) AS ewm_{m},
       REGR_SLOPE({m}, CAST(idx AS DOUBLE)) AS slope_{m}, REGR_INTERCEPT({m}, CAST(idx AS DOUBLE)) AS int_{m},
       AVG(CASE WHEN idx >= 3 AND n >= 5 THEN ABS({m} - mp_{m}) END) AS mae_{m},
       AVG(CASE WHEN idx >= 3 AND n >= 5 AND ABS({m}) > 0 THEN ABS({m} - mp_{m}) / ABS({m}) END) * 100 AS mape_{m}"""


_HIST = """
h0 AS (SELECT strftime(order_date, '%Y-%m') AS period, FLOOR(SUM(COALESCE(sales, 0)) * 100 + 0.5) / 100 AS sales,
              FLOOR(SUM(COALESCE(profit, 0)) * 100 + 0.5) / 100 AS profit FROM sf WHERE order_date IS NOT NULL GROUP BY 1),
h AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY period) - 1 AS INTEGER) AS idx FROM h0),
nn AS (SELECT COUNT(*) AS n, MAX(idx) AS last_idx, MAX(period) AS last_period FROM h),
t AS (SELECT h.*, n, last_idx, last_period,
             AVG(sales) OVER (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mp_sales,
             AVG(profit) OVER (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mp_profit FROM h, nn),
st AS (SELECT n, last_idx, last_period, """ + _stats("sales") + ",\n" + _stats("profit") + """ FROM t GROUP BY n, last_idx, last_period)"""

add("forecast_history", lambda spark, d: FC.history(*prepared_fact(spark, d)),
    with_fact(_HIST + "\nSELECT period, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, idx FROM h"))

add("forecast_backtest", _op(FC.backtest), with_fact(_HIST + """
SELECT n AS periods, ROUND(mae_sales, 4) AS sales_mae, ROUND(mape_sales, 4) AS sales_mape_percent,
       ROUND(mae_profit, 4) AS profit_mae, ROUND(mape_profit, 4) AS profit_mape_percent FROM st"""))


def _pred(m):
    trend = f"COALESCE(GREATEST(0.0, int_{m} + slope_{m} * (n - 1 + step)), ma_{m})"
    return f"GREATEST(0.0, 0.35 * ma_{m} + 0.30 * ewm_{m} + 0.20 * {trend} + 0.15 * seas_{m})"


_FORECAST = _HIST + f""",
pc AS (SELECT CASE WHEN LAG(sales) OVER (ORDER BY idx) <> 0
                   THEN (sales - LAG(sales) OVER (ORDER BY idx)) / LAG(sales) OVER (ORDER BY idx) END AS pc FROM h),
vv AS (SELECT LEAST(GREATEST(CASE WHEN stddev_samp(pc) IS NULL OR stddev_samp(pc) = 0 THEN 0.15 ELSE stddev_samp(pc) END, 0.10), 0.35)
              AS v FROM pc),
steps AS (SELECT CAST(range AS INTEGER) AS step FROM range(1, 4)),
fs AS (SELECT steps.step, st.*, CASE WHEN n >= 12 THEN n - 12 + (step - 1) % 12 ELSE last_idx END AS sidx FROM steps, st),
fj AS (SELECT fs.*, h.sales AS seas_sales, h.profit AS seas_profit FROM fs LEFT JOIN h ON h.idx = fs.sidx),
pr AS (SELECT step, last_period, {_pred('sales')} AS ps, {_pred('profit')} AS pp, mape_sales, n FROM fj)
SELECT step, strftime(CAST(last_period || '-01' AS DATE) + to_months(step), '%Y-%m') AS forecast_period,
       ROUND(ps, 4) AS predicted_sales, ROUND(pp, 4) AS predicted_profit,
       ROUND(ps * (1 - v), 4) AS sales_lower_estimate, ROUND(ps * (1 + v), 4) AS sales_upper_estimate,
       ROUND(CASE WHEN pp < 0 THEN pp * (1 + v) ELSE pp * (1 - v) END, 4) AS profit_lower_estimate,
       ROUND(CASE WHEN pp < 0 THEN pp * (1 - v) ELSE pp * (1 + v) END, 4) AS profit_upper_estimate,
       '{FC.METHOD}' AS method_used,
       CASE WHEN mape_sales IS NULL THEN 'Medium' WHEN mape_sales <= 15 THEN 'High' WHEN mape_sales <= 30 THEN 'Medium'
            ELSE 'Low' END AS confidence, ROUND(v, 4) AS variability
FROM pr, vv WHERE n >= 3 ORDER BY step"""
_MONTH, _NEXT_MONTH = "strftime(order_date, '%Y-%m')", "strftime(CAST(last_period || '-01' AS DATE) + to_months(step), '%Y-%m')"
_QUARTER = "CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR)"
_AT = "(CAST(substr(last_period, 1, 4) AS INTEGER) * 4 + CAST(substr(last_period, 6, 1) AS INTEGER) - 1 + step)"
for _name, _f, _key, _next in (("forecast", "M", _MONTH, _NEXT_MONTH),
                               ("forecast_quarter", "Q", _QUARTER, f"CAST({_AT} // 4 AS VARCHAR) || 'Q' || CAST({_AT} % 4 + 1 AS VARCHAR)"),
                               ("forecast_year", "Y", "CAST(year(order_date) AS VARCHAR)", "CAST(CAST(last_period AS INTEGER) + step AS VARCHAR)")):
    add(_name, _op(FC.forecast, 3, _f), with_fact(_FORECAST.replace(_MONTH, _key).replace(_NEXT_MONTH, _next)))

# ------------------------------------------------------------------ anomalies
_AM = [("sales", "sales"), ("profit", "profit"), ("quantity", "quantity"), ("discount", "discount_pct")]
_BOUNDS = "bd AS (SELECT COUNT(*) AS rows, " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {m}_q1, quantile_cont({c}, 0.75) AS {m}_q3, COUNT({c}) AS {m}_n" for m, c in _AM) + " FROM sf)"


def _out(m, c):
    return (f"COALESCE({m}_n >= 4 AND ({m}_q3 - {m}_q1) <> 0 AND ({c} < {m}_q1 - 1.5 * ({m}_q3 - {m}_q1) "
            f"OR {c} > {m}_q3 + 1.5 * ({m}_q3 - {m}_q1)), FALSE)")


add("anomaly_outliers", _op(A.metric_outliers), with_fact(_BOUNDS + ",\nc AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST(SUM(CASE WHEN {_out(m, c)} THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count, "
    f"{m}_q1 - 1.5 * ({m}_q3 - {m}_q1) AS lower_bound, {m}_q3 + 1.5 * ({m}_q3 - {m}_q1) AS upper_bound, rows "
    f"FROM sf, bd GROUP BY {m}_q1, {m}_q3, rows" for m, c in _AM) + """)
SELECT metric, outlier_count, ROUND(lower_bound, 4) AS lower_bound, ROUND(upper_bound, 4) AS upper_bound,
       CASE WHEN outlier_count < GREATEST(5.0, rows * 0.05) THEN 'Medium' ELSE 'High' END AS severity
FROM c WHERE outlier_count > 0"""))

_COLS = ["order_id", "line_no", "order_date", "ship_date", "ship_mode", "customer_id", "customer", "segment", "region", "state",
         "category", "subcategory", "product", "quantity", "unit_price", "discount_pct", "sales", "cost", "return_flag", "profit"]
_DBLC = {"quantity", "unit_price", "discount_pct", "sales", "cost", "profit"}
_HSLM = """hs AS (SELECT *, COALESCE(sales, 0) AS _s,
                  CASE WHEN COALESCE(sales, 0) = 0 THEN 0.0 ELSE COALESCE(profit, 0) / COALESCE(sales, 0) * 100 END AS _m FROM sf),
hth AS (SELECT quantile_cont(_s, 0.75) AS q, median(_m) AS med FROM hs),
hrows AS (SELECT hs.* EXCLUDE (_s, _m) FROM hs, hth WHERE _s >= q AND _m < med)"""
add("unusual_rows", _op(A.unusual_rows), with_fact(_BOUNDS + ",\n" + _HSLM + ",\nu AS (" + " UNION ALL ".join(
    [f"SELECT {', '.join('sf.' + c for c in _COLS)}, '{c}' AS anomaly_metric FROM sf, bd WHERE {_out(m, c)}" for m, c in _AM]
    + [f"SELECT {', '.join(_COLS)}, 'high_sales_low_margin' AS anomaly_metric FROM hrows"]) + f"""),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY anomaly_metric ORDER BY {', '.join(c + ' NULLS FIRST' for c in _COLS)}) AS rn FROM u)
SELECT {', '.join(f'ROUND({c}, 4) AS {c}' if c in _DBLC else c for c in _COLS)}, anomaly_metric FROM r WHERE rn <= 20"""))

add("anomaly_low_margin", _op(A.high_sales_low_margin), with_fact(_HSLM + """
SELECT 'profit_margin' AS metric, COUNT(*) AS flagged_rows,
       CASE WHEN COUNT(*) > (SELECT COUNT(*) FROM sf) * 0.1 THEN 'High' ELSE 'Medium' END AS severity
FROM hrows HAVING COUNT(*) > 0"""))

_PA = """
g AS (SELECT strftime(order_date, '%Y-%m') AS period, SUM(sales) AS sales, SUM(profit) AS profit, AVG(discount_pct) AS discount
      FROM sf WHERE order_date IS NOT NULL GROUP BY 1),
c AS (""" + " UNION ALL ".join(
    f"SELECT period, '{col}' AS metric, {m} AS value, CASE WHEN LAG({m}) OVER (ORDER BY period) <> 0 "
    f"THEN ({m} - LAG({m}) OVER (ORDER BY period)) / LAG({m}) OVER (ORDER BY period) END AS change, '{m}' AS m FROM g"
    for m, col in (("sales", "sales"), ("profit", "profit"), ("discount", "discount_pct"))) + ")"
add("anomaly_periods", _op(A.period_anomalies), with_fact(_PA + """
SELECT period, ROUND(value, 4) AS value,
       CASE WHEN m = 'discount' THEN (CASE WHEN change < 0.5 THEN 'Medium' ELSE 'High' END)
            ELSE (CASE WHEN change <= -0.40 THEN 'High' WHEN change <= -0.25 THEN 'Medium' ELSE 'Low' END) END AS severity,
       CASE WHEN m = 'discount' THEN 'spike' ELSE 'drop' END AS kind, metric, ROUND(change * 100, 4) AS change_percent
FROM c WHERE (m = 'discount' AND change > 0.25) OR (m <> 'discount' AND change < -0.25) ORDER BY metric, period"""))

# ------------------------------------------------------------------ scenarios
_BASE = ("SELECT FLOOR(COALESCE(SUM(sales), 0) * 100 + 0.5) / 100 AS bs, "
         "FLOOR(COALESCE(SUM(profit), 0) * 100 + 0.5) / 100 AS bp{extra} FROM sf")


def _scen(name, ss, sp, assumption, extra=""):
    return with_fact(f"""
b AS ({_BASE.format(extra=extra)}),
r AS (SELECT '{name}' AS scenario, bs AS baseline_sales, bp AS baseline_profit, {ss} AS simulated_sales, {sp} AS simulated_profit FROM b)
SELECT scenario, ROUND(baseline_sales, 4) AS baseline_sales, ROUND(baseline_profit, 4) AS baseline_profit,
       ROUND(simulated_sales, 4) AS simulated_sales, ROUND(simulated_profit, 4) AS simulated_profit,
       ROUND(CASE WHEN baseline_sales = 0 THEN 0.0 ELSE baseline_profit / baseline_sales * 100 END, 4) AS baseline_margin,
       ROUND(CASE WHEN simulated_sales = 0 THEN 0.0 ELSE simulated_profit / simulated_sales * 100 END, 4) AS simulated_margin,
       ROUND(simulated_profit - baseline_profit, 4) AS estimated_profit_change, '{assumption}' AS assumption FROM r""")


add("scenario_discount_reduction", _op(S.discount_reduction, 10.0),
    _scen("discount_reduction", "bs", "bp + bs * (10.0 / 100) * 0.05", "reducing discount by 10.0% saves 5% of affected sales as profit"))
add("scenario_price_increase", _op(S.price_increase, 5.0),
    _scen("price_increase", "bs + bs * 5.0 / 100", "bp + bs * 5.0 / 100", "volume stays constant after a 5.0% price increase"))
add("scenario_remove_losses", _op(S.remove_losses),
    _scen("remove_loss_making", "bs", "bp - loss", "loss-making records are removed and no replacement sales occur",
          ", FLOOR(COALESCE(SUM(CASE WHEN profit < 0 THEN profit END), 0) * 100 + 0.5) / 100 AS loss"))
add("scenario_quantity_change", _op(S.quantity_change, -8.0),
    _scen("quantity_change", "bs * 0.92", "bp * 0.92", "sales and profit scale linearly with a quantity change of -8.0%"))
add("scenario_discount_cap", _op(S.discount_cap, 30.0),
    _scen("discount_cap", "bs", "bp + affected * 0.05", "capping discounts above 30.0% improves profit by 5% of affected sales",
          ", FLOOR(COALESCE(SUM(CASE WHEN discount_pct > 30.0 THEN sales END), 0) * 100 + 0.5) / 100 AS affected"))
add("scenario_margin_improvement", _op(S.margin_improvement, "region", "EUROPE", 3.0),
    _scen("margin_improvement", "bs", "bp + affected * 3.0 / 100", "EUROPE margin improves by 3.0 percentage points",
          ", FLOOR(COALESCE(SUM(CASE WHEN CAST(region AS VARCHAR) = 'EUROPE' THEN sales END), 0) * 100 + 0.5) / 100 AS affected"))
