"""Catalogue: trends, growth, concentration."""

from __future__ import annotations

from ledgerlens.operators import trend as T
from ledgerlens.plans.registry import add
from ledgerlens.plans.sqlfrag import with_fact
from ledgerlens.sources.testview import prepared_fact

_PERIOD = {"M": "strftime(order_date, '%Y-%m')",
           "Q": "CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR)",
           "Y": "CAST(year(order_date) AS VARCHAR)"}


def _op(fn, *a, **kw):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return fn(df, roles, *a, **kw)
    return q


def _pct(cur, prev):
    return f"CASE WHEN {prev} <> 0 THEN ({cur} - {prev}) / {prev} * 100 END"


def _trend_sql(freq):
    return f"""
g AS (SELECT {_PERIOD[freq]} AS period, SUM(COALESCE(sales, 0)) AS sales, SUM(COALESCE(profit, 0)) AS profit
      FROM sf WHERE order_date IS NOT NULL GROUP BY 1),
t AS (SELECT period, sales, profit, {_pct('sales', 'LAG(sales) OVER (ORDER BY period)')} AS sales_growth_percent,
             {_pct('profit', 'LAG(profit) OVER (ORDER BY period)')} AS profit_growth_percent FROM g)"""


_TREND_SELECT = ("period, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, "
                 "ROUND(sales_growth_percent, 4) AS sales_growth_percent, ROUND(profit_growth_percent, 4) AS profit_growth_percent")

for _f, _name in (("M", "month"), ("Q", "quarter"), ("Y", "year")):
    add(f"performance_over_time_{_name}", _op(T.performance_over_time, _f),
        with_fact(_trend_sql(_f) + f"\nSELECT {_TREND_SELECT} FROM t ORDER BY period"))

add("rank_periods", _op(T.rank_periods, "profit", "M", 5),
    with_fact(_trend_sql("M") + f"\nSELECT {_TREND_SELECT} FROM t ORDER BY profit ASC, period LIMIT 5"))


def _yoy_sql(where=""):
    return with_fact(f"""
g AS (SELECT CAST(year(order_date) AS INTEGER) AS year, SUM(COALESCE(sales, 0)) AS sales, COUNT(*) AS order_count,
             SUM(COALESCE(profit, 0)) AS profit FROM sf WHERE order_date IS NOT NULL GROUP BY 1),
s AS (SELECT * FROM g {where})
SELECT year, ROUND(sales, 4) AS sales, order_count, ROUND(profit, 4) AS profit,
       ROUND({_pct('sales', 'LAG(sales) OVER (ORDER BY year)')}, 4) AS sales_yoy_growth_percent,
       ROUND({_pct('profit', 'LAG(profit) OVER (ORDER BY year)')}, 4) AS profit_yoy_growth_percent,
       ROUND(CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END, 4) AS profit_margin_percent
FROM s ORDER BY year""")


add("yoy_growth", _op(T.yoy_growth), _yoy_sql())
add("yoy_growth_1997_1999", _op(T.yoy_growth, year_range=(1997, 1999)), _yoy_sql("WHERE year BETWEEN 1997 AND 1999"))

_CYP = """
g AS (SELECT category, CAST(year(order_date) AS INTEGER) AS year, SUM(COALESCE(profit, 0)) AS profit, COUNT(*) AS order_count,
             SUM(COALESCE(sales, 0)) AS sales FROM sf WHERE order_date IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, profit - LAG(profit) OVER (PARTITION BY category ORDER BY year) AS profit_yoy_change,
             CASE WHEN LAG(profit) OVER (PARTITION BY category ORDER BY year) <> 0
                  THEN (profit - LAG(profit) OVER (PARTITION BY category ORDER BY year))
                       / LAG(profit) OVER (PARTITION BY category ORDER BY year) * 100 END AS profit_yoy_growth_percent FROM g)"""
_CYP_SELECT = ("category, year, ROUND(profit, 4) AS profit, order_count, ROUND(sales, 4) AS sales, "
               "ROUND(profit_yoy_change, 4) AS profit_yoy_change, ROUND(profit_yoy_growth_percent, 4) AS profit_yoy_growth_percent")
add("category_year_profit", _op(T.category_year_profit), with_fact(_CYP + f"\nSELECT {_CYP_SELECT} FROM t"))
add("category_yoy_decline", _op(T.category_yoy_decline), with_fact(
    _CYP + f"\nSELECT {_CYP_SELECT} FROM t WHERE year = (SELECT MAX(year) FROM t) AND profit_yoy_change < 0 "
           "ORDER BY profit_yoy_change, category"))

add("customer_concentration_table", _op(T.customer_sales_share), with_fact("""
g AS (SELECT customer, SUM(COALESCE(sales, 0)) AS sales, COUNT(*) AS order_count, SUM(COALESCE(profit, 0)) AS profit
      FROM sf GROUP BY customer),
tt AS (SELECT SUM(sales) AS tot FROM g),
t AS (SELECT *, SUM(sales) OVER (ORDER BY sales DESC, customer ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM g, tt)
SELECT customer, ROUND(sales, 4) AS sales, order_count, ROUND(profit, 4) AS profit,
       ROUND(CASE WHEN tot <> 0 THEN sales / tot * 100 ELSE 0.0 END, 4) AS sales_share_percent,
       ROUND(CASE WHEN tot <> 0 THEN cum / tot * 100 ELSE 0.0 END, 4) AS cumulative_sales_share_percent
FROM t ORDER BY sales DESC, customer"""))

add("customer_concentration", _op(T.customer_concentration), with_fact("""
g AS (SELECT customer, SUM(COALESCE(sales, 0)) AS sales FROM sf GROUP BY customer),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY sales DESC, customer) AS rn FROM g),
s AS (SELECT SUM(CASE WHEN rn <= 5 THEN sales ELSE 0 END) AS t5, SUM(CASE WHEN rn <= 10 THEN sales ELSE 0 END) AS t10,
             SUM(sales) AS tot FROM r)
SELECT ROUND(t5 / tot * 100, 4) AS top_5_customer_sales_share_percent,
       ROUND(t10 / tot * 100, 4) AS top_10_customer_sales_share_percent,
       CASE WHEN t10 / tot * 100 >= 50 THEN 'high' WHEN t10 / tot * 100 >= 30 THEN 'moderate' ELSE 'low' END AS concentration_risk
FROM s"""))

add("metric_drop", _op(T.metric_drop, "profit", "M"), with_fact("""
g AS (SELECT strftime(order_date, '%Y-%m') AS period, SUM(profit) AS value FROM sf WHERE order_date IS NOT NULL GROUP BY 1),
l AS (SELECT * FROM g ORDER BY period DESC LIMIT 2),
t AS (SELECT period, value, LAG(period) OVER (ORDER BY period) AS pp, LAG(value) OVER (ORDER BY period) AS pv FROM l)
SELECT period AS current_period, pp AS previous_period, ROUND(value, 4) AS current_value, ROUND(pv, 4) AS previous_value,
       ROUND(value - pv, 4) AS absolute_change, ROUND(CASE WHEN pv <> 0 THEN (value - pv) / pv * 100 END, 4) AS percent_change
FROM t WHERE pp IS NOT NULL"""))
add("metric_drop_sales_quarter", _op(T.metric_drop, "sales", "Q"), with_fact(f"""
g AS (SELECT {_PERIOD['Q']} AS period, SUM(sales) AS value FROM sf WHERE order_date IS NOT NULL GROUP BY 1),
l AS (SELECT * FROM g ORDER BY period DESC LIMIT 2),
t AS (SELECT period, value, LAG(period) OVER (ORDER BY period) AS pp, LAG(value) OVER (ORDER BY period) AS pv FROM l)
SELECT period AS current_period, pp AS previous_period, ROUND(value, 4) AS current_value, ROUND(pv, 4) AS previous_value,
       ROUND(value - pv, 4) AS absolute_change, ROUND(CASE WHEN pv <> 0 THEN (value - pv) / pv * 100 END, 4) AS percent_change
FROM t WHERE pp IS NOT NULL"""))
