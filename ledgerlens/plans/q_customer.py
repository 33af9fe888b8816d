"""Catalogue: customers, churn, products, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import customer as CU
from ledgerlens.operators import grouped
from ledgerlens.operators import portfolio as PF
from ledgerlens.plans.registry import add
from ledgerlens.plans.sqlfrag import PERF_SELECT, perf_sql, with_fact
from ledgerlens.sources.testview import prepared_fact


def _op(fn, *a, **kw):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return fn(df, roles, *a, **kw)
    return q


def _n100(x, lo, hi, invert=False):
    base = f"CASE WHEN {hi} = {lo} THEN 50.0 ELSE (COALESCE(CAST({x} AS DOUBLE), 0.0) - {lo}) / ({hi} - {lo}) * 100 END"
    if invert:
        base = f"100.0 - ({base})"
    return f"LEAST(GREATEST({base}, 0.0), 100.0)"


_CT = """
ct AS (SELECT customer, SUM(COALESCE(sales, 0)) AS total_sales, SUM(COALESCE(profit, 0)) AS total_profit,
              AVG(discount_pct) AS average_discount, COUNT(DISTINCT order_id) AS order_count,
              MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
              COUNT(DISTINCT strftime(order_date, '%Y-%m')) AS active_month_count,
              CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_order_count
       FROM sf GROUP BY customer),
ct2 AS (SELECT *, CASE WHEN order_count <> 0 THEN (FLOOR((total_sales) * 100 + 0.5) / 100) / order_count END AS average_order_value,
               CASE WHEN total_sales = 0 THEN 0.0 ELSE total_profit / total_sales * 100 END AS profit_margin_percent,
               CAST(COALESCE(date_diff('day', first_order_date, last_order_date), 0) AS INTEGER) AS customer_lifespan_days,
               CAST(COALESCE(date_diff('day', last_order_date, (SELECT MAX(order_date) FROM sf)), 9999) AS INTEGER) AS days_since_last_order,
               CASE WHEN order_count <> 0 THEN loss_order_count / order_count * 100 END AS loss_order_percent
        FROM ct),
mm AS (SELECT MIN(CAST(order_count AS DOUBLE)) AS lo1, MAX(CAST(order_count AS DOUBLE)) AS hi1,
              MIN(total_sales) AS lo2, MAX(total_sales) AS hi2, MIN(total_profit) AS lo3, MAX(total_profit) AS hi3,
              MIN(CAST(customer_lifespan_days AS DOUBLE)) AS lo4, MAX(CAST(customer_lifespan_days AS DOUBLE)) AS hi4,
              MIN(CAST(days_since_last_order AS DOUBLE)) AS lo5, MAX(CAST(days_since_last_order AS DOUBLE)) AS hi5 FROM ct2),
loy AS (SELECT ct2.*, round_even(""" + " + ".join([
    _n100("order_count", "lo1", "hi1") + " * 0.30", _n100("total_sales", "lo2", "hi2") + " * 0.20",
    _n100("total_profit", "lo3", "hi3") + " * 0.20", _n100("customer_lifespan_days", "lo4", "hi4") + " * 0.15",
    _n100("days_since_last_order", "lo5", "hi5", True) + " * 0.15"]) + """, 2) AS loyalty_score FROM ct2, mm),
q AS (SELECT quantile_cont(days_since_last_order, 0.75) AS rec75, median(average_order_value) AS aov_med,
             quantile_cont(total_sales, 0.75) AS sales75, median(order_count) AS orders_med FROM loy),
seg AS (SELECT loy.*, CASE
          WHEN total_profit < 0 THEN CASE WHEN loyalty_score < 70 THEN 'Unprofitable Customer' ELSE 'Loyal but Low Profit' END
          WHEN loyalty_score >= 70 AND total_profit > 0 THEN 'Loyal and Profitable'
          WHEN days_since_last_order > GREATEST(90.0, rec75) AND loyalty_score >= 55 THEN 'At-Risk Loyal Customer'
          WHEN order_count <= 2 AND COALESCE(average_order_value >= aov_med, FALSE) THEN 'New Promising Customer'
          WHEN total_sales >= sales75 AND order_count <= orders_med THEN 'High Value but Infrequent'
          ELSE 'Regular Customer' END AS customer_segment FROM loy, q)"""

_LOY_COLS = ["customer", "total_sales", "total_profit", "average_discount", "order_count", "first_order_date",
             "last_order_date", "active_month_count", "loss_order_count", "average_order_value", "profit_margin_percent",
             "customer_lifespan_days", "days_since_last_order", "loss_order_percent", "loyalty_score"]
_DBL = {"total_sales", "total_profit", "average_discount", "average_order_value", "profit_margin_percent",
        "loss_order_percent", "loyalty_score"}


def _sel(cols):
    return ", ".join(f"ROUND({c}, 4) AS {c}" if c in _DBL else c for c in cols)


add("customer_loyalty", _op(CU.customer_loyalty), with_fact(_CT + f"\nSELECT {_sel(_LOY_COLS)} FROM loy"))
add("customer_segments", _op(CU.customer_segments),
    with_fact(_CT + f"\nSELECT {_sel(_LOY_COLS + ['customer_segment'])} FROM seg ORDER BY loyalty_score DESC, customer"))
add("at_risk_customers", _op(CU.at_risk_customers),
    with_fact(_CT + f"\nSELECT {_sel(_LOY_COLS + ['customer_segment'])} FROM seg WHERE customer_segment = 'At-Risk Loyal Customer'"))
add("unprofitable_customers", _op(CU.unprofitable_customers), with_fact(
    _CT + f"\nSELECT {_sel(_LOY_COLS + ['customer_segment'])} FROM seg "
          "WHERE customer_segment IN ('Unprofitable Customer', 'Loyal but Low Profit')"))
add("customer_segment_counts", _op(CU.segment_counts),
    with_fact(_CT + "\nSELECT customer_segment, COUNT(*) AS customers FROM seg GROUP BY 1"))

# J21 explicit churn over a status derived from the data: a returned last line closes the account
_STATUS = "CASE WHEN return_flag = 'R' AND line_no = 7 THEN 'Closed' ELSE 'Open' END"


def _with_status(spark, sf_dir):
    df, roles = prepared_fact(spark, sf_dir)
    st = F.when((F.col("return_flag") == "R") & (F.col("line_no") == 7), "Closed").otherwise("Open")
    return df.withColumn("status", st), roles


_CHURN_RE = "churn|inactive|cancel|lost|not renew|non renew|closed"
_SFS = f"sfs AS (SELECT *, {_STATUS} AS status FROM sf),\nsfc AS (SELECT *, COALESCE(regexp_matches(lower(status), '{_CHURN_RE}'), FALSE) AS ch FROM sfs)"

add("churn_status", lambda spark, d: CU.churn_status(*_with_status(spark, d), "status"), with_fact(_SFS + """
SELECT customer, bool_or(ch) AS is_churned_customer,
       CASE WHEN bool_or(ch) THEN 'Churned/Inactive' ELSE 'Active/Retained' END AS churn_status FROM sfc GROUP BY customer"""))
add("churn_rates", lambda spark, d: CU.churn_rates(*_with_status(spark, d), "status"), with_fact(_SFS + """,
c AS (SELECT customer, bool_or(ch) AS x FROM sfc GROUP BY customer)
SELECT ROUND(AVG(CAST(x AS DOUBLE)) * 100, 4) AS customer_churn_rate_percent, COUNT(*) AS customers,
       ROUND((SELECT AVG(CAST(ch AS DOUBLE)) FROM sfc) * 100, 4) AS row_churn_rate_percent FROM c"""))
for _d in ("segment", "region", "product"):
    add(f"churn_by_{_d}", (lambda dim: lambda spark, d: CU.churn_by(*_with_status(spark, d), "status", dim))(_d),
        with_fact(_SFS + f""",
c AS (SELECT {_d}, customer, bool_or(ch) AS x FROM sfc GROUP BY {_d}, customer)
SELECT {_d}, ROUND(AVG(CAST(x AS DOUBLE)) * 100, 4) AS customer_churn_rate_percent FROM c GROUP BY {_d}
ORDER BY customer_churn_rate_percent DESC, {_d}"""))

add("churn_risk", _op(CU.churn_risk), with_fact("""
d AS (SELECT * FROM sf WHERE order_date IS NOT NULL),
g AS (SELECT customer, MAX(order_date) AS last_purchase_date, MIN(order_date) AS first_purchase_date,
             SUM(COALESCE(sales, 0)) AS total_sales, SUM(COALESCE(profit, 0)) AS total_profit, COUNT(DISTINCT order_id) AS order_count
      FROM d GROUP BY customer),
g2 AS (SELECT *, CAST(date_diff('day', last_purchase_date, (SELECT MAX(order_date) FROM d)) AS INTEGER) AS days_since_last_order,
              CAST(date_diff('day', first_purchase_date, last_purchase_date) AS INTEGER) AS customer_lifespan_days FROM g),
th AS (SELECT GREATEST(60.0, quantile_cont(days_since_last_order, 0.75)) AS cut, median(total_sales) AS smed FROM g2),
s AS (SELECT g2.*, CAST((CASE WHEN days_since_last_order >= cut THEN 50 ELSE 0 END) + (CASE WHEN order_count >= 2 THEN 20 ELSE 0 END)
                  + (CASE WHEN total_sales >= smed THEN 20 ELSE 0 END) + (CASE WHEN total_profit > 0 THEN 10 ELSE 0 END) AS INTEGER) AS churn_risk_score,
             cut AS inactive_cutoff_days FROM g2, th),
t AS (SELECT * FROM s ORDER BY churn_risk_score DESC, days_since_last_order DESC, total_sales DESC, customer LIMIT 15)
SELECT customer, last_purchase_date, first_purchase_date, ROUND(total_sales, 4) AS total_sales, ROUND(total_profit, 4) AS total_profit,
       order_count, days_since_last_order, customer_lifespan_days, churn_risk_score,
       CASE WHEN churn_risk_score > -1 AND churn_risk_score <= 39 THEN 'Low' WHEN churn_risk_score > 39 AND churn_risk_score <= 69 THEN 'Medium'
            WHEN churn_risk_score > 69 AND churn_risk_score <= 100 THEN 'High' END AS risk_level,
       ROUND(inactive_cutoff_days, 4) AS inactive_cutoff_days,
       CAST(ROW_NUMBER() OVER (ORDER BY churn_risk_score DESC, days_since_last_order DESC, total_sales DESC, customer) AS INTEGER) AS rank
FROM t"""))

_CDD = """
g AS (SELECT customer, SUM(COALESCE(sales, 0)) AS sales, SUM(COALESCE(profit, 0)) AS profit, AVG(discount_pct) AS average_discount,
             COUNT(*) AS order_count, CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_orders FROM sf GROUP BY customer),
o AS (SELECT CASE WHEN SUM(COALESCE(sales, 0)) = 0 THEN 0.0 ELSE SUM(COALESCE(profit, 0)) / SUM(COALESCE(sales, 0)) * 100 END AS overall_margin,
             AVG(discount_pct) AS overall_discount FROM sf),
h AS (SELECT g.*, CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END AS profit_margin_percent, overall_margin, overall_discount
      FROM g, o)"""
_CDD_SEL = """customer, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, ROUND(average_discount, 4) AS average_discount, order_count,
       loss_orders, ROUND(profit_margin_percent, 4) AS profit_margin_percent, ROUND(overall_margin, 4) AS overall_margin,
       ROUND(overall_discount, 4) AS overall_discount,
       CASE WHEN profit > 0 AND profit_margin_percent >= overall_margin AND average_discount <= overall_discount THEN 'targeted offers only'
            WHEN profit > 0 THEN 'selective discounts' ELSE 'no more discounts' END AS verdict"""
add("customer_discount_decision", _op(CU.customer_discount_decision),
    with_fact(_CDD + f"\nSELECT {_CDD_SEL} FROM (SELECT * FROM h ORDER BY sales DESC, profit DESC, customer LIMIT 10)"))
add("customer_discount_decision_named", _op(CU.customer_discount_decision, "customer#000000007"),
    with_fact(_CDD + f"\nSELECT {_CDD_SEL} FROM h WHERE lower(CAST(customer AS VARCHAR)) = 'customer#000000007'"))

# ----------------------------------------------------------------- products / regions
add("product_portfolio", lambda spark, d: PF.product_portfolio(*prepared_fact(spark, d)).select(*grouped.PERF_COLUMNS, "portfolio_class"),
    with_fact(perf_sql("product") + f""",
m AS (SELECT median(sales) AS ms, median(profit) AS mp FROM perf)
SELECT {PERF_SELECT}, CASE WHEN profit < 0 THEN 'Problem Products'
                           WHEN sales >= ms AND profit >= mp THEN 'Stars'
                           WHEN sales >= ms AND profit_margin_percent < 8 THEN 'Volume Drivers'
                           WHEN sales < ms AND profit_margin_percent >= 20 THEN 'Niche Winners'
                           WHEN COALESCE(average_discount, 0) >= 0.3 AND profit_margin_percent < 10 THEN 'Discount-Damaged Products'
                           ELSE 'Review Products' END AS portfolio_class
FROM perf, m ORDER BY profit DESC, dimension_value"""))

for _d in ("region", "state"):
    add(f"weak_{_d}s" if _d == "region" else "weak_states",
        (lambda dim: lambda spark, d: PF.weak_regions(*prepared_fact(spark, d), dim).select(*grouped.PERF_COLUMNS))(_d),
        with_fact(perf_sql(_d) + f"\nSELECT {PERF_SELECT} FROM perf ORDER BY profit, profit_margin_percent, dimension_value LIMIT 10"))
    add(f"strong_{_d}s" if _d == "region" else "strong_states",
        (lambda dim: lambda spark, d: PF.strong_regions(*prepared_fact(spark, d), dim).select(*grouped.PERF_COLUMNS))(_d),
        with_fact(perf_sql(_d) + f"\nSELECT {PERF_SELECT} FROM perf ORDER BY profit DESC, dimension_value LIMIT 10"))
    add(f"high_sales_low_margin_{_d}s",
        (lambda dim: lambda spark, d: PF.high_sales_low_margin_regions(*prepared_fact(spark, d), dim).select(*grouped.PERF_COLUMNS))(_d),
        with_fact(perf_sql(_d) + f""",
m AS (SELECT median(sales) AS ms, median(profit_margin_percent) AS mm FROM perf)
SELECT {PERF_SELECT} FROM perf, m WHERE sales >= ms AND profit_margin_percent <= mm ORDER BY profit DESC, dimension_value"""))

add("bi_stars", lambda spark, d: PF.bi_stars(*prepared_fact(spark, d)).select(*grouped.PERF_COLUMNS), with_fact(perf_sql("product") + f""",
m AS (SELECT median(sales) AS ms, median(profit_margin_percent) AS mm FROM perf)
SELECT {PERF_SELECT} FROM perf, m WHERE sales >= ms AND profit > 0 AND profit_margin_percent >= mm"""))
add("bi_problems", lambda spark, d: PF.bi_problems(*prepared_fact(spark, d)).select(*grouped.PERF_COLUMNS), with_fact(perf_sql("product") + f"""
SELECT {PERF_SELECT} FROM perf WHERE profit < 0 OR profit_margin_percent < 0"""))
add("bi_discount_damaged", lambda spark, d: PF.bi_discount_damaged(*prepared_fact(spark, d)).select(*grouped.PERF_COLUMNS),
    with_fact(perf_sql("product") + f""",
m AS (SELECT median(average_discount) AS md FROM perf)
SELECT {PERF_SELECT} FROM perf, m WHERE average_discount > md AND profit < 0"""))

add("double_down_products", _op(PF.double_down_products), with_fact("""
f AS (SELECT product AS dimension_value, SUM(COALESCE(sales, 0)) AS sales, SUM(COALESCE(profit, 0)) AS profit, COUNT(*) AS order_count
      FROM sf GROUP BY 1),
f2 AS (SELECT *, CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END AS profit_margin_percent FROM f WHERE profit > 0 AND sales > 0),
r AS (SELECT *,
        (RANK() OVER (ORDER BY sales) + (COUNT(*) OVER (PARTITION BY sales) - 1) / 2.0) / COUNT(*) OVER () AS rs,
        (RANK() OVER (ORDER BY profit) + (COUNT(*) OVER (PARTITION BY profit) - 1) / 2.0) / COUNT(*) OVER () AS rp,
        (RANK() OVER (ORDER BY profit_margin_percent) + (COUNT(*) OVER (PARTITION BY profit_margin_percent) - 1) / 2.0) / COUNT(*) OVER () AS rm
      FROM f2),
s AS (SELECT *, rs * 0.4 + rp * 0.4 + rm * 0.2 AS score FROM r)
SELECT dimension_value, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, order_count,
       ROUND(profit_margin_percent, 4) AS profit_margin_percent, ROUND(score, 4) AS score,
       ROW_NUMBER() OVER (ORDER BY score DESC, dimension_value) AS rank FROM s ORDER BY rank"""))
