"""Catalogue: BI summary and band table, loss-group drivers, insights and composites."""

from __future__ import annotations

from ledgerlens.operators import insights as I
from ledgerlens.operators import portfolio as PF
from ledgerlens.operators import profit as PR
from ledgerlens.operators.filters import bi_projection
from ledgerlens.plans.registry import ORACLE, add
from ledgerlens.plans.sqlfrag import (BI_BAND, PERF_SELECT, STAR_COLUMNS, dim_perf_sql, dp_select, perf_sql,
                                      row_digest_sql, with_fact)
from ledgerlens.sources.testview import prepared_fact


def _op(fn, *a, **kw):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return fn(df, roles, *a, **kw)
    return q


def _no_order_id(fn):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return fn(df.drop("order_id"), roles.with_roles(order_id=None))
    return q


_BI_SUMMARY = """
b AS (SELECT SUM(sales) AS total_sales, SUM(profit) AS total_profit, SUM(sales - profit) AS total_cost, SUM(quantity) AS total_quantity,
             COUNT(DISTINCT CAST(order_id AS VARCHAR)) AS total_orders, SUM(CASE WHEN profit < 0 THEN profit ELSE 0.0 END) AS loss_amount,
             CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_orders, AVG(discount_pct) AS average_discount,
             COUNT(*) AS record_count FROM sf),
tr AS (SELECT COALESCE(strftime(order_date, '%Y-%m'), 'Unknown') AS ym, SUM(sales) AS s, SUM(profit) AS p FROM sf GROUP BY 1),
l2 AS (SELECT * FROM tr ORDER BY ym DESC LIMIT 2),
d2 AS (SELECT ym, s - LAG(s) OVER (ORDER BY ym) AS sd, p - LAG(p) OVER (ORDER BY ym) AS pd, LAG(s) OVER (ORDER BY ym) AS ps FROM l2),
lt AS (SELECT first(ym) AS latest_period, first(sd) AS sales_delta_vs_prev, first(pd) AS profit_delta_vs_prev
       FROM d2 WHERE ps IS NOT NULL AND ym <> 'Unknown')
SELECT ROUND(total_sales, 4) AS total_sales, ROUND(total_profit, 4) AS total_profit, ROUND(total_cost, 4) AS total_cost,
       ROUND(total_quantity, 4) AS total_quantity, total_orders, ROUND(loss_amount, 4) AS loss_amount, loss_orders,
       ROUND(average_discount, 4) AS average_discount, record_count,
       ROUND(CASE WHEN total_orders > 0 THEN total_sales / total_orders ELSE 0.0 END, 4) AS average_order_value,
       ROUND(CASE WHEN total_sales = 0 THEN 0.0 ELSE total_profit / total_sales * 100 END, 4) AS profit_margin_percent,
       ROUND(CASE WHEN total_orders > 0 THEN loss_orders / total_orders * 100 ELSE 0.0 END, 4) AS loss_order_percent,
       latest_period, ROUND(sales_delta_vs_prev, 4) AS sales_delta_vs_prev, ROUND(profit_delta_vs_prev, 4) AS profit_delta_vs_prev
FROM b, lt"""
add("bi_summary", _op(I.bi_summary), with_fact(_BI_SUMMARY))
add("bi_summary_no_order_id", _no_order_id(I.bi_summary), with_fact(_BI_SUMMARY.replace("COUNT(DISTINCT CAST(order_id AS VARCHAR))", "COUNT(*)")))

_OWN = [c for c in STAR_COLUMNS if c != "order_id"]
_PROJECTION = f"""
r AS (SELECT *, {row_digest_sql({c: k for c, k in STAR_COLUMNS.items() if c != "order_id"})} AS digest FROM sf)
SELECT {", ".join(f"ROUND({c}, 4) AS {c}" if STAR_COLUMNS[c] == "double" else c for c in _OWN)},
       ROUND(sales, 4) AS bi_sales, ROUND(profit, 4) AS bi_profit, ROUND(quantity, 4) AS bi_quantity, ROUND(discount_pct, 4) AS bi_discount, ROUND(sales - profit, 4) AS bi_cost,
       ROUND(CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END, 4) AS bi_margin_percent, ROUND(CASE WHEN profit < 0 THEN profit ELSE 0.0 END, 4) AS bi_loss_amount,
       COALESCE(profit < 0, FALSE) AS bi_is_loss, {BI_BAND} AS bi_discount_band,
       'ROW-' || digest || '-' || CAST(ROW_NUMBER() OVER (PARTITION BY digest) AS VARCHAR) AS bi_order_key, order_date AS bi_date,
       COALESCE(strftime(order_date, '%Y-%m'), 'Unknown') AS bi_year_month, CAST(year(order_date) AS INTEGER) AS bi_year, COALESCE('Q' || CAST(quarter(order_date) AS VARCHAR), 'Unknown') AS bi_quarter FROM r"""
add("bi_projection", _op(bi_projection), with_fact(_PROJECTION.replace("SELECT line_no", "SELECT order_id, line_no", 1).replace(
    "'ROW-' || digest || '-' || CAST(ROW_NUMBER() OVER (PARTITION BY digest) AS VARCHAR)", "CAST(order_id AS VARCHAR)")))
add("bi_projection_no_order_id", _no_order_id(bi_projection), with_fact(_PROJECTION))

for _d in ("category", "subcategory", "product", "region", "state", "segment", "customer"):
    add(f"bi_{_d}", _op(PF.bi_group, _d), with_fact(f"""
g AS (SELECT CAST({_d} AS VARCHAR) AS dimension_value, SUM(COALESCE(sales, 0)) AS sales, SUM(COALESCE(profit, 0)) AS profit, SUM(COALESCE(quantity, 0)) AS quantity,
             COUNT(DISTINCT CAST(order_id AS VARCHAR)) AS orders, AVG(discount_pct) AS average_discount,
             SUM(CASE WHEN profit < 0 THEN profit ELSE 0.0 END) AS loss_amount FROM sf GROUP BY 1),
t AS (SELECT SUM(sales) AS ts, SUM(profit) AS tp, SUM(loss_amount) AS tl FROM g)
SELECT dimension_value, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, ROUND(quantity, 4) AS quantity, orders, ROUND(average_discount, 4) AS average_discount,
       ROUND(loss_amount, 4) AS loss_amount, ROUND(CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END, 4) AS margin_percent,
       ROUND(CASE WHEN ts <> 0 THEN sales / ts * 100 ELSE 0.0 END, 4) AS sales_contribution_percent,
       ROUND(CASE WHEN tp <> 0 THEN profit / tp * 100 ELSE 0.0 END, 4) AS profit_contribution_percent,
       ROUND(CASE WHEN tl <> 0 THEN loss_amount / tl * 100 ELSE 0.0 END, 4) AS loss_contribution_percent FROM g, t"""))

add("bi_discount_band", _op(I.bi_discount_band), with_fact(f"""
g AS (SELECT {BI_BAND} AS discount_band, SUM(sales) AS sales, SUM(profit) AS profit, COUNT(DISTINCT CAST(order_id AS VARCHAR)) AS orders,
             AVG(discount_pct) AS average_discount, SUM(CASE WHEN profit < 0 THEN profit ELSE 0.0 END) AS loss_amount FROM sf GROUP BY 1)
SELECT discount_band, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, orders, ROUND(average_discount, 4) AS average_discount,
       ROUND(loss_amount, 4) AS loss_amount,
       CASE discount_band WHEN '0%' THEN 0 WHEN '0-10%' THEN 1 WHEN '10-20%' THEN 2 WHEN '20-30%' THEN 3 WHEN '30-40%' THEN 4
                          WHEN '40%+' THEN 5 WHEN 'Unknown' THEN 6 ELSE 999 END AS band_order,
       ROUND(CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END, 4) AS margin_percent FROM g ORDER BY band_order"""))

_OTHERS = ["region", "segment", "customer", "category", "subcategory"]
add("loss_group_drivers", _op(I.loss_group_drivers, "state", 10), with_fact(f"""
g AS (SELECT state AS dimension_value, SUM(sales) AS sales, SUM(profit) AS profit, AVG(discount_pct) AS average_discount,
             SUM(quantity) AS quantity, MAX(CASE WHEN sales < 0 OR quantity < 0 THEN 1 ELSE 0 END) AS ret FROM sf GROUP BY 1),
g2 AS (SELECT *, CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END AS profit_margin_percent FROM g WHERE profit < 0),
ov AS (SELECT CASE WHEN SUM(sales) = 0 THEN 0.0 ELSE SUM(profit) / SUM(sales) * 100 END AS om, AVG(discount_pct) AS od FROM sf),
top AS (SELECT *, ROW_NUMBER() OVER (ORDER BY profit, dimension_value) AS rank FROM g2 ORDER BY profit, dimension_value LIMIT 10),
u AS ({' UNION ALL '.join(f"SELECT state AS dimension_value, '{d}' AS d, {i} AS o, CAST({d} AS VARCHAR) AS v, SUM(profit) AS p FROM sf GROUP BY state, {d}" for i, d in enumerate(_OTHERS))}),
c AS (SELECT dimension_value, 'loss concentrated in ' || d || ' ' || v AS conc FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension_value ORDER BY o, p, v) AS rn FROM u
         WHERE p < 0 AND dimension_value IN (SELECT dimension_value FROM top)) WHERE rn = 1),
t AS (SELECT top.*, conc, om, od FROM top LEFT JOIN c USING (dimension_value), ov),
dr AS (SELECT *, list_filter([CASE WHEN profit < 0 THEN 'loss-making' END,
                             CASE WHEN profit_margin_percent < om - 5 THEN 'margin well below overall' END,
                             CASE WHEN average_discount >= 20 AND average_discount > od THEN 'high discount' END,
                             CASE WHEN profit / quantity < 0 THEN 'negative profit per unit' END,
                             CASE WHEN sales <> 0 THEN CASE WHEN (sales - profit) / sales >= 0.85 THEN 'cost at least 85% of sales' END END,
                             CASE WHEN ret = 1 THEN 'returns present' END, conc], lambda x: x IS NOT NULL) AS lst FROM t)
SELECT CAST(rank AS INTEGER) AS rank, dimension_value, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit,
       ROUND(profit_margin_percent, 4) AS profit_margin_percent, ROUND(average_discount, 4) AS average_discount,
       CASE WHEN rank <= 5 THEN array_to_string(lst[1:4], '; ') END AS drivers FROM dr ORDER BY rank"""))

_LABEL = "CASE dimension WHEN 'category' THEN 'Category' WHEN 'subcategory' THEN 'Sub-Category' WHEN 'product' THEN 'Product' WHEN 'region' THEN 'Region' WHEN 'segment' THEN 'Segment' END"
add("hidden_insights", _op(I.hidden_insights), with_fact(
    dim_perf_sql(["category", "subcategory", "product", "region", "segment"]) + ",\n" + perf_sql("product").strip()
    + ",\n" + perf_sql("region").strip().replace("g AS (", "rg AS (", 1).replace("FROM g)", "FROM rg)").replace("g2", "rg2")
    .replace("tot AS", "rtot AS").replace("FROM rg2 CROSS JOIN tot", "FROM rg2 CROSS JOIN rtot").replace("perf AS", "rperf AS")
    + f""",
lp AS (SELECT * FROM dp WHERE profit < 0 OR profit_margin_percent < 5),
a AS (SELECT 'Profit leakage: ' || {_LABEL} || ' = ' || dimension_value AS title, CASE WHEN profit < 0 THEN 'High' ELSE 'Medium' END AS severity,
             'Profit' AS business_area, sales, profit, profit_margin_percent, 0 AS area,
             ROW_NUMBER() OVER (ORDER BY profit, dimension, dimension_value) AS pos FROM lp ORDER BY profit, dimension, dimension_value LIMIT 3),
b AS (SELECT 'Problem product: ' || dimension_value AS title, 'High' AS severity, 'Product' AS business_area, sales, profit,
             profit_margin_percent, 1 AS area, 1 AS pos FROM perf WHERE profit < 0 ORDER BY profit, dimension_value LIMIT 1),
cu AS (SELECT customer, SUM(COALESCE(sales, 0)) AS s, SUM(COALESCE(profit, 0)) AS p FROM sf GROUP BY customer),
c AS (SELECT 'Unprofitable customer risk: ' || CAST(customer AS VARCHAR) AS title, 'Medium' AS severity, 'Customer' AS business_area,
             s AS sales, p AS profit, CASE WHEN s = 0 THEN 0.0 ELSE p / s * 100 END AS profit_margin_percent, 2 AS area, 1 AS pos
      FROM cu WHERE p < 0 ORDER BY p, customer LIMIT 1),
d AS (SELECT 'Weak region: ' || dimension_value AS title, 'Medium' AS severity, 'Region' AS business_area, sales, profit,
             profit_margin_percent, 3 AS area, 1 AS pos FROM rperf ORDER BY profit, profit_margin_percent, dimension_value LIMIT 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY area, pos, title) AS position FROM u)
SELECT title, severity, business_area, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit,
       ROUND(profit_margin_percent, 4) AS profit_margin_percent, CAST(position AS INTEGER) AS position FROM r WHERE position <= 10"""))

add("headline_flags", _op(I.headline_flags), with_fact("""
SELECT COUNT(*) AS rows, FALSE AS cleaned_data_used, CAST(SUM(CASE WHEN sales IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved_sales_rows,
       CAST(SUM(CASE WHEN profit IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved_profit_rows, SUM(profit) < 0 AS negative_company_profit,
       SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) > 0 AS losses_present, CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_rows,
       COUNT(DISTINCT product) AS products, COUNT(DISTINCT customer) AS customers FROM sf"""))


def _advice_sql() -> tuple[str, str]:
    """Recommendations and the executive summary, drawn from the SQL of the tables they rest on."""
    from ledgerlens.plans import q_customer, q_profit  # noqa: F401  their SQL is read here

    parts = ",\n".join(f"{name} AS ({ORACLE[key]})" for name, key in (
        ("tl", "top_leakage"), ("dr", "leakage_drivers"), ("pp", "product_portfolio"), ("cs", "customer_segments"), ("wr", "weak_regions")))
    advice = f"""WITH {parts},
u AS (SELECT 'High' AS priority, 'Profit' AS area, 'Fix profit leakage in ' || dimension || ' ' || dimension_value AS action, profit AS impact, 1 AS o FROM tl
  UNION ALL SELECT 'Medium', 'Profit', 'Inside ' || context_value || ': review ' || driver_dimension || ' ' || driver_value, profit, 2 FROM dr
  UNION ALL SELECT 'High', 'Product', 'Reprice or retire ' || COUNT(*) || ' problem products', FLOOR(SUM(profit) * 100 + 0.5) / 100, 3 FROM pp WHERE portfolio_class = 'Problem Products' HAVING COUNT(*) > 0
  UNION ALL SELECT 'Medium', 'Customer', 'Act on ' || COUNT(*) || ' ' || lower(customer_segment) || 's', FLOOR(SUM(total_profit) * 100 + 0.5) / 100, CASE customer_segment WHEN 'Unprofitable Customer' THEN 4 ELSE 5 END
    FROM cs WHERE customer_segment IN ('Unprofitable Customer', 'At-Risk Loyal Customer') GROUP BY customer_segment
  UNION ALL SELECT CASE WHEN profit < 0 THEN 'Medium' ELSE 'Low' END, 'Region', 'Audit discounts and mix in ' || dimension_value, profit, 6
    FROM (SELECT * FROM wr ORDER BY profit, profit_margin_percent, dimension_value LIMIT 1))
SELECT priority, area, action, impact, CAST(ROW_NUMBER() OVER (ORDER BY CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, o, action) AS INTEGER) AS position FROM u ORDER BY position"""
    inner = with_fact("""
SELECT ROUND(SUM(sales), 4) AS total_sales, ROUND(SUM(profit), 4) AS total_profit, ROUND(SUM(CASE WHEN profit < 0 THEN profit END), 4) AS loss_amount FROM sf""")
    summary = f"""WITH {parts}, b AS ({inner}),
m AS (SELECT *, CASE WHEN total_sales = 0 THEN 0.0 ELSE total_profit / total_sales * 100 END AS margin FROM b),
d1 AS (SELECT first(driver_dimension) AS cause_dimension, first(driver_value) AS cause_value FROM (SELECT * FROM dr LIMIT 1)),
t1 AS (SELECT first(dimension) AS problem_dimension, first(dimension_value) AS problem_value, first(profit) AS problem_profit FROM tl)
SELECT total_sales, total_profit, loss_amount, FLOOR(margin * 10000 + 0.5) / 10000 AS profit_margin_percent, problem_dimension, problem_value, problem_profit, cause_dimension, cause_value,
       printf('Sales %.2f, profit %.2f, margin %.2f%%', total_sales, total_profit, margin) AS performance,
       CASE WHEN problem_value IS NOT NULL THEN 'Fix ' || problem_dimension || ' ' || problem_value || ' first' END AS action FROM m, t1, d1"""
    return advice, summary


_ADVICE, _SUMMARY = _advice_sql()
add("recommendations", _op(I.recommendations), _ADVICE)
add("executive_summary", _op(I.executive_summary), _SUMMARY)

def table_digest_sql(name: str, sql: str) -> str:
    """The digest of a query's result: cells as text, rows by md5, summed."""
    cell = ("CASE WHEN abs(TRY_CAST(value AS DOUBLE)) < 1e14 THEN CAST(CAST(FLOOR(TRY_CAST(value AS DOUBLE) * 10000 + 0.5) AS BIGINT) AS VARCHAR) ELSE value END")
    return f"""SELECT '{name}' AS "table", COUNT(*) AS rows, CAST(COALESCE(SUM(CAST('0x' || substr(md5(line), 1, 13) AS HUGEINT)), 0) AS VARCHAR) AS digest FROM (
SELECT rid, string_agg(name || '=' || COALESCE({cell}, ''), '|' ORDER BY name) AS line
FROM (SELECT ROW_NUMBER() OVER () AS rid, CAST(COLUMNS(*) AS VARCHAR) FROM ({sql})) UNPIVOT INCLUDE NULLS (value FOR name IN (COLUMNS(* EXCLUDE (rid)))) GROUP BY rid)"""


# Every measure table of the bundle that has SQL of its own; the advice that is drawn from them has queries of its own.
_TABLES = ["kpis", "profit_summary", "leakage_points", *(f"loss_by_{d}" for d in I.LOSS_DIMS), "relationship_summary", "loss_concentration", "monthly_profit", "metric_drop", "customer_loyalty",
           "product_portfolio", "weak_regions", "performance_over_time_month", "forecast", "anomaly_outliers", "anomaly_periods", "anomaly_low_margin", "hidden_insights"]


def _bundle_sql() -> str:
    """The digests of the tables' own SQL."""
    from ledgerlens.plans import q_core, q_customer, q_forecast, q_profit, q_time  # noqa: F401  their SQL is read here
    return "\nUNION ALL\n".join(table_digest_sql(t, ORACLE[t]) for t in _TABLES)


add("analyst_bundle", lambda spark, d: I.bundle_digest(I.analyst_bundle(*prepared_fact(spark, d)), _TABLES), _bundle_sql())


def _of_bundle(table, entities):
    def q(spark, sf_dir):
        return I.analyst_bundle(*prepared_fact(spark, sf_dir), entities)[table]
    return q


_ASIA = [("region", "asia"), ("state", "no such state")]
add("analyst_leakage_of_entity", _of_bundle("leakage_points", _ASIA), with_fact(
    "sfe AS (SELECT * FROM sf WHERE lower(region) = 'asia')," + dim_perf_sql(PR.LEAKAGE_DIMS, source="sfe") + f"""
SELECT {dp_select()} FROM dp WHERE profit < 0 OR profit_margin_percent < 5"""))
add("analyst_root_cause_of_entity", _of_bundle("entity_root_causes", _ASIA), with_fact("""
SELECT 'region' AS target_dimension, 'asia' AS target_value, ROUND(SUM(sales), 4) AS sales, ROUND(SUM(profit), 4) AS profit,
       ROUND(COALESCE(SUM(CASE WHEN profit < 0 THEN profit END), 0), 4) AS loss_amount, COUNT(*) AS order_count,
       ROUND(AVG(discount_pct), 4) AS average_discount,
       ROUND(CASE WHEN SUM(sales) <> 0 THEN SUM(profit) / SUM(sales) * 100 END, 4) AS margin,
       SUM(profit) < 0 AS loss_making, AVG(discount_pct) > 20 AS discount_pressure
FROM sf WHERE lower(region) = 'asia' HAVING COUNT(*) > 0"""))
