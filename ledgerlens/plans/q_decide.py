"""Catalogue: decision questions and correlations."""

from __future__ import annotations

from ledgerlens.operators import decisions as D
from ledgerlens.plans.registry import add
from ledgerlens.plans.sqlfrag import PERF_SELECT, dim_perf_sql, perf_sql, with_fact
from ledgerlens.sources.testview import prepared_fact


def _op(fn, *a, **kw):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return fn(df, roles, *a, **kw)
    return q


add("consistent_losers", _op(D.consistent_losers, "product"), with_fact("""
g AS (SELECT product AS dimension_value, COUNT(*) AS total_orders, CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_orders,
             SUM(profit) AS total_profit, SUM(sales) AS sales FROM sf GROUP BY 1),
h AS (SELECT *, CASE WHEN sales = 0 THEN 0.0 ELSE total_profit / sales * 100 END AS profit_margin_percent,
             loss_orders / total_orders * 100 AS loss_order_percent FROM g)
SELECT dimension_value, total_orders, loss_orders, ROUND(total_profit, 4) AS total_profit, ROUND(sales, 4) AS sales,
       ROUND(profit_margin_percent, 4) AS profit_margin_percent, ROUND(loss_order_percent, 4) AS loss_order_percent,
       ROW_NUMBER() OVER (ORDER BY loss_order_percent DESC, total_profit, dimension_value) AS rank
FROM h WHERE total_orders >= 2 AND loss_order_percent >= 60"""))

add("exit_candidates", _op(D.exit_candidates), with_fact("""
g AS (SELECT state AS dimension_value, SUM(COALESCE(profit, 0)) AS profit, COUNT(*) AS order_count,
             CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_orders, SUM(COALESCE(sales, 0)) AS sales,
             AVG(discount_pct) AS average_discount FROM sf GROUP BY 1),
h AS (SELECT *, CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END AS profit_margin_percent,
             loss_orders / order_count * 100 AS loss_order_percent FROM g WHERE profit < 0)
SELECT dimension_value, ROUND(profit, 4) AS profit, order_count, loss_orders, ROUND(sales, 4) AS sales,
       ROUND(average_discount, 4) AS average_discount, ROUND(profit_margin_percent, 4) AS profit_margin_percent,
       ROUND(loss_order_percent, 4) AS loss_order_percent,
       CAST(ROW_NUMBER() OVER (ORDER BY profit, loss_order_percent DESC, dimension_value) AS INTEGER) AS rank FROM h"""))

add("ship_mode_comparison", _op(D.ship_mode_comparison), with_fact("""
g AS (SELECT ship_mode AS dimension_value, SUM(COALESCE(sales, 0)) AS sales, SUM(COALESCE(profit, 0)) AS profit,
             COUNT(*) AS order_count, AVG(discount_pct) AS average_discount FROM sf GROUP BY 1),
h AS (SELECT *, FLOOR(sales * 100 + 0.5) / 100 / order_count AS average_order_value,
             CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END AS profit_margin_percent FROM g)
SELECT dimension_value, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, order_count, ROUND(average_discount, 4) AS average_discount,
       ROUND(average_order_value, 4) AS average_order_value, ROUND(profit_margin_percent, 4) AS profit_margin_percent,
       CAST(ROW_NUMBER() OVER (ORDER BY profit_margin_percent DESC, dimension_value) AS INTEGER) AS rank FROM h"""))


def _corr_sql(x, y, k=""):
    return f"""
pr{k} AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM sf WHERE ({x}) IS NOT NULL AND ({y}) IS NOT NULL),
st{k} AS (SELECT COUNT(*) AS n, MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM pr{k}),
cr{k} AS (SELECT CASE WHEN n >= 3 AND x0 < x1 AND y0 < y1 THEN (SELECT corr(x, y) FROM pr{k}) END AS correlation,
             n AS valid_rows FROM st{k})"""


_STRENGTH = """CASE WHEN correlation IS NULL THEN NULL ELSE
         (CASE WHEN ABS(correlation) >= 0.60 THEN 'strong' WHEN ABS(correlation) >= 0.35 THEN 'moderate'
               WHEN ABS(correlation) >= 0.15 THEN 'weak' ELSE 'very weak' END) || ' ' ||
         (CASE WHEN correlation > 0 THEN 'positive' WHEN correlation < 0 THEN 'negative' ELSE 'no' END) END"""
for _d, _t, _dx, _tx in (("discount", "profit", "discount_pct", "profit"), ("sales", "profit", "sales", "profit"),
                         ("discount", "margin", "discount_pct", "CASE WHEN sales <> 0 THEN profit / sales * 100 END"),
                         ("quantity", "sales", "quantity", "sales")):
    add(f"metric_correlation_{_d}_{_t}", _op(D.metric_correlation, _d, _t), with_fact(_corr_sql(_dx, _tx) + f"""
SELECT '{_d}' AS driver, '{_t}' AS target, ROUND(correlation, 4) AS correlation, valid_rows, {_STRENGTH} AS strength FROM cr"""))

_PC = ["order_id", "customer_id", "cost", "unit_price", "profit", "sales", "quantity", "discount_pct"]
add("profit_correlations", _op(D.profit_correlations), with_fact(
    ",\n".join(_corr_sql(c, "profit", str(i)).strip() for i, c in enumerate(_PC)) + "\nSELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, ROUND(correlation, 4) AS correlation_with_profit FROM cr{i}" for i, c in enumerate(_PC))
    + ") WHERE correlation_with_profit IS NOT NULL ORDER BY correlation_with_profit, metric"))

_NUM = ["order_id", "line_no", "customer_id", "quantity", "unit_price", "discount_pct", "sales", "cost", "profit"]
add("correlation_matrix", lambda spark, d: D.correlation_matrix(prepared_fact(spark, d)[0]), with_fact(
    "c AS (SELECT " + ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c_{i}_{j}" for i, a in enumerate(_NUM)
                                for j, b in enumerate(_NUM) if i < j) + " FROM sf)\n" + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, ROUND({'1.0' if i == j else f'c_{min(i, j)}_{max(i, j)}'}, 4) AS correlation FROM c"
        for i, a in enumerate(_NUM) for j, b in enumerate(_NUM))))

_DP = dim_perf_sql(["discount_band"])
add("discount_profile", _op(D.discount_summary), with_fact(_DP + ",\n" + _corr_sql("discount_pct", "profit") + """
SELECT (SELECT ROUND(AVG(discount_pct), 4) FROM sf) AS average_discount, ROUND(correlation, 4) AS discount_profit_correlation,
       (SELECT first(dimension_value ORDER BY profit, dimension_value) FROM dp) AS worst_discount_band,
       (SELECT ROUND(MIN(profit), 4) FROM dp) AS worst_discount_band_profit FROM cr"""))

add("category_discounts", _op(D.category_discounts), with_fact("""
SELECT category, ROUND(AVG(discount_pct), 4) AS average_discount_percent FROM sf GROUP BY category
ORDER BY average_discount_percent DESC, category"""))

add("category_comparison", _op(D.category_comparison, ["promo", "Standard"]), with_fact(
    "sfc AS (SELECT * FROM sf WHERE lower(CAST(category AS VARCHAR)) IN ('promo', 'standard'))," + perf_sql("category", source="sfc") + f""",
y AS (SELECT category AS dimension_value, year(order_date) AS yr, SUM(COALESCE(sales, 0)) AS s FROM sfc WHERE order_date IS NOT NULL GROUP BY 1, 2),
gr AS (SELECT dimension_value, COUNT(*) AS n, arg_min(s, yr) AS f, arg_max(s, yr) AS l FROM y GROUP BY 1),
gr2 AS (SELECT dimension_value, CASE WHEN f = 0 THEN 0.0 ELSE (l - f) / f * 100 END AS sales_growth_percent FROM gr WHERE n >= 2),
o AS (SELECT perf.*, gr2.sales_growth_percent FROM perf LEFT JOIN gr2 USING (dimension_value))
SELECT {PERF_SELECT}, ROUND(sales_growth_percent, 4) AS sales_growth_percent,
       dimension_value = (SELECT first(dimension_value ORDER BY profit_margin_percent DESC, dimension_value DESC) FROM o) AS is_winner
FROM o ORDER BY profit_margin_percent DESC, dimension_value"""))

_PICK_DIMS = ["subcategory", "product", "category", "region", "discount_band"]
_PICKS = dim_perf_sql(_PICK_DIMS) + """,
pk AS (SELECT
  first(dimension_value ORDER BY profit, dimension_value) FILTER (WHERE dimension = 'subcategory') AS worst_subcategory,
  MIN(profit) FILTER (WHERE dimension = 'subcategory') AS worst_subcategory_profit,
  first(dimension_value ORDER BY profit, dimension_value) FILTER (WHERE dimension = 'discount_band') AS worst_discount_band,
  MIN(profit) FILTER (WHERE dimension = 'discount_band') AS worst_discount_band_profit,
  first(dimension_value ORDER BY profit, dimension_value) FILTER (WHERE dimension = 'product') AS worst_product,
  MIN(profit) FILTER (WHERE dimension = 'product') AS worst_product_profit,
  first(dimension_value ORDER BY profit_margin_percent, dimension_value) FILTER (WHERE dimension = 'category') AS lowest_margin_category,
  MIN(profit_margin_percent) FILTER (WHERE dimension = 'category') AS lowest_margin_category_profit_margin_percent,
  first(dimension_value ORDER BY profit_margin_percent DESC, dimension_value) FILTER (WHERE dimension = 'category') AS best_margin_category,
  MAX(profit_margin_percent) FILTER (WHERE dimension = 'category') AS best_margin_category_profit_margin_percent,
  first(dimension_value ORDER BY profit DESC, dimension_value) FILTER (WHERE dimension = 'region') AS best_profit_region,
  MAX(profit) FILTER (WHERE dimension = 'region') AS best_profit_region_profit FROM dp),
tt AS (SELECT SUM(sales) AS sales, SUM(profit) AS profit, CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_rows,
              COUNT(*) AS rows, COALESCE(SUM(CASE WHEN profit < 0 THEN profit END), 0) AS loss_amount FROM sf),
tt2 AS (SELECT *, CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END AS profit_margin_percent,
               loss_rows / rows * 100 AS loss_row_percent FROM tt)"""
add("business_health", _op(D.business_health), with_fact(_PICKS + """
SELECT ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, loss_rows, rows, ROUND(loss_amount, 4) AS loss_amount,
       ROUND(profit_margin_percent, 4) AS profit_margin_percent, ROUND(loss_row_percent, 4) AS loss_row_percent,
       lowest_margin_category, ROUND(lowest_margin_category_profit_margin_percent, 4) AS lowest_margin_category_profit_margin_percent,
       worst_subcategory, ROUND(worst_subcategory_profit, 4) AS worst_subcategory_profit FROM tt2, pk"""))
add("fix_list", _op(D.fix_list), with_fact(_PICKS + """
SELECT ROUND(sales, 4) AS sales, worst_subcategory, ROUND(worst_subcategory_profit, 4) AS worst_subcategory_profit,
       worst_discount_band, ROUND(worst_discount_band_profit, 4) AS worst_discount_band_profit, worst_product,
       ROUND(worst_product_profit, 4) AS worst_product_profit FROM tt2, pk"""))
add("loss_order_diagnosis", _op(D.loss_order_diagnosis), with_fact(_PICKS + """
SELECT loss_rows, ROUND(loss_amount, 4) AS loss_amount, worst_discount_band, ROUND(worst_discount_band_profit, 4) AS worst_discount_band_profit,
       worst_subcategory, ROUND(worst_subcategory_profit, 4) AS worst_subcategory_profit, worst_product,
       ROUND(worst_product_profit, 4) AS worst_product_profit FROM tt2, pk"""))
add("executive_top3", _op(D.executive_top3), with_fact(_PICKS + """
SELECT ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, ROUND(profit_margin_percent, 4) AS profit_margin_percent,
       worst_discount_band, ROUND(worst_discount_band_profit, 4) AS worst_discount_band_profit, worst_subcategory,
       ROUND(worst_subcategory_profit, 4) AS worst_subcategory_profit, best_margin_category,
       ROUND(best_margin_category_profit_margin_percent, 4) AS best_margin_category_profit_margin_percent,
       best_profit_region, ROUND(best_profit_region_profit, 4) AS best_profit_region_profit FROM tt2, pk"""))

add("profit_killers", _op(D.profit_killers), with_fact(dim_perf_sql(["subcategory", "product", "discount_band"]) + """,
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY profit, dimension_value) AS rn FROM dp)
SELECT dimension, dimension_value, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit,
       ROUND(profit_margin_percent, 4) AS profit_margin_percent, CAST(rn AS INTEGER) AS position FROM r
WHERE (dimension <> 'product' AND rn = 1) OR (dimension = 'product' AND rn <= 5 AND profit < 0) ORDER BY dimension, position"""))

add("category_check", _op(D.category_check, "PROMO"), with_fact(perf_sql("category") + f""",
low AS (SELECT first(dimension_value ORDER BY profit_margin_percent, dimension_value) AS l FROM perf),
sp AS (SELECT subcategory, SUM(COALESCE(profit, 0)) AS p FROM sf WHERE lower(CAST(category AS VARCHAR)) = 'promo' GROUP BY 1)
SELECT {PERF_SELECT}, dimension_value = (SELECT l FROM low) AS is_lowest_margin_category,
       (SELECT first(subcategory ORDER BY p, subcategory) FROM sp) AS worst_subcategory,
       (SELECT ROUND(MIN(p), 4) FROM sp) AS worst_subcategory_profit
FROM perf WHERE lower(CAST(dimension_value AS VARCHAR)) = 'promo'"""))
add("category_subcategories", lambda spark, d: D.category_subcategories(*prepared_fact(spark, d), "PROMO")
    .select(*__import__("ledgerlens.operators.grouped", fromlist=["PERF_COLUMNS"]).PERF_COLUMNS),
    with_fact("sfc AS (SELECT * FROM sf WHERE CAST(category AS VARCHAR) = 'PROMO')," + perf_sql("subcategory", source="sfc")
              + f"\nSELECT {PERF_SELECT} FROM perf ORDER BY profit, dimension_value"))

add("region_profile", _op(D.region_profile, "europe"), with_fact(
    perf_sql("region") + ",\nsfr AS (SELECT * FROM sf WHERE lower(CAST(region AS VARCHAR)) = 'europe')," +
    dim_perf_sql(["product", "subcategory"], source="sfr") + """,
t AS (SELECT 'top_' || dimension AS section,
             ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY CASE WHEN dimension = 'product' THEN -sales ELSE -profit END, dimension_value) AS position,
             dimension_value, sales, profit, profit_margin_percent, row_count FROM dp),
u AS (SELECT 'region_comparison' AS section, ROW_NUMBER() OVER (ORDER BY profit DESC, dimension_value) AS position,
             dimension_value, sales, profit, profit_margin_percent, row_count FROM perf
      UNION ALL SELECT * FROM t WHERE position <= 5)
SELECT section, CAST(position AS INTEGER) AS position, dimension_value, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit,
       ROUND(profit_margin_percent, 4) AS profit_margin_percent, row_count FROM u ORDER BY section, position"""))
