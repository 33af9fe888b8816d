"""Catalogue: loss drivers, combinations, leakage, diagnostics."""

from __future__ import annotations

from ledgerlens.operators import grouped
from ledgerlens.operators import profit as P
from ledgerlens.plans.registry import add
from ledgerlens.plans.sqlfrag import (PERF_SELECT, band, dim_expr, dim_perf_sql, dp_select, perf_sql, priority_sql,
                                      with_fact)
from ledgerlens.sources.testview import prepared_fact


def _op(fn, *a, **kw):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return fn(df, roles, *a, **kw)
    return q


def _perf_cols(fn, *a):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return fn(df, roles, *a).select(*grouped.PERF_COLUMNS)
    return q


add("loss_summary", _op(P.loss_summary), with_fact("""
SELECT ROUND(COALESCE(SUM(profit), 0), 4) AS total_loss_amount, COUNT(*) AS total_loss_orders FROM sf WHERE profit < 0"""))

for _d in ("category", "subcategory", "product", "region", "segment", "customer", "discount_band"):
    add(f"loss_by_{_d}", _perf_cols(P.loss_by, _d),
        with_fact(perf_sql(dim_expr(_d), where="WHERE profit < 0") + f"\nSELECT {PERF_SELECT} FROM perf"))

for _d in ("category", "subcategory", "region", "segment", "product"):
    add(f"low_margin_{_d}", _perf_cols(P.low_margin, _d),
        with_fact(perf_sql(_d) + f"\nSELECT {PERF_SELECT} FROM perf ORDER BY profit_margin_percent, dimension_value"))

_COMBO_DIMS = ["category", "subcategory", "product", "region", "segment"]
_combo_parts = []
for _n, _a, _b in P.COMBO_SPECS:
    cols = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" if d in (_a, _b) else f"CAST(NULL AS VARCHAR) AS {d}" for d in _COMBO_DIMS)
    _combo_parts.append(f"SELECT '{_n}' AS combination_type, {cols}, SUM(profit) AS loss, COUNT(*) AS orders "
                        f"FROM sf WHERE profit < 0 GROUP BY {_a}, {_b}")
add("loss_combinations", _op(P.loss_combinations), with_fact(f"""
c AS ({' UNION ALL '.join(_combo_parts)}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY combination_type ORDER BY loss, {', '.join(f'{d} NULLS FIRST' for d in _COMBO_DIMS)}) AS rn FROM c)
SELECT combination_type, {', '.join(f"COALESCE({d}, '{P.COMBO_DEFAULTS[d]}') AS {d}" for d in _COMBO_DIMS)},
       ROUND(loss, 4) AS loss, orders FROM r WHERE rn <= 10"""))

_LP = dim_perf_sql(P.LEAKAGE_DIMS) + ",\nlp AS (SELECT * FROM dp WHERE profit < 0 OR profit_margin_percent < 5)"
add("leakage_points", _op(P.leakage_points), with_fact(_LP + f"\nSELECT {dp_select()} FROM lp"))

_TOP = _LP + f""",
top AS (SELECT * FROM lp ORDER BY profit, {priority_sql('dimension', P.TOP_LEAKAGE_PRIORITY)}, profit_margin_percent,
        dimension_value LIMIT 1)"""
add("top_leakage", _op(P.top_leakage), with_fact(_TOP + f"\nSELECT {dp_select()} FROM top"))

for _d in ("category", "product"):
    add(f"high_sales_low_profit_{_d}", _perf_cols(P.high_sales_low_profit, _d), with_fact(perf_sql(_d) + f""",
th AS (SELECT quantile_cont(sales, 0.6) AS s, median(profit_margin_percent) AS m FROM perf)
SELECT {PERF_SELECT} FROM perf, th WHERE sales >= th.s AND profit_margin_percent <= th.m
ORDER BY sales DESC, profit_margin_percent, dimension_value"""))

add("high_sales_weak_margin", _op(P.high_sales_weak_margin, "product"), with_fact(perf_sql("product", customers=True, cost=True) + f""",
th AS (SELECT COUNT(*) AS n, quantile_cont(sales, 0.5) AS p50, quantile_cont(sales, 0.7) AS p70,
              median(profit_margin_percent) AS med,
              CASE WHEN SUM(sales) = 0 THEN 0.0 ELSE SUM(profit) / SUM(sales) * 100 END AS overall FROM perf),
h AS (SELECT perf.*, (sales >= CASE WHEN n <= 5 THEN p50 ELSE p70 END AND profit_margin_percent <= GREATEST(med, overall)) AS hit
      FROM perf, th),
k AS (SELECT * FROM h WHERE hit OR NOT (SELECT bool_or(hit) FROM h)
      ORDER BY profit_margin_percent, sales DESC, dimension_value LIMIT 10)
SELECT {PERF_SELECT}, ROUND(cost, 4) AS cost, customer_count,
       CAST(ROW_NUMBER() OVER (ORDER BY profit_margin_percent, sales DESC, dimension_value) AS INTEGER) AS rank FROM k"""))

_SLICE_DIMS = ["category", "subcategory", "product", "region", "segment", "customer"]
_slice_cond = " OR ".join(f"(top.dimension = '{d}' AND lower(CAST(sf.{d} AS VARCHAR)) = lower(top.dimension_value))" for d in _SLICE_DIMS)
_drv_parts = " UNION ALL ".join(f"SELECT '{d}' AS d, CAST({d} AS VARCHAR) AS v, {i + 1} AS o, profit FROM sl"
                                for i, d in enumerate(P.CONTEXT_DRIVER_DIMS))
add("leakage_drivers", _op(P.leakage_drivers), with_fact(_TOP + f""",
sl AS (SELECT sf.* FROM sf, top WHERE {_slice_cond}),
bd AS (SELECT * FROM (SELECT {band('discount_pct')} AS b, SUM(profit) AS profit FROM sl GROUP BY 1) WHERE profit < 0
       ORDER BY profit, b LIMIT 1),
ex AS ({_drv_parts}),
g AS (SELECT d, v, o, SUM(profit) AS profit FROM ex WHERE d <> (SELECT dimension FROM top) GROUP BY d, v, o HAVING SUM(profit) < 0),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY d ORDER BY profit, v) AS rn FROM g),
f2 AS (SELECT d, v, profit, o FROM w WHERE rn = 1 ORDER BY o LIMIT 2),
u AS (SELECT 'discount_band' AS driver_dimension, b AS driver_value, profit, 0 AS o FROM bd
      UNION ALL SELECT d, v, profit, o FROM f2)
SELECT driver_dimension, driver_value, ROUND(u.profit, 4) AS profit, top.dimension AS context_dimension,
       top.dimension_value AS context_value FROM u, top ORDER BY o"""))

add("other_loss_areas", _op(P.other_loss_areas), with_fact(
    _TOP.replace("dp_g", "dq_g").replace("dp_t", "dq_t").replace("FROM dp ", "FROM dq ").replace("\ndp AS", "\ndq AS")
    + ",\n" + dim_perf_sql(P.LOSS_TABLE_DIMS).strip() + f""",
l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY profit, dimension_value) AS rn FROM dp WHERE profit < 0)
SELECT dimension AS area_type, dimension_value AS area, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit,
       ROUND(profit_margin_percent, 4) AS profit_margin_percent, ROUND(loss_contribution_percent, 4) AS loss_contribution_percent
FROM l WHERE rn <= 3 AND ((SELECT COUNT(*) FROM top) = 0 OR lower(dimension_value) <> (SELECT lower(dimension_value) FROM top))
ORDER BY {priority_sql('dimension', P.OTHER_AREA_PRIORITY)}, profit, dimension_value LIMIT 8"""))

add("profit_summary", _op(P.profit_summary), with_fact(_TOP + """
SELECT ROUND(COALESCE(SUM(sales), 0), 4) AS total_sales, ROUND(COALESCE(SUM(profit), 0), 4) AS total_profit, COUNT(*) AS rows,
       CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_rows,
       ROUND(COALESCE(SUM(CASE WHEN profit < 0 THEN profit END), 0), 4) AS total_loss_amount,
       ROUND(CASE WHEN SUM(sales) = 0 THEN 0.0 ELSE SUM(profit) / SUM(sales) * 100 END, 4) AS profit_margin_percent,
       ROUND((FLOOR((SUM(profit)) * 100 + 0.5) / 100) / COUNT(*), 4) AS profit_per_row,
       (SELECT dimension FROM top) AS top_leakage_dimension, (SELECT dimension_value FROM top) AS top_leakage_value,
       ROUND((SELECT profit FROM top), 4) AS top_leakage_profit
FROM sf"""))

_DIAG = dim_perf_sql(P.DIAGNOSTIC_DIMS, customers=True) + """,
d0 AS (SELECT * FROM dp WHERE dimension_value IS NOT NULL),
bp AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY profit, dimension_value) AS rn FROM d0) WHERE rn <= 7),
bm AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY profit_margin_percent, dimension_value) AS rn
                      FROM d0 WHERE sales > 0) WHERE rn <= 5),
u AS (SELECT DISTINCT * EXCLUDE (rn) FROM (SELECT * FROM bp UNION ALL SELECT * FROM bm)),
p AS (SELECT *, CASE WHEN profit < 0 THEN 0 ELSE 1 END AS diagnostic_priority FROM u)"""
add("profit_diagnostic", _op(P.profit_diagnostic), with_fact(_DIAG + f"""
SELECT {dp_select(customers=True)}, diagnostic_priority,
       CAST(ROW_NUMBER() OVER (ORDER BY diagnostic_priority, profit, dimension, dimension_value) AS INTEGER) AS rank FROM p"""))

add("profit_diagnostic_dims", _op(P.profit_diagnostic_dims), with_fact(dim_perf_sql(P.DIAGNOSTIC_DIMS) + """
SELECT dimension, COUNT(*) AS groups_checked, CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_making_groups,
       ROUND(COALESCE(SUM(CASE WHEN profit < 0 THEN profit END), 0), 4) AS total_loss_amount,
       first(dimension_value ORDER BY profit, dimension_value) AS lowest_profit_group, ROUND(MIN(profit), 4) AS lowest_profit,
       first(dimension_value ORDER BY profit_margin_percent, dimension_value) FILTER (WHERE sales > 0) AS lowest_margin_group,
       ROUND(MIN(profit_margin_percent) FILTER (WHERE sales > 0), 4) AS lowest_margin_percent
FROM dp WHERE dimension_value IS NOT NULL GROUP BY dimension"""))

add("profit_by_discount_band", _op(P.profit_by_discount_band), with_fact(f"""
b AS (SELECT * FROM (VALUES ('0%', 1), ('0-10%', 2), ('10-20%', 3), ('20-30%', 4), ('30-40%', 5), ('40%+', 6)) t(discount_band, band_order)),
g AS (SELECT {band('discount_pct')} AS k, SUM(sales) AS sales, SUM(profit) AS profit, COUNT(*) AS order_count FROM sf GROUP BY 1)
SELECT b.discount_band, CAST(b.band_order AS INTEGER) AS band_order, ROUND(COALESCE(sales, 0), 4) AS sales,
       ROUND(COALESCE(profit, 0), 4) AS profit, COALESCE(order_count, 0) AS order_count,
       ROUND(CASE WHEN COALESCE(sales, 0) = 0 THEN 0.0 ELSE COALESCE(profit, 0) / sales * 100 END, 4) AS margin_percent
FROM b LEFT JOIN g ON b.discount_band = g.k ORDER BY band_order"""))

add("discount_band_profile", _op(P.discount_band_profile), with_fact(f"""
g AS (SELECT {band('discount_pct')} AS dimension_value, AVG(discount_pct) AS average_discount, COUNT(*) AS order_count,
             SUM(sales) AS sales, SUM(profit) AS profit FROM sf GROUP BY 1)
SELECT dimension_value, ROUND(average_discount, 4) AS average_discount, order_count, ROUND(sales, 4) AS sales,
       ROUND(profit, 4) AS profit, ROUND(CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END, 4) AS profit_margin_percent
FROM g ORDER BY average_discount, dimension_value"""))

_WG = ["category", "subcategory", "product", "region", "segment", "customer"]
add("worst_groups", _op(P.worst_groups), with_fact(dim_perf_sql(_WG) + f"""
SELECT {dp_select()} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY profit, dimension_value) AS rn FROM dp)
WHERE rn = 1 ORDER BY dimension"""))

add("loss_concentration", _perf_cols(P.loss_concentration), with_fact(perf_sql("product") + f"""
SELECT {PERF_SELECT} FROM perf ORDER BY loss_contribution_percent DESC, dimension_value"""))

add("monthly_profit", _op(P.monthly_profit), with_fact("""
SELECT strftime(order_date, '%Y-%m') AS period, ROUND(SUM(COALESCE(profit, 0)), 4) AS profit FROM sf
WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1"""))

add("slice_root_cause", _op(P.slice_root_cause, "region", "europe"), with_fact("""
SELECT 'region' AS target_dimension, 'europe' AS target_value, ROUND(SUM(sales), 4) AS sales, ROUND(SUM(profit), 4) AS profit,
       ROUND(COALESCE(SUM(CASE WHEN profit < 0 THEN profit END), 0), 4) AS loss_amount, COUNT(*) AS order_count,
       ROUND(AVG(discount_pct), 4) AS average_discount,
       ROUND(CASE WHEN SUM(sales) <> 0 THEN SUM(profit) / SUM(sales) * 100 END, 4) AS margin,
       SUM(profit) < 0 AS loss_making, AVG(discount_pct) > 20 AS discount_pressure
FROM sf WHERE lower(region) = 'europe' HAVING COUNT(*) > 0"""))

add("slice_breakdown", _op(P.slice_breakdown, "region", "europe"), with_fact(
    "sfe AS (SELECT * FROM sf WHERE lower(region) = 'europe')," + dim_perf_sql(["subcategory", "product", "region", "segment"], source="sfe")
    + f"\nSELECT {dp_select()} FROM dp"))

add("combo_profit", _op(P.combo_profit, "category", "region"), with_fact("""
SELECT category, region, ROUND(SUM(COALESCE(sales, 0)), 4) AS sales, ROUND(SUM(COALESCE(profit, 0)), 4) AS profit,
       COUNT(*) AS row_count,
       ROUND(CASE WHEN SUM(COALESCE(sales, 0)) = 0 THEN 0.0 ELSE SUM(COALESCE(profit, 0)) / SUM(COALESCE(sales, 0)) * 100 END, 4)
         AS profit_margin_percent
FROM sf GROUP BY category, region ORDER BY profit DESC, category, region"""))


_RD, _WD = ("category", "subcategory", "product", "region", "segment", "customer"), ("category", "subcategory", "product", "region")
add("relationship_summary", _op(P.relationship_summary), with_fact(dim_perf_sql(_RD) + f""",
bb AS (SELECT {band('discount_pct')} AS dimension_value, SUM(profit) AS profit, SUM(sales) AS sales, MIN(discount_pct) AS lo FROM sf GROUP BY 1),
f0 AS (SELECT 0 AS pos, 'discount_band' AS dimension, dimension_value, profit, CASE WHEN sales = 0 THEN 0.0 ELSE profit / sales * 100 END AS profit_margin_percent,
              'largest loss by discount' AS finding FROM bb WHERE profit < 0 AND dimension_value IS NOT NULL ORDER BY profit, lo LIMIT 1),
f1 AS (SELECT CASE dimension {' '.join(f"WHEN '{d}' THEN {i + 1}" for i, d in enumerate(_RD))} END AS pos, dimension, dimension_value, profit, profit_margin_percent,
              'worst group' AS finding FROM dp QUALIFY ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY profit, dimension_value) = 1),
th AS (SELECT dimension, quantile_cont(sales, 0.6) AS s6, median(profit_margin_percent) AS mm FROM dp WHERE dimension IN ({', '.join(f"'{d}'" for d in _WD)}) GROUP BY 1),
f2 AS (SELECT CASE dimension {' '.join(f"WHEN '{d}' THEN {i + 10}" for i, d in enumerate(_WD))} END AS pos, dimension, dimension_value, profit, profit_margin_percent,
              'high sales, weak margin' AS finding FROM dp JOIN th USING (dimension) WHERE sales >= s6 AND profit_margin_percent <= mm
       QUALIFY ROW_NUMBER() OVER (PARTITION BY dimension ORDER BY sales DESC, profit_margin_percent, dimension_value) = 1),
u AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL (SELECT * FROM f2 ORDER BY pos LIMIT 1))
SELECT dimension, dimension_value, ROUND(profit, 4) AS profit, ROUND(profit_margin_percent, 4) AS profit_margin_percent, finding,
       CAST(ROW_NUMBER() OVER (ORDER BY pos) AS INTEGER) AS position FROM u QUALIFY ROW_NUMBER() OVER (ORDER BY pos) <= 8"""))
