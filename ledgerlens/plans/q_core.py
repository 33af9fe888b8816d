"""Catalogue: KPIs, grouped tables, rankings, filters, basic answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import grouped
from ledgerlens.plans.registry import add
from ledgerlens.plans.sqlfrag import PERF_SELECT, perf_sql, with_fact, band
from ledgerlens.sources.testview import prepared_fact

_PERF_DIMS = {"category": "category", "subcategory": "subcategory", "product": "product", "region": "region",
              "segment": "segment", "state": "state", "customer": "customer"}


def _perf_query(dim):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return grouped.performance(df, roles, dim).select(*grouped.PERF_COLUMNS)
    return q


for _dim, _col in _PERF_DIMS.items():
    add(f"perf_by_{_dim}", _perf_query(_dim), with_fact(perf_sql(_col) + f"\nSELECT {PERF_SELECT} FROM perf"))


# Grouped tables on derived dimensions, with cost and customer count
_SYN = {"discount_band": band("discount_pct"), "month": "strftime(order_date, '%Y-%m')",
        "quarter": "CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR)",
        "year": "CAST(year(order_date) AS VARCHAR)"}


def _grouped_query(dim):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return grouped.performance(df, roles, dim, customers=True, cost=True).select(
            *grouped.PERF_COLUMNS, "cost", "customer_count")
    return q


for _dim, _expr in _SYN.items():
    add(f"grouped_{_dim}", _grouped_query(_dim),
        with_fact(perf_sql(_expr, customers=True, cost=True) + f"\nSELECT {PERF_SELECT}, ROUND(cost, 4) AS cost, customer_count FROM perf"))


# ---------------------------------------------------------------- E1 / E1b
from ledgerlens.operators import kpis as K  # noqa: E402
from ledgerlens.operators import rank as R  # noqa: E402
from ledgerlens.operators import filters as C  # noqa: E402


def _fact_op(op, *a, **kw):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return op(df, roles, *a, **kw)
    return q


add("kpis", _fact_op(K.kpis), with_fact("""
SELECT COUNT(*) AS total_orders, ROUND(COALESCE(SUM(sales), 0), 4) AS total_sales, ROUND((FLOOR((SUM(sales)) * 100 + 0.5) / 100) / COUNT(sales), 4) AS average_order_value,
       ROUND(MEDIAN(sales), 4) AS median_order_value,
       CAST(SUM(CASE WHEN sales IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved_sales_rows,
       ROUND(COALESCE(SUM(profit), 0), 4) AS total_profit,
       CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_making_orders_count,
       ROUND(AVG(CASE WHEN profit < 0 THEN 1 ELSE 0 END) * 100, 4) AS loss_making_orders_percent,
       ROUND(COALESCE(SUM(CASE WHEN profit < 0 THEN profit END), 0), 4) AS total_loss_amount,
       CAST(SUM(CASE WHEN profit > 0 THEN 1 ELSE 0 END) AS BIGINT) AS profitable_orders_count,
       ROUND(AVG(CASE WHEN profit > 0 THEN 1 ELSE 0 END) * 100, 4) AS profitable_orders_percent,
       CAST(SUM(CASE WHEN profit IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved_profit_rows,
       ROUND(COALESCE(SUM(quantity), 0), 4) AS total_quantity, ROUND(AVG(discount_pct), 4) AS average_discount,
       COUNT(DISTINCT order_id) AS unique_orders, COUNT(DISTINCT customer_id) AS unique_customers,
       COUNT(*) AS order_rows, 'row_count' AS order_count_basis,
       ROUND((FLOOR((COALESCE(SUM(sales), 0)) * 100 + 0.5) / 100) / COUNT(DISTINCT order_id), 4) AS unique_order_average_value,
       ROUND(CASE WHEN SUM(sales) <> 0 THEN SUM(profit) / SUM(sales) * 100 END, 4) AS profit_margin_percent,
       ROUND((FLOOR((COALESCE(SUM(sales), 0)) * 100 + 0.5) / 100) / COUNT(DISTINCT customer_id), 4) AS sales_per_customer,
       ROUND((FLOOR((COALESCE(SUM(profit), 0)) * 100 + 0.5) / 100) / COUNT(DISTINCT customer_id), 4) AS profit_per_customer
FROM sf"""))


def _bw_cte(name, col):
    return f"{name} AS (SELECT CAST({col} AS VARCHAR) AS v, COALESCE(SUM(sales), 0) AS sales, COALESCE(SUM(profit), 0) AS profit FROM sf GROUP BY 1)"


add("best_worst", _fact_op(K.best_worst), with_fact(
    ",\n".join([_bw_cte("bc", "category"), _bw_cte("br", "region"), _bw_cte("bp", "product")]) + """
SELECT (SELECT first(v ORDER BY sales DESC, v) FROM bc) AS best_category_by_sales,
       (SELECT first(v ORDER BY sales DESC, v) FROM br) AS best_region_by_sales,
       (SELECT first(v ORDER BY profit DESC, v) FROM bc) AS best_category_by_profit,
       (SELECT first(v ORDER BY profit ASC, v) FROM bc) AS worst_category_by_profit,
       (SELECT first(v ORDER BY profit ASC, v) FROM br) AS worst_region_by_profit,
       (SELECT first(v ORDER BY profit DESC, v) FROM bp) AS best_product_by_profit,
       (SELECT first(v ORDER BY profit ASC, v) FROM bp) AS worst_product_by_profit"""))

# ---------------------------------------------------------------- E14-E23, E35
_STAT_METRICS = [("sales", "sales"), ("profit", "profit"), ("quantity", "quantity"), ("discount", "discount_pct"), ("cost", "cost")]
add("basic_stat", _fact_op(K.basic_stat), with_fact("\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, ROUND(COALESCE(SUM({c}), 0), 4) AS total, "
    + (f"ROUND(FLOOR(SUM({c}) * 100 + 0.5) / 100 / COUNT({c}), 4) AS average, " if m in ("sales", "profit", "cost") else f"ROUND(AVG({c}), 4) AS average, ")
    + f"ROUND(MIN({c}), 4) AS minimum, ROUND(MAX({c}), 4) AS maximum, ROUND(MEDIAN({c}), 4) AS median FROM sf"
    for m, c in _STAT_METRICS)))

add("basic_aggregation", _fact_op(K.basic_aggregation), with_fact("""
SELECT 'total_sales' AS metric, ROUND(SUM(sales), 4) AS value FROM sf UNION ALL
SELECT 'total_profit', ROUND(SUM(profit), 4) FROM sf UNION ALL
SELECT 'total_cost', ROUND(SUM(cost), 4) FROM sf UNION ALL
SELECT 'total_quantity', ROUND(SUM(quantity), 4) FROM sf UNION ALL
SELECT 'average_discount', ROUND(AVG(discount_pct), 4) FROM sf"""))

add("unique_customers", _fact_op(K.unique_count, "customers"),
    with_fact("SELECT COUNT(DISTINCT customer_id) AS unique_customers, 'customer_id' AS column_used FROM sf"))
add("unique_orders", _fact_op(K.unique_count, "orders"),
    with_fact("SELECT COUNT(DISTINCT order_id) AS unique_orders, 'order_id' AS column_used FROM sf"))

for _dim in ("category", "subcategory", "product", "region", "state", "segment", "customer", "ship_mode"):
    add(f"unique_{_dim}", _fact_op(K.unique_values, _dim), with_fact(
        f"SELECT DISTINCT value FROM (SELECT TRIM(CAST({_dim} AS VARCHAR)) AS value FROM sf) "
        f"WHERE value IS NOT NULL AND value <> '' ORDER BY value"))

add("aov", _fact_op(K.aov), with_fact("""
SELECT ROUND((FLOOR((SUM(sales)) * 100 + 0.5) / 100) / COUNT(sales), 4) AS mean_line_value, ROUND(MEDIAN(sales), 4) AS median_line_value,
       ROUND(COALESCE(SUM(sales), 0), 4) AS total_sales, COUNT(DISTINCT order_id) AS distinct_orders,
       COUNT(sales) AS rows_used, ROUND((FLOOR((COALESCE(SUM(sales), 0)) * 100 + 0.5) / 100) / COUNT(DISTINCT order_id), 4) AS sales_per_order
FROM sf"""))

add("date_range", _fact_op(K.date_range), with_fact("""
SELECT MIN(order_date) AS min_date, MAX(order_date) AS max_date,
       CAST(SUM(CASE WHEN order_date IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS invalid_dates FROM sf"""))

_ALL_COLS = ("order_id, line_no, order_date, ship_date, ship_mode, customer_id, customer, segment, region, state, "
             "category, subcategory, product, quantity, unit_price, discount_pct, sales, cost, return_flag, profit")

add("duplicate_rows", lambda spark, d: K.duplicate_rows(prepared_fact(spark, d)[0]), with_fact(f"""
g AS (SELECT COUNT(*) AS n FROM sf GROUP BY {_ALL_COLS})
SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS row_count FROM g"""))

add("non_unique_profile", _fact_op(K.non_unique_profile), with_fact(f"""
g AS (SELECT COUNT(*) AS n FROM sf GROUP BY {_ALL_COLS})
SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows, CAST(SUM(n) AS BIGINT) AS row_count,
       (SELECT COUNT(DISTINCT order_id) FROM sf) AS distinct_orders,
       CAST(SUM(n) AS BIGINT) - (SELECT COUNT(DISTINCT order_id) FROM sf) AS rows_beyond_distinct_orders FROM g"""))

add("dataset_profile", _fact_op(K.dataset_profile), with_fact(f"""
g AS (SELECT COUNT(*) AS n FROM sf GROUP BY {_ALL_COLS})
SELECT COUNT(*) AS rows, 20 AS columns, CAST(0 AS BIGINT) AS missing_cells, MIN(order_date) AS min_date, MAX(order_date) AS max_date,
       ROUND(COALESCE(SUM(sales), 0), 4) AS total_sales, ROUND(COALESCE(SUM(profit), 0), 4) AS total_profit,
       COUNT(DISTINCT order_id) AS unique_orders, COUNT(DISTINCT customer_id) AS unique_customers,
       (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM g) AS duplicate_rows,
       (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST(category AS VARCHAR) AS v FROM sf WHERE category IS NOT NULL ORDER BY v LIMIT 50)) AS category_list, (SELECT COUNT(DISTINCT category) FROM sf) AS category_values,
       (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST(region AS VARCHAR) AS v FROM sf WHERE region IS NOT NULL ORDER BY v LIMIT 50)) AS region_list, (SELECT COUNT(DISTINCT region) FROM sf) AS region_values,
       (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST(segment AS VARCHAR) AS v FROM sf WHERE segment IS NOT NULL ORDER BY v LIMIT 50)) AS segment_list, (SELECT COUNT(DISTINCT segment) FROM sf) AS segment_values
FROM sf"""))

add("health_metrics", _fact_op(K.health_metrics), with_fact("""
SELECT ROUND(SUM(sales), 4) AS sales, ROUND(SUM(profit), 4) AS profit,
       CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_rows, COUNT(*) AS rows,
       COUNT(DISTINCT order_id) AS distinct_orders,
       ROUND(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 4) AS loss_row_percent,
       ROUND(SUM(profit) / SUM(sales) * 100, 4) AS profit_margin_percent,
       COUNT(*) - COUNT(DISTINCT order_id) AS rows_sharing_an_order FROM sf"""))

# ---------------------------------------------------------------- G1 rankings
_RANK_COLS = grouped.PERF_COLUMNS + ["cost", "customer_count", "rank", "ranked_by"]
_RANK_SPECS = [  # (dim, metric, ascending, n)   Q16-Q21 plus a few more
    ("category", "profit", None, 10), ("region", "profit", None, 10), ("category", "margin", None, 10),
    ("segment", "sales", None, 10), ("product", "sales", None, 5), ("subcategory", "loss", None, 10),
    ("customer", "sales", None, 10), ("state", "discount", None, 10), ("product", "profit", True, 10),
    ("subcategory", "quantity", None, 10), ("state", "orders", None, 10), ("region", "customers", None, 10),
    ("category", "cost", None, 10),
]
_METRIC_SQL = {"sales": "sales", "profit": "profit", "loss": "profit", "margin": "profit_margin_percent",
               "discount": "average_discount", "cost": "cost", "quantity": "quantity", "orders": "order_count",
               "customers": "customer_count"}


def _rank_query(dim, metric, asc, n):
    def q(spark, sf_dir):
        df, roles = prepared_fact(spark, sf_dir)
        return R.rank_by(df, roles, dim, metric, asc, n).select(*_RANK_COLS)
    return q


def _rank_sql(dim, metric, asc, n):
    col = _METRIC_SQL[metric]
    where = "WHERE profit < 0" if metric == "loss" else ""
    direction = "ASC" if (asc or metric == "loss") else "DESC"
    return with_fact(perf_sql(dim, customers=True, cost=True) + f""",
r AS (SELECT * FROM perf {where} ORDER BY {col} {direction} NULLS LAST, dimension_value LIMIT {n})
SELECT {PERF_SELECT}, ROUND(cost, 4) AS cost, customer_count,
       CAST(ROW_NUMBER() OVER (ORDER BY {col} {direction} NULLS LAST, dimension_value) AS INTEGER) AS rank,
       '{col}' AS ranked_by FROM r""")


for _d, _m, _a, _n in _RANK_SPECS:
    add(f"rank_{_d}_by_{_m}" + ("_asc" if _a else ""), _rank_query(_d, _m, _a, _n), _rank_sql(_d, _m, _a, _n))

# ---------------------------------------------------------------- G3-G5 top-k rows
_ROW_ORDER = ", ".join(c.strip() for c in _ALL_COLS.split(",") if c.strip() not in ("sales", "profit"))


def _r4_cols():
    out = []
    for c in (x.strip() for x in _ALL_COLS.split(",")):
        out.append(f"ROUND({c}, 4) AS {c}" if c in ("quantity", "unit_price", "discount_pct", "sales", "cost", "profit") else c)
    return ", ".join(out)


add("top_records", lambda spark, d: R.top_records(prepared_fact(spark, d)[0], "sales", 10),
    with_fact(f"SELECT {_r4_cols()} FROM sf ORDER BY sales DESC, {_ALL_COLS.replace('sales, ', '')} LIMIT 10"))
add("loss_orders", _fact_op(R.loss_orders),
    with_fact(f"SELECT {_r4_cols()} FROM sf WHERE profit < 0 ORDER BY profit ASC, {_ALL_COLS.replace(', profit', '')} LIMIT 250"))


def _drill(spark, sf_dir):
    df, roles = prepared_fact(spark, sf_dir)
    return R.drilldown(grouped.performance(df, roles, "subcategory").select(*grouped.PERF_COLUMNS),
                       "loss_contribution_percent", 15)


add("drilldown", _drill, with_fact(perf_sql("subcategory") + f"""
SELECT {PERF_SELECT} FROM perf ORDER BY loss_contribution_percent DESC, dimension_value, sales, profit LIMIT 15"""))

def _stand_in(spark, sf_dir):
    """No product column, so the sub-category stands in."""
    df, roles = prepared_fact(spark, sf_dir)
    return grouped.performance(df.drop("product"), roles.with_roles(product=None), "product").select(*grouped.PERF_COLUMNS)


add("perf_by_product_stand_in", _stand_in, with_fact(perf_sql("subcategory") + f"\nSELECT {PERF_SELECT} FROM perf"))

# ---------------------------------------------------------------- C filters
_ENT = [("region", "asia"), ("segment", "Building")]
add("entity_filter", lambda spark, d: C.entity_filter(prepared_fact(spark, d)[0], _ENT),
    with_fact(f"SELECT {_r4_cols()} FROM sf WHERE lower(region) = 'asia' AND lower(segment) = 'building'"))
add("entity_filter_lenient",
    lambda spark, d: C.entity_filter_lenient(prepared_fact(spark, d)[0], _ENT + [("category", "no such category")]),
    with_fact(f"SELECT {_r4_cols()} FROM sf WHERE lower(region) = 'asia' AND lower(segment) = 'building'"))
# each value exists, but not together: the second predicate would leave nothing and is skipped
add("entity_filter_contradictory",
    lambda spark, d: C.entity_filter_lenient(prepared_fact(spark, d)[0], [("region", "asia"), ("state", "germany"), ("segment", "building")]),
    with_fact(f"SELECT {_r4_cols()} FROM sf WHERE lower(region) = 'asia' AND lower(segment) = 'building'"))


def _dash(spark, sf_dir):
    df, roles = prepared_fact(spark, sf_dir)
    return C.dashboard_filter(df, roles, "1996-01-01", "1997-06-30", {"region": ["EUROPE", "AMERICA"]},
                              loss_only=True, min_sales=1000)


add("dashboard_filter", _dash, with_fact(f"""
SELECT {_r4_cols()} FROM sf
WHERE (order_date IS NULL OR (order_date >= TIMESTAMP '1996-01-01' AND order_date <= TIMESTAMP '1997-06-30'))
  AND CAST(region AS VARCHAR) IN ('EUROPE', 'AMERICA') AND profit < 0 AND sales >= 1000"""))
add("loss_rows", _fact_op(C.loss_rows), with_fact(f"SELECT {_r4_cols()} FROM sf WHERE profit < 0"))
add("high_discount_loss_rows", _fact_op(C.high_discount_loss_rows),
    with_fact(f"SELECT {_r4_cols()} FROM sf WHERE discount_pct >= 30 AND profit < 0"))
add("multi_condition_loss", lambda spark, d: C.multi_condition_loss(*prepared_fact(spark, d), [("region", "europe")])[1],
    with_fact("""
SELECT product, ROUND(SUM(profit), 4) AS loss_amount, COUNT(*) AS loss_rows FROM sf
WHERE lower(region) = 'europe' AND profit < 0 GROUP BY product ORDER BY SUM(profit) ASC, product LIMIT 10"""))
add("multi_condition_loss_summary",
    lambda spark, d: C.multi_condition_loss(*prepared_fact(spark, d), [("region", "europe")])[0], with_fact("""
SELECT COUNT(*) AS loss_rows, ROUND(COALESCE(SUM(profit), 0), 4) AS loss_amount, ROUND(COALESCE(SUM(sales), 0), 4) AS sales
FROM sf WHERE lower(region) = 'europe' AND profit < 0"""))
add("unprofitable_pct", _fact_op(C.unprofitable_pct), with_fact("""
SELECT CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_rows, COUNT(*) AS rows,
       ROUND(AVG(CASE WHEN profit < 0 THEN 1 ELSE 0 END) * 100, 4) AS unprofitable_percent FROM sf"""))
add("unprofitable_pct_europe", _fact_op(C.unprofitable_pct, [("region", "EUROPE")]), with_fact("""
SELECT CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_rows, COUNT(*) AS rows,
       ROUND(AVG(CASE WHEN profit < 0 THEN 1 ELSE 0 END) * 100, 4) AS unprofitable_percent FROM sf
WHERE lower(region) = 'europe'"""))
_NF_VALUES = ["ASIA", "Atlantis", "promo", "Brand#13", "Nowhere Land"]
_NF_DIMS = ["category", "subcategory", "region", "state", "segment"]
add("values_not_found", _fact_op(C.values_not_found, _NF_VALUES, _NF_DIMS), with_fact(f"""
req AS (SELECT * FROM (VALUES {", ".join(f"('{v}')" for v in _NF_VALUES)}) t(requested)),
known AS ({" UNION ".join(f"SELECT lower(CAST({d} AS VARCHAR)) AS k FROM sf" for d in _NF_DIMS)})
SELECT requested FROM req WHERE lower(requested) NOT IN (SELECT k FROM known WHERE k IS NOT NULL)"""))
add("compare_values", lambda spark, d: R.compare_values(*prepared_fact(spark, d), "region", ["Europe", "asia"])
    .select(*grouped.PERF_COLUMNS), with_fact(perf_sql("region", where="WHERE lower(region) IN ('europe', 'asia')")
                                              + f"\nSELECT {PERF_SELECT} FROM perf"))
add("available_values", _fact_op(R.available_values, "subcategory"), with_fact(
    "SELECT DISTINCT CAST(subcategory AS VARCHAR) AS value FROM sf WHERE subcategory IS NOT NULL ORDER BY value LIMIT 25"))
