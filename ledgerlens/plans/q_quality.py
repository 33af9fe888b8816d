"""Catalogue: data quality and cleaning over the NULL-injected fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import clean as CL
from ledgerlens.operators import quality as Q
from ledgerlens.plans.registry import add
from ledgerlens.plans.sqlfrag import with_fact
from ledgerlens.roles import SALES_FACT_ROLES
from ledgerlens.sources.testview import HOLES, holed_fact, prepared_fact

COLS = ["order_id", "line_no", "order_date", "ship_date", "ship_mode", "customer_id", "customer", "segment", "region", "state",
        "category", "subcategory", "product", "quantity", "unit_price", "discount_pct", "sales", "cost", "return_flag", "profit"]
DTYPES = {"order_id": "bigint", "line_no": "int", "order_date": "timestamp_ntz", "ship_date": "timestamp_ntz",
          "customer_id": "bigint", "quantity": "double", "unit_price": "double", "discount_pct": "double", "sales": "double",
          "cost": "double", "profit": "double"}
NUMERIC = [c for c in COLS if DTYPES.get(c, "string") in ("bigint", "int", "double")]
TEXTUAL = [c for c in COLS if c not in NUMERIC]
DBL = {c for c in COLS if DTYPES.get(c) == "double"}
ROLES = SALES_FACT_ROLES  # profit present (derived in the holed view)

HOLED = "holed AS (SELECT " + ", ".join(
    f"CASE WHEN {HOLES[c]} THEN NULL ELSE {c} END AS {c}" if c in HOLES else c for c in COLS[:-1]) + \
    ", (CASE WHEN " + HOLES["sales"] + " THEN NULL ELSE sales END) - (CASE WHEN " + HOLES["cost"] + \
    " THEN NULL ELSE cost END) AS profit FROM fact0)"


def _h(fn, *a):
    return lambda spark, d: fn(holed_fact(spark, d), *a)


def _hr(fn, *a):
    return lambda spark, d: fn(holed_fact(spark, d), ROLES, *a)


_STATS = "cs AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing_count, COUNT(DISTINCT {c}) AS unique_count, "
    f"COUNT(*) AS rows FROM holed" for c in COLS) + ")"

add("missing_by_column", _h(Q.missing_by_column), with_fact(HOLED + ",\n" + _STATS + """
SELECT "column", missing_count, ROUND(missing_count / rows * 100, 4) AS missing_percent FROM cs WHERE missing_count > 0
ORDER BY missing_count DESC, "column" """))

_IQR = "iq AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}, COUNT({c}) AS n_{c}"
    for c in NUMERIC) + " FROM holed)"


def _out(c):
    x = f"CAST({c} AS DOUBLE)"
    return (f"COALESCE(n_{c} >= 4 AND (q3_{c} - q1_{c}) <> 0 AND ({x} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) "
            f"OR {x} > q3_{c} + 1.5 * (q3_{c} - q1_{c})), FALSE)")


_OC = "oc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(SUM(CASE WHEN {_out(c)} THEN 1 ELSE 0 END) AS BIGINT) AS outlier_count FROM holed, iq"
    for c in NUMERIC) + ")"
_DT = "dt AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{DTYPES.get(c, 'string')}')" for c in COLS) + ") t(\"column\", dtype))"

_SV = "sv AS (SELECT \"column\", string_agg(v, ' | ' ORDER BY v) AS sample_values FROM (" + " UNION ALL ".join(
    f"SELECT * FROM (SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM holed WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)"
    for c in COLS) + ") GROUP BY 1)"

add("column_profile", _h(Q.column_profile), with_fact(HOLED + ",\n" + _STATS + ",\n" + _IQR + ",\n" + _OC + ",\n" + _DT + ",\n" + _SV + """
SELECT cs."column", dtype, missing_count, ROUND(missing_count / rows * 100, 4) AS missing_percent, unique_count,
       ROUND(unique_count / rows * 100, 4) AS unique_percent, outlier_count,
       concat_ws('; ', CASE WHEN missing_count > 0 THEN 'missing values' END,
                 CASE WHEN unique_count <= 1 THEN 'constant or near-empty column' END,
                 CASE WHEN outlier_count > 0 THEN CAST(outlier_count AS VARCHAR) || ' IQR outliers' END) AS detected_issues,
       COALESCE(sample_values, '') AS sample_values
FROM cs LEFT JOIN sv USING ("column") JOIN dt USING ("column") LEFT JOIN oc USING ("column") ORDER BY "column" """))

_NC = [("sales", "sales"), ("profit", "profit"), ("quantity", "quantity"), ("discount", "discount_pct"), ("cost", "cost")]
add("numeric_checks", _hr(Q.numeric_checks), with_fact(HOLED + ",\n" + _IQR + ",\n" + _OC + ",\nnc AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{c}' AS \"column\", CAST(SUM(CASE WHEN {c} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_count, "
    f"CAST(SUM(CASE WHEN {c} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_count, MIN({c}) AS min, MAX({c}) AS max, AVG({c}) AS mean, "
    f"median({c}) AS median FROM holed" for m, c in _NC) + """)
SELECT "column", metric, negative_count, zero_count, ROUND(min, 4) AS min, ROUND(max, 4) AS max, ROUND(mean, 4) AS mean,
       ROUND(median, 4) AS median, outlier_count FROM nc LEFT JOIN oc USING ("column") ORDER BY metric"""))

BAD_DATE = "(order_id + line_no) % 37 = 2"


def _dirty(fn):
    """The operator over a frame whose order date is text, some of it no date."""
    def q(spark, d):
        df = holed_fact(spark, d)
        text = F.when(F.col("order_date").isNull(), None).when(F.expr(BAD_DATE), "soon").otherwise(F.date_format("order_date", "yyyy-MM-dd"))
        return fn(df.withColumn("order_date", text), ROLES)
    return q


def _dates_sql(bad: str) -> str:
    return f"""dc AS (SELECT *, CASE WHEN {bad} THEN 'soon' ELSE strftime(order_date, '%Y-%m-%d') END AS seen FROM holed),
dd AS (SELECT CAST(COUNT(*) FILTER (WHERE seen IS NOT NULL AND order_date IS NOT NULL AND TRY_CAST(seen AS DATE) IS NULL) AS BIGINT) AS invalid_dates,
              MIN(TRY_CAST(seen AS DATE)) AS lo, MAX(TRY_CAST(seen AS DATE)) AS hi, COUNT(TRY_CAST(seen AS DATE)) AS n FROM dc)"""


for _name, _run, _bad in (("date_checks", _hr(Q.date_checks), "FALSE"), ("date_checks_dirty", _dirty(Q.date_checks), f"order_date IS NOT NULL AND {BAD_DATE}")):
    add(_name, _run, with_fact(HOLED + ",\n" + _dates_sql(_bad) + """
SELECT invalid_dates, strftime(lo, '%Y-%m-%d') AS min_date, strftime(hi, '%Y-%m-%d') AS max_date,
       CASE WHEN n >= 2 THEN CAST(date_diff('day', lo, hi) AS INTEGER) END AS date_range_days FROM dd"""))

_DUP = f"dup AS (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows_count FROM (SELECT COUNT(*) AS n FROM holed GROUP BY {', '.join(COLS)}))"
_BASIC = HOLED + ",\n" + _STATS + ",\n" + _DUP + f""",
bs AS (SELECT MAX(rows) AS row_count, 20 AS column_count, (SELECT duplicate_rows_count FROM dup) AS duplicate_rows_count,
              CAST(SUM(missing_count) AS BIGINT) AS missing_cells_total,
              COALESCE(string_agg(CASE WHEN missing_count > 0 THEN "column" END, ',' ORDER BY "column"), '') AS columns_with_missing_values,
              COALESCE(string_agg(CASE WHEN missing_count = rows THEN "column" END, ',' ORDER BY "column"), '') AS empty_columns,
              COALESCE(string_agg(CASE WHEN unique_count <= 1 THEN "column" END, ',' ORDER BY "column"), '') AS constant_columns,
              SUM(CASE WHEN missing_count = rows THEN 1 ELSE 0 END) AS n_empty, SUM(CASE WHEN unique_count <= 1 THEN 1 ELSE 0 END) AS n_constant
       FROM cs)"""
add("dq_basic", lambda spark, d: Q.dq_basic(holed_fact(spark, d)).drop("_n_empty", "_n_constant"), with_fact(_BASIC + f"""
SELECT row_count, column_count, duplicate_rows_count, ROUND(duplicate_rows_count / GREATEST(row_count, 1) * 100, 4) AS duplicate_rows_percent,
       missing_cells_total, ROUND(missing_cells_total / GREATEST(row_count * column_count, 1) * 100, 4) AS missing_cells_percent,
       columns_with_missing_values, empty_columns, constant_columns, '{",".join(NUMERIC)}' AS numeric_columns,
       '{",".join(c for c in TEXTUAL if not DTYPES.get(c, "").startswith("timestamp"))}' AS categorical_columns,
       'order_date,ship_date' AS datetime_columns FROM bs"""))

_BUSINESS = ("sales", "profit", "cost", "quantity", "discount_pct")
add("dq_outliers", _hr(Q.dq_outliers), with_fact(HOLED + ",\n" + _IQR + ",\n" + _OC + f"""
SELECT "column", outlier_count, ROUND(outlier_count / GREATEST((SELECT COUNT(*) FROM holed), 1) * 100, 4) AS outlier_percent,
       "column" IN ({', '.join(f"'{c}'" for c in _BUSINESS)}) AS business_metric FROM oc WHERE outlier_count > 0 ORDER BY "column" """))

_SIG = ",\nsg AS (" + " UNION ALL ".join(
    f"SELECT '{'business_signal' if m == 'profit' else ('business_signal' if m in ('sales', 'quantity') else 'warning')}' AS kind, "
    f"'{m}' AS metric, '{c}' AS \"column\", CAST(SUM(CASE WHEN {c} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_count FROM holed"
    for m, c in _NC) + ")"   # the fact has a return_flag column: return context, so negative sales/quantity are signals
add("dq_signals", _hr(Q.dq_signals), with_fact(HOLED + _SIG + "\nSELECT * FROM sg WHERE negative_count > 0 ORDER BY metric"))

for _name, _run, _bad in (("dq_score", _hr(Q.dq_score), "FALSE"), ("dq_score_dirty", _dirty(Q.dq_score), f"order_date IS NOT NULL AND {BAD_DATE}")):
    add(_name, _run, with_fact(_BASIC + ",\n" + _dates_sql(_bad) + ",\n" + _IQR + ",\n" + _OC + _SIG + f""",
b2 AS (SELECT *, duplicate_rows_count / GREATEST(row_count, 1) * 100 AS dup_pct,
              missing_cells_total / GREATEST(row_count * column_count, 1) * 100 AS miss_pct FROM bs),
tech AS (SELECT COALESCE(SUM(outlier_count), 0) AS t FROM oc WHERE "column" NOT IN ({', '.join(f"'{c}'" for c in _BUSINESS)})),
neg AS (SELECT COALESCE(SUM(negative_count), 0) AS n FROM sg WHERE kind = 'warning'),
sc AS (SELECT b2.*, t, neg.n, invalid_dates, 100.0 - LEAST(35.0, miss_pct * 1.5) - LEAST(20.0, dup_pct * 2.0) - LEAST(15.0, n_empty * 5.0)
              - LEAST(10.0, n_constant * 1.5) - LEAST(8.0, t / GREATEST(row_count, 1) * 100 * 0.4)
              - LEAST(10.0, neg.n / GREATEST(row_count, 1) * 100 * 1.0)
              - LEAST(15.0, invalid_dates / GREATEST(row_count, 1) * 100) AS s FROM b2, tech, neg, dd)
SELECT LEAST(GREATEST(round_even(s, 2), 0.0), 100.0) AS quality_score, ROUND(miss_pct, 4) AS missing_penalty_basis_percent,
       ROUND(dup_pct, 4) AS duplicate_penalty_basis_percent,
       ROUND(t / GREATEST(row_count, 1) * 100, 4) AS technical_outlier_penalty_basis_percent,
       ROUND(n / GREATEST(row_count, 1) * 100, 4) AS suspicious_negative_penalty_basis_percent,
       ROUND(invalid_dates / GREATEST(row_count, 1) * 100, 4) AS invalid_date_penalty_basis_percent FROM sc"""))

add("numeric_summary", _h(Q.numeric_summary), with_fact(HOLED + ",\n" + _IQR + ",\n" + _OC + ",\nns AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", MIN(CAST({c} AS DOUBLE)) AS min, MAX(CAST({c} AS DOUBLE)) AS max, AVG(CAST({c} AS DOUBLE)) AS mean, "
    f"median(CAST({c} AS DOUBLE)) AS median, stddev_samp(CAST({c} AS DOUBLE)) AS std FROM holed" for c in NUMERIC) + """)
SELECT "column", ROUND(min, 4) AS min, ROUND(max, 4) AS max, ROUND(mean, 4) AS mean, ROUND(median, 4) AS median,
       ROUND(std, 4) AS std, outlier_count FROM ns JOIN oc USING ("column") ORDER BY "column" """))

_VC = "vc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS value_count FROM holed GROUP BY 2" for c in TEXTUAL) + ")"
add("categorical_summary", _h(Q.categorical_summary), with_fact(HOLED + ",\n" + _VC + """,
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY value_count DESC, value NULLS FIRST) AS value_rank FROM vc),
u AS (SELECT "column", COUNT(value) AS unique_count FROM vc GROUP BY 1)
SELECT "column", value, value_count, CAST(value_rank AS INTEGER) AS value_rank, unique_count,
       unique_count > GREATEST(50.0, (SELECT COUNT(*) FROM holed) * 0.5) AS high_cardinality
FROM r JOIN u USING ("column") WHERE value_rank <= 5 ORDER BY "column", value_rank"""))

add("top_values", lambda spark, d: Q.top_values(prepared_fact(spark, d)[0], "product", 60), with_fact("""
SELECT CAST(product AS VARCHAR) AS value, COUNT(*) AS count FROM sf WHERE product IS NOT NULL GROUP BY 1
ORDER BY count DESC, value LIMIT 60"""))

# without the return_flag column only the values can tell; both outcomes of the same search
_TEXT = ("ship_mode", "customer", "segment", "region", "state", "category", "subcategory", "product")
add("return_context", lambda spark, d: Q.has_return_context(prepared_fact(spark, d)[0].drop("return_flag")),
    with_fact("SELECT COALESCE(BOOL_OR(" + " OR ".join(f"regexp_matches(lower({c}), 'return|refund|credit|cancel|rma')" for c in _TEXT) + "), FALSE) AS has_return_context FROM sf"))
add("return_context_in_values", lambda spark, d: Q.has_return_context(prepared_fact(spark, d)[0].drop("return_flag").withColumn(
    "note", F.when(F.col("profit") < -1000, F.concat(F.lit("Refund to "), "customer")))),
    with_fact("SELECT COALESCE(BOOL_OR(regexp_matches(lower('refund to ' || customer), 'refund')) FILTER (WHERE profit < -1000), FALSE) AS has_return_context FROM sf"))

# ------------------------------------------------------------------ cleaning
_RAW_ROLES = SALES_FACT_ROLES.with_roles(profit=None)
_PREP = HOLED.replace("holed AS", "hraw AS") + """,
p0 AS (SELECT * EXCLUDE (profit), sales - cost AS profit FROM hraw),
s1 AS (SELECT * REPLACE (COALESCE(sales, quantity * unit_price) AS sales) FROM p0),
s2 AS (SELECT * REPLACE (COALESCE(profit, sales - cost) AS profit) FROM s1),
s3 AS (SELECT * REPLACE (COALESCE(cost, sales - profit) AS cost) FROM s2),
c3 AS (SELECT COUNT(*) - COUNT(cost) AS still, COUNT(*) AS rows, median(cost) AS med FROM s3),
s3b AS (SELECT s3.* REPLACE (CASE WHEN still > 0 AND still / rows <= 0.05 AND med IS NOT NULL THEN COALESCE(cost, med) ELSE cost END AS cost)
        FROM s3, c3),
s4 AS (SELECT * REPLACE (COALESCE(quantity, sales / NULLIF(unit_price, 0.0)) AS quantity) FROM s3b),
q4 AS (SELECT median(quantity) AS med FROM s4),
s4b AS (SELECT s4.* REPLACE (COALESCE(quantity, med) AS quantity) FROM s4, q4),
d5 AS (SELECT COUNT(discount_pct) AS n, AVG(CASE WHEN discount_pct = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE discount_pct IS NOT NULL) AS zero,
              median(discount_pct) AS med FROM s4b),
f5 AS (SELECT CASE WHEN n > 0 AND (zero >= 0.25 OR med <= 5) THEN 0.0 WHEN n > 0 THEN med END AS fill FROM d5),
s5 AS (SELECT s4b.* REPLACE (COALESCE(discount_pct, fill) AS discount_pct) FROM s4b, f5),
s6 AS (SELECT * REPLACE (COALESCE(category, 'Unknown Category') AS category, COALESCE(customer, 'Unknown Customer') AS customer) FROM s5)"""


def _prepared(spark, sf_dir):
    df, _ = CL.prepare_sales(holed_fact(spark, sf_dir, with_profit=False), _RAW_ROLES)
    return df


add("prepared_sales", _prepared, with_fact(_PREP + "\nSELECT " + ", ".join(
    f"ROUND({c}, 4) AS {c}" if c in DBL else c for c in COLS) + " FROM s6"))

add("treatment_log", lambda spark, d: CL.treatment_log(spark, holed_fact(spark, d, with_profit=False), _RAW_ROLES),
    with_fact(_PREP + """,
n0 AS (SELECT COUNT(*) - COUNT(sales) AS sales, COUNT(*) - COUNT(profit) AS profit, COUNT(*) - COUNT(cost) AS cost,
              COUNT(*) - COUNT(quantity) AS quantity, COUNT(*) - COUNT(discount_pct) AS discount,
              COUNT(*) - COUNT(category) AS category, COUNT(*) - COUNT(customer) AS customer, COUNT(*) - COUNT(order_date) AS order_date FROM p0),
n1 AS (SELECT COUNT(*) - COUNT(sales) AS v FROM s1), n2 AS (SELECT COUNT(*) - COUNT(profit) AS v FROM s2),
n3 AS (SELECT COUNT(*) - COUNT(cost) AS v FROM s3b), n4 AS (SELECT COUNT(*) - COUNT(quantity) AS v FROM s4),
l AS (
  SELECT 'sales' AS "column", 'sales' AS role, n0.sales AS missing_before,
         CASE WHEN n0.sales - n1.v > 0 THEN 'derived from quantity x unit price' ELSE 'left missing' END AS treatment,
         n0.sales - n1.v AS values_fixed, n0.sales - n1.v AS values_derived, 0 AS values_filled, n1.v AS values_still_missing,
         CAST(NULL AS DOUBLE) AS method_value, 1 AS o FROM n0, n1 WHERE n0.sales > 0
  UNION ALL SELECT 'profit', 'profit', n0.profit, 'derived from sales - cost / sales x margin %', n0.profit - n2.v, n0.profit - n2.v, 0,
         n2.v, NULL, 2 FROM n0, n2 WHERE n0.profit > 0
  UNION ALL SELECT 'cost', 'cost', n0.cost, 'derived from sales - profit; small gap median', n0.cost - n3.v, n0.cost - n3.v, 0, n3.v, NULL, 3
         FROM n0, n3 WHERE n0.cost > 0
  UNION ALL SELECT 'quantity', 'quantity', n0.quantity, 'derived from sales / unit price, then median', n0.quantity,
         n0.quantity - n4.v, CASE WHEN q4.med IS NOT NULL THEN n4.v ELSE 0 END, CASE WHEN q4.med IS NOT NULL THEN 0 ELSE n4.v END,
         q4.med, 4 FROM n0, n4, q4 WHERE n0.quantity > 0
  UNION ALL SELECT 'discount_pct', 'discount', n0.discount,
         CASE WHEN fill = 0.0 THEN 'filled with 0 (blank means no discount)' WHEN fill IS NOT NULL THEN 'filled with median' ELSE 'left missing' END,
         CASE WHEN fill IS NOT NULL THEN n0.discount ELSE 0 END, 0, CASE WHEN fill IS NOT NULL THEN n0.discount ELSE 0 END,
         CASE WHEN fill IS NOT NULL THEN 0 ELSE n0.discount END, fill, 5 FROM n0, f5 WHERE n0.discount > 0
  UNION ALL SELECT 'customer', 'label', n0.customer, 'filled as ''Unknown Customer''', n0.customer, 0, n0.customer, 0, NULL, 6
         FROM n0 WHERE n0.customer > 0
  UNION ALL SELECT 'category', 'label', n0.category, 'filled as ''Unknown Category''', n0.category, 0, n0.category, 0, NULL, 7
         FROM n0 WHERE n0.category > 0
  UNION ALL SELECT 'order_date', 'date', n0.order_date, 'not filled; excluded from time analysis', 0, 0, 0, n0.order_date, NULL, 8
         FROM n0 WHERE n0.order_date > 0)
SELECT "column", role, CAST(missing_before AS BIGINT) AS missing_before, treatment, CAST(values_fixed AS BIGINT) AS values_fixed,
       CAST(values_derived AS BIGINT) AS values_derived, CAST(values_filled AS BIGINT) AS values_filled,
       CAST(values_still_missing AS BIGINT) AS values_excluded, CAST(values_still_missing AS BIGINT) AS values_still_missing, ROUND(method_value, 4) AS method_value,
       CASE role """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CL.IMPACT.items()) + """ END AS impact FROM l ORDER BY o"""))
