"""DuckDB SQL fragments for the oracle side of every registered query.

FACT is the canonical sales view (SURVEY 1.5) with money rounded to cents by
the same IEEE steps the Spark view uses, and profit = sales - cost.
"""

FACT = """
fact0 AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_orderdate AS order_date, l_shipdate AS ship_date,
         o_orderpriority AS ship_mode, c_custkey AS customer_id, c_name AS customer, c_mktsegment AS segment,
         r_name AS region, n_name AS state, p_type AS category, p_brand AS subcategory,
         p_name || ' #' || CAST(p_partkey AS VARCHAR) AS product,
         l_quantity AS quantity,
         FLOOR(l_extendedprice / NULLIF(l_quantity, 0) * 100 + 0.5) / 100 AS unit_price,
         FLOOR(5 * l_discount * 100 * 100 + 0.5) / 100 AS discount_pct,
         FLOOR(l_extendedprice * (1 - 5 * l_discount) * 100 + 0.5) / 100 AS sales,
         FLOOR(l_quantity * p_retailprice * (CASE WHEN p_type = 'PROMO' AND r_name = 'EUROPE' THEN 2.8
                                                  WHEN p_type = 'PROMO' THEN 2.0
                                                  WHEN r_name = 'EUROPE' THEN 1.7 ELSE 0.9 END) * 100 + 0.5) / 100 AS cost,
         l_returnflag AS return_flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey),
sf AS (SELECT *, sales - cost AS profit FROM fact0)"""


#: The fact's columns and their kinds.
STAR_COLUMNS = {c: "double" if c in ("quantity", "unit_price", "discount_pct", "sales", "cost", "profit") else "time" if c.endswith("_date") else "text" for c in (
    "order_id", "line_no", "order_date", "ship_date", "ship_mode", "customer_id", "customer", "segment", "region", "state",
    "category", "subcategory", "product", "quantity", "unit_price", "discount_pct", "sales", "cost", "return_flag", "profit")}
BI_BAND = ("CASE WHEN discount_pct IS NULL THEN 'Unknown' WHEN discount_pct <= 0 THEN '0%' WHEN discount_pct <= 10 THEN '0-10%' WHEN discount_pct <= 20 THEN '10-20%' "
           "WHEN discount_pct <= 30 THEN '20-30%' WHEN discount_pct <= 40 THEN '30-40%' ELSE '40%+' END")


def double_code_sql(x: str) -> str:
    """The 64-bit code of a double (exponent and fraction as an integer, with its sign)."""
    a = f"abs({x})"
    m = f"({a} * pow(2.0, -floor(log2({a}))))"
    turn = f"CASE WHEN {m} >= 2 THEN 1 WHEN {m} < 1 THEN -1 ELSE 0 END"
    size = (f"CAST(floor(log2({a})) + {turn} + 1023 AS BIGINT) * 4503599627370496 + "
            f"CAST(({m} * pow(2.0, -({turn})) - 1) * 4503599627370496 AS BIGINT)")
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE CAST(sign({x}) AS BIGINT) * ({size}) END)"


def row_digest_sql(columns: dict[str, str]) -> str:
    """MD5 of a row's canonical text; ``columns``: name to kind (text, double, time)."""
    text = {"text": "CAST({0} AS VARCHAR)", "time": "strftime({0}, '%Y-%m-%d %H:%M:%S')"}
    cells = []
    for c, kind in columns.items():
        v = f"CAST({double_code_sql(c)} AS VARCHAR)" if kind == "double" else text[kind].format(c)
        cells.append(f"CASE WHEN {c} IS NULL THEN '-' ELSE length({v}) || ':' || {v} END")
    return f"md5({' || '.join(cells)})"


def half_up_sql(sql: str, scale: int = 4) -> str:
    """Rewrite ``ROUND(expr, 4)`` as the engine-neutral ``FLOOR(expr * 10^4 + 0.5) / 10^4``."""
    out, i, key = [], 0, "ROUND("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        expr, _, sc = inner.rpartition(",")
        if sc.strip() == str(scale) and expr:
            m = 10 ** scale
            out.append(sql[i:j] + f"(FLOOR(({half_up_sql(expr, scale)}) * {m} + 0.5) / {m})")
        else:
            out.append(sql[i:k])
        i = k


_MONEY = __import__("re").compile(r"(?<![A-Za-z_])(sales|profit|cost|loss_amount|_profit)(?![A-Za-z_])")
_AFTER_OVER = __import__("re").compile(r"\s*OVER\b", __import__("re").I)


def money_sums(sql: str) -> str:
    """Snap money ``SUM(...)`` to cents exactly where the Spark side uses ``msum``:
    plain sums of sales/profit/cost amounts -- not window sums, not counts
    (``THEN 1 ELSE 0``), not weighted sums (``*`` or ``/`` inside)."""
    out, i = [], 0
    while True:
        j = sql.find("SUM(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 4])
            i = j + 4
            continue
        depth, k = 1, j + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        arg = sql[j + 4:k - 1]
        money = (_MONEY.search(arg) and "THEN 1 ELSE 0" not in arg and "*" not in arg and "/" not in arg
                 and not _AFTER_OVER.match(sql, k))
        if money:
            out.append(sql[i:j] + f"(FLOOR(SUM({money_sums(arg)}) * 100 + 0.5) / 100)")
        else:
            out.append(sql[i:j] + "SUM(" + money_sums(arg) + ")")
        i = k


def cents_sql(x: str) -> str:
    return f"(FLOOR(({x}) * 100 + 0.5) / 100)"


def with_fact(body: str) -> str:
    """Prefix a query that starts with further CTEs (``x AS (...)``) or a SELECT."""
    body = half_up_sql(money_sums(body.strip()))
    if body.upper().startswith("SELECT"):
        return f"WITH {FACT}\n{body}"
    return f"WITH {FACT},\n{body}"


def band(x: str) -> str:
    return (f"CASE WHEN COALESCE({x}, 0) < -0.001 THEN NULL WHEN COALESCE({x}, 0) <= 0 THEN '0%' "
            f"WHEN COALESCE({x}, 0) <= 10 THEN '0-10%' WHEN COALESCE({x}, 0) <= 20 THEN '10-20%' "
            f"WHEN COALESCE({x}, 0) <= 30 THEN '20-30%' WHEN COALESCE({x}, 0) <= 40 THEN '30-40%' ELSE '40%+' END")


def margin(p: str, s: str) -> str:
    return f"CASE WHEN {s} = 0 OR {s} IS NULL THEN 0.0 ELSE {p} / {s} * 100 END"


def r4(x: str, name: str) -> str:
    return f"ROUND({x}, 4) AS {name}"


def perf_sql(dim_expr: str, source: str = "sf", where: str = "", extra_cols: str = "",
             customers: bool = False, cost: bool = False) -> str:
    """Grouped performance table (E2/E3) as SQL CTEs named g and perf."""
    cust = ", COUNT(DISTINCT customer_id) AS customer_count" if customers else ""
    costc = ", SUM(COALESCE(cost, 0)) AS cost" if cost else ""
    return f"""
g AS (
  SELECT {dim_expr} AS dimension_value,
         SUM(COALESCE(sales, 0)) AS sales, SUM(COALESCE(profit, 0)) AS profit,
         SUM(COALESCE(quantity, 0)) AS quantity{costc}, AVG(discount_pct) AS average_discount,
         COUNT(DISTINCT order_id) AS order_count, COUNT(*) AS row_count,
         CAST(SUM(CASE WHEN sales IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved_sales_rows,
         CAST(SUM(CASE WHEN profit IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved_profit_rows,
         CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_rows{cust}
  FROM {source} {where} GROUP BY 1),
g2 AS (SELECT *, {margin('profit', 'sales')} AS profit_margin_percent,
              CASE WHEN profit < 0 THEN profit ELSE 0.0 END AS loss_amount FROM g),
tot AS (SELECT SUM(sales) AS ts, SUM(profit) AS tp, ABS(SUM(loss_amount)) AS tl FROM g2),
perf AS (
  SELECT g2.*,
         CASE WHEN ts <> 0 THEN sales / ts * 100 ELSE 0.0 END AS sales_contribution_percent,
         CASE WHEN tp <> 0 THEN profit / tp * 100 ELSE 0.0 END AS profit_contribution_percent,
         CASE WHEN tl <> 0 THEN ABS(loss_amount) / tl * 100 ELSE 0.0 END AS loss_contribution_percent,
         'distinct_order_id' AS order_count_basis{extra_cols}
  FROM g2 CROSS JOIN tot)"""


PERF_SELECT = """dimension_value, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit, ROUND(quantity, 4) AS quantity,
       ROUND(average_discount, 4) AS average_discount, order_count, row_count, unresolved_sales_rows,
       unresolved_profit_rows, loss_rows, ROUND(profit_margin_percent, 4) AS profit_margin_percent,
       ROUND(loss_amount, 4) AS loss_amount, ROUND(sales_contribution_percent, 4) AS sales_contribution_percent,
       ROUND(profit_contribution_percent, 4) AS profit_contribution_percent,
       ROUND(loss_contribution_percent, 4) AS loss_contribution_percent, order_count_basis"""


SYN_SQL = {"discount_band": band("discount_pct"), "month": "strftime(order_date, '%Y-%m')",
           "quarter": "CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR)",
           "year": "CAST(year(order_date) AS VARCHAR)"}


def dim_expr(d: str) -> str:
    return SYN_SQL.get(d, d)


def dim_perf_sql(dims, source: str = "sf", customers: bool = False, name: str = "dp") -> str:
    """Multi-dimension grouped table (cost always included) as CTE ``name``."""
    cust = ", COUNT(DISTINCT customer_id) AS customer_count" if customers else ""
    parts = [f"""SELECT '{d}' AS dimension, CAST({dim_expr(d)} AS VARCHAR) AS dimension_value,
         SUM(COALESCE(sales, 0)) AS sales, SUM(COALESCE(profit, 0)) AS profit, SUM(COALESCE(quantity, 0)) AS quantity,
         SUM(COALESCE(cost, 0)) AS cost, AVG(discount_pct) AS average_discount, COUNT(DISTINCT order_id) AS order_count,
         COUNT(*) AS row_count, CAST(SUM(CASE WHEN sales IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved_sales_rows,
         CAST(SUM(CASE WHEN profit IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved_profit_rows,
         CAST(SUM(CASE WHEN profit < 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_rows{cust}
  FROM {source} GROUP BY 2""" for d in dims]
    return f"""
{name}_g AS ({' UNION ALL '.join(parts)}),
{name}_g2 AS (SELECT *, {margin('profit', 'sales')} AS profit_margin_percent,
                 CASE WHEN profit < 0 THEN profit ELSE 0.0 END AS loss_amount FROM {name}_g),
{name}_t AS (SELECT dimension, SUM(sales) AS ts, SUM(profit) AS tp, ABS(SUM(loss_amount)) AS tl FROM {name}_g2 GROUP BY dimension),
{name} AS (SELECT {name}_g2.*,
         CASE WHEN ts <> 0 THEN sales / ts * 100 ELSE 0.0 END AS sales_contribution_percent,
         CASE WHEN tp <> 0 THEN profit / tp * 100 ELSE 0.0 END AS profit_contribution_percent,
         CASE WHEN tl <> 0 THEN ABS(loss_amount) / tl * 100 ELSE 0.0 END AS loss_contribution_percent
  FROM {name}_g2 JOIN {name}_t USING (dimension))"""


def dp_select(customers: bool = False, prefix: str = "") -> str:
    cols = ["dimension", "dimension_value", "sales", "profit", "quantity", "cost", "average_discount", "order_count",
            "row_count", "unresolved_sales_rows", "unresolved_profit_rows", "loss_rows"] + (["customer_count"] if customers else []) + \
           ["profit_margin_percent", "loss_amount", "sales_contribution_percent", "profit_contribution_percent",
            "loss_contribution_percent"]
    dbl = {"sales", "profit", "quantity", "cost", "average_discount", "profit_margin_percent", "loss_amount",
           "sales_contribution_percent", "profit_contribution_percent", "loss_contribution_percent"}
    return ", ".join(f"ROUND({prefix}{c}, 4) AS {c}" if c in dbl else f"{prefix}{c}" for c in cols)


def priority_sql(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in mapping.items()) + " ELSE 99 END"


from ledgerlens.sources.testview import HOLES as HOLES_SQL  # noqa: E402  (same text works in both engines)
