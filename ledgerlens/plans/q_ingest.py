"""Catalogue: CSV ingest, schema profiling and role inference.

The CSV is derived from the provided tables: the NULL-injected sales fact
written once (per input folder) to the shared folder with business-style
headers, currency text ("$1,234.50"), percent text ("25.0%"), US dates and a
pandas-style duplicate header ("Profit.1").  Ingest must undo all of it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ledgerlens.functions.dates import ensure_datetime
from ledgerlens.functions.scalars import format_currency
from ledgerlens.plans.registry import add
from ledgerlens.plans.sqlfrag import HOLES_SQL, with_fact
from ledgerlens.session import file_signature, shared_dir, write_slices
from ledgerlens.sources import ingest as IN
from ledgerlens.sources import roles_detect as RD
from ledgerlens.sources.testview import _exists, _fact_path, holed_fact, raw_fact, sales_fact_slices

HEADERS = [("Order ID", "order_id"), ("Order Date", "order_date"), ("Ship Date", "ship_date"), ("Ship Mode", "ship_mode"),
           ("Customer ID", "customer_id"), ("Customer Name", "customer"), ("Segment", "segment"), ("Region", "region"),
           ("State", "state"), ("Category", "category"), ("Sub-Category", "subcategory"), ("Product Name", "product"),
           ("Quantity", "quantity"), ("Unit Price", "unit_price"), ("Discount", "discount_pct"), ("Sales", "sales"),
           ("Cost", "cost"), ("Return Flag", "return_flag"), ("Profit", "profit"), ("Profit.1", "profit")]
FILE_ROWS = 250_000   # of one CSV file, which is read by one task
DEDUPED = IN.dedupe_columns([h for h, _ in HEADERS])


def messy(col, by, concat, newline, quote, comma):
    """A text column with quoted quotes, commas and (every 50th key) a line break, as exports have them."""
    c, k = F.col(col), F.pmod(F.col(by), F.lit(50))
    return F.when(k == 1, concat(c, newline, F.lit("x"))).when(k == 2, concat(c, comma, quote, F.lit("y"), quote)).otherwise(c)


MESSY_SQL = """CASE customer_id % 50 WHEN 1 THEN segment || chr(10) || 'x' WHEN 2 THEN segment || ', "y"' ELSE segment END"""


def csv_path(spark, sf_dir: str) -> str:
    """The CSV of this state of the source files: files of bounded size, gzipped; written from the star join itself when
    its table isn't there."""
    fact = _fact_path(spark, sf_dir)
    key = hashlib.sha1(f"{fact}|csv-v3".encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/ledgerlens/sales_csv_{key}"
    if not _exists(spark, path):
        text = {"order_date": F.date_format("order_date", "MM/dd/yyyy"), "ship_date": F.date_format("ship_date", "MM/dd/yyyy"),
                "discount_pct": F.concat(F.col("discount_pct").cast("string"), F.lit("%")),
                "segment": messy("segment", "customer_id", F.concat, F.lit("\n"), F.lit('"'), F.lit(", ")),
                "sales": F.when(F.col("sales").isNotNull(), format_currency(F.col("sales")))}
        facts = [raw_fact(spark, sf_dir)] if _exists(spark, fact) else sales_fact_slices(spark, sf_dir)
        parts = [holed_fact(spark, sf_dir, of=f) for f in facts]
        out = [df.select(*[(text.get(src, F.col(src).cast("string"))).alias(h) for h, src in HEADERS]) for df in parts]
        # header written as the first data line of each part? no: Spark writes the header per file
        write_slices(out, path, "csv", header=True, escape='"', compression="gzip", maxRecordsPerFile=FILE_ROWS)
    return path


def _ingest(spark, sf_dir: str) -> IN.Ingest:
    return IN.Ingest(spark, csv_path(spark, sf_dir))


_DETECTED: dict = {}


def detected(spark, sf_dir: str):
    """Roles of the ingested CSV and its evidence table; driver-side metadata, kept per state of the files."""
    steps = _ingest(spark, sf_dir)
    key = id(spark.sparkContext), steps.state
    if key not in _DETECTED:
        df = steps.typed()
        ev = IN.written_once(spark, f"evidence|{steps.state}", lambda: RD.column_evidence(df, steps.raw_shapes()))
        _DETECTED[key] = (*RD.detect(df, ev), ev)
    return _DETECTED[key]


def loaded(spark, sf_dir: str):
    """A1-A5 with dates parsed for the detected date roles."""
    roles, df = detected(spark, sf_dir)[0], _ingest(spark, sf_dir).typed()
    dates = [c for c in (roles.present(r, df.columns) for r in ("date", "ship_date")) if c]
    return df.withColumns({c: ensure_datetime(df, c) for c in dates}), roles


def _raw(spark, sf_dir):
    return _ingest(spark, sf_dir).raw()


_SRC = dict(HEADERS)
_NUMERIC = {"order_id", "customer_id", "quantity", "unit_price", "discount_pct", "sales", "cost", "profit"}
_DATES = {"order_date", "ship_date"}
_H = f"""holed AS (SELECT * REPLACE ({', '.join(f"CASE WHEN {HOLES_SQL[c]} THEN NULL ELSE {c} END AS {c}" for c in HOLES_SQL)}) FROM fact0),
hp AS (SELECT * REPLACE ({MESSY_SQL} AS segment), sales - cost AS profit FROM holed)"""


def _csv_col(name, src):
    if src in _DATES:
        return f"CAST(CAST({src} AS DATE) AS TIMESTAMP) AS \"{name}\""
    if src in _NUMERIC:
        return f"ROUND(CAST({src} AS DOUBLE), 4) AS \"{name}\""
    return f"CAST({src} AS VARCHAR) AS \"{name}\""


add("csv_scan", lambda spark, d: loaded(spark, d)[0], with_fact(_H + "\nSELECT " + ", ".join(
    _csv_col(n, s) for n, s in zip(DEDUPED, [s for _, s in HEADERS])) + " FROM hp"))

_TYPES = [("double" if s in _NUMERIC else "string") for _, s in HEADERS]
add("load_metadata", lambda spark, d: IN.load_metadata(IN.load(spark, csv_path(spark, d))), with_fact(
    _H + f"""
SELECT COUNT(*) AS rows, {len(HEADERS)} AS columns, '{", ".join(DEDUPED)}' AS column_names,
       '{", ".join(f"{n}:{t}" for n, t in zip(DEDUPED, _TYPES))}' AS dtypes FROM hp"""))

add("load_warnings", lambda spark, d: _ingest(spark, d).warnings(), with_fact(_H + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'renamed' AS kind, 'Column {i} ''{n}'' is read as ''{new}''.' AS warning" for i, ((n, _), new) in enumerate(zip(HEADERS, DEDUPED), 1) if n != new)
    + " UNION ALL SELECT 'dropped', 'Column ''Sales'' holds nothing.' FROM hp HAVING COUNT(sales) = 0)"))

add("raw_profile", lambda spark, d: IN.raw_profile(_raw(spark, d)), with_fact(_H + ",\nm AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", CAST(COUNT(*) - COUNT({s}) AS BIGINT) AS missing, COUNT(*) AS rows FROM hp"
    for n, s in zip(DEDUPED, [s for _, s in HEADERS])) + f"""),
dup AS (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT COUNT(*) AS n FROM hp GROUP BY ALL_COLS))
SELECT rows, "column", missing, (SELECT CAST(SUM(missing) AS BIGINT) FROM m) AS missing_cells_total, duplicate_rows FROM m, dup"""
    .replace("GROUP BY ALL_COLS", "GROUP BY " + ", ".join(dict.fromkeys(s for _, s in HEADERS)))))

add("numeric_coercion", lambda spark, d: _ingest(spark, d).shares(), with_fact(_H + "\nSELECT * FROM (" + " UNION ALL ".join(
    (f"SELECT '{n}' AS \"column\", ROUND(COUNT({s}) / COUNT(*), 4) AS numeric_share, TRUE AS converted FROM hp" if s in _NUMERIC
     else f"SELECT '{n}' AS \"column\", 0.0 AS numeric_share, FALSE AS converted")
    for n, s in zip(DEDUPED, [s for _, s in HEADERS])) + ")"))

# Golden rows: the headers say what each column is (every name is a pattern of its role), the values add dates and numbers.
_ROLES = [(r, n, "dates" if s in _DATES else "numbers" if r in RD.NUMERIC_VALUE_ROLES else "") for r, n, s in (
    (r, n, s) for r in RD.ROLE_PATTERNS for n, s in HEADERS if n.lower() in RD.ROLE_PATTERNS[r] or (r, n) == ("revenue", "Sales"))]
add("detect_roles", lambda spark, d: RD.role_table(IN.load(spark, csv_path(spark, d)), detected(spark, d)[2]), with_fact("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{r}' AS role, '{n}' AS \"column\", CAST({0.99 if holds else 0.98} AS DOUBLE) AS confidence, 'the name is ''{n.lower()}''{', holds ' + holds if holds else ''}' AS reason" for r, n, holds in _ROLES) + ")"))
add("column_types", lambda spark, d: RD.column_types(IN.load(spark, csv_path(spark, d)), detected(spark, d)[2]), with_fact(_H + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", '{'double' if s in _NUMERIC else 'string'}' AS dtype, CASE WHEN COUNT(TRY_CAST(CAST({s} AS VARCHAR) AS DOUBLE)) > 0 THEN 'numeric' "
    f"WHEN COUNT(TRY_CAST(CAST({s} AS VARCHAR) AS TIMESTAMP)) >= 0.7 * COUNT({s}) THEN 'date' ELSE 'text' END AS kind FROM hp"
    for n, s in zip(DEDUPED, [s for _, s in HEADERS])) + ")"))
add("preview_rows", lambda spark, d: IN.preview_rows(loaded(spark, d)[0], DEDUPED, 5), with_fact(_H + "\nSELECT " + ", ".join(
    _csv_col(n, s) for n, s in zip(DEDUPED, [s for _, s in HEADERS])) + " FROM hp ORDER BY " + ", ".join(
    (f"CAST({s} AS DOUBLE)" if s in _NUMERIC else (f"CAST({s} AS DATE)" if s in _DATES else s)) + " NULLS FIRST"
    for s in [s for _, s in HEADERS]) + " LIMIT 5"))
