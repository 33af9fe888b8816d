"""Catalogue: per-row expressions over the fact that no other key uses (B14, B16, B20, B24), and ingest and sink pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import filters as C
from ledgerlens.plans.registry import add
from ledgerlens.plans.sqlfrag import with_fact
from ledgerlens.session import shared_dir
from ledgerlens.sources import ingest as IN
from ledgerlens.sources import sinks
from ledgerlens.sources.testview import holed_fact, prepared_fact


def _columns(**exprs):
    def q(spark, d):
        return prepared_fact(spark, d)[0].select("order_id", "line_no", *[make().alias(n) for n, make in exprs.items()])
    return q


add("scalar_text_forms", _columns(
    business_date=lambda: S.business_date("order_date"), dedupe_key=lambda: S.dedupe_key("product"),
    discount_text=lambda: S.format_percent("discount_pct"), sales_quality=lambda: S.backtest_quality("discount_pct"),
    profit_quality=lambda: S.backtest_quality("discount_pct", "profit")), with_fact("""
SELECT order_id, line_no, strftime(order_date, '%B %-d %Y') AS business_date, trim(regexp_replace(lower(product), '[^a-z0-9]+', ' ', 'g')) AS dedupe_key,
       CASE WHEN discount_pct IS NULL THEN 'N/A' ELSE printf('%.2f', discount_pct) || '%' END AS discount_text,
       CASE WHEN discount_pct < 10 THEN 'Strong' WHEN discount_pct < 25 THEN 'Acceptable' WHEN discount_pct >= 25 THEN 'Weak' END AS sales_quality,
       CASE WHEN discount_pct < 20 THEN 'Good' WHEN discount_pct < 50 THEN 'Moderate' WHEN discount_pct >= 50 THEN 'Weak' END AS profit_quality FROM sf"""))

_GONE = "(order_id + line_no) % 41 = 1"


def _drop_empty(spark, d):
    """A3 over a frame with whole rows and one column emptied."""
    df = holed_fact(spark, d).select("order_id", "line_no", "segment", "sales", F.expr(_GONE).alias("gone"))
    holed = df.select(*[F.when(~F.col("gone"), F.col(c)).alias(c) for c in df.columns if c != "gone"], F.lit(None).cast("string").alias("blank"))
    return IN.drop_empty(holed)


add("drop_empty", _drop_empty, with_fact(f"""
SELECT order_id, line_no, segment, CASE WHEN (order_id + line_no) % 11 = 0 THEN NULL ELSE ROUND(sales, 4) END AS sales FROM fact0 WHERE NOT ({_GONE})"""))


def _exported(spark, d):
    """Filtered rows as they are read back from the export."""
    df, roles = prepared_fact(spark, d)
    path = f"{shared_dir(spark)}/ledgerlens/export_{uuid.uuid4().hex[:12]}"
    rows = C.loss_rows(df, roles).select("order_id", "line_no", "customer", "sales", "profit")
    return spark.read.option("header", True).schema(rows.schema).csv(sinks.export_filtered(rows, path))


add("export_filtered", _exported, with_fact("SELECT order_id, line_no, customer, ROUND(sales, 4) AS sales, ROUND(profit, 4) AS profit FROM sf WHERE profit < 0"))


def _results(spark, d):
    """Nested results written whole (more rows than any report page) and read back."""
    df, _ = prepared_fact(spark, d)
    path = f"{shared_dir(spark)}/ledgerlens/results_{uuid.uuid4().hex[:12]}"
    written = sinks.write_results({"sales": {"rows": df.select("order_id", "line_no", "sales")}, "note": "no table"}, path)
    return spark.read.parquet(written[0])


add("write_results", _results, with_fact("SELECT order_id, line_no, ROUND(sales, 4) AS sales FROM sf"))
