"""Row filters and predicates.

Predicates are plain Column expressions, so Catalyst pushes the ones on stored
columns into the parquet scan.  "Skip a predicate that matches nothing" (C2)
needs one existence aggregate; it is joined back as a broadcast one-row table
instead of collected, so the plan stays lazy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import bi_discount_band, ci_equals, msum, month_key, profit_margin, quarter_key
from ledgerlens.operators.digests import numbered
from ledgerlens.operators.grouped import performance
from ledgerlens.roles import Roles


def _and(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def entity_filter(df: DataFrame, entities: list[tuple[str, str]]) -> DataFrame:
    """AND of case-insensitive equalities ``(column, value)``."""
    return df.where(_and([ci_equals(c, v) for c, v in entities if c in df.columns]))


def _covers(bits: Column):
    return lambda b: b.bitwiseAND(bits) == bits


def entity_filter_lenient(df: DataFrame, entities: list[tuple[str, str]]) -> DataFrame:
    """As C1, in order, but a predicate that would leave no row is skipped; no predicates -> all rows.

    A row is known by which predicates it meets, so one aggregate over these at most 2^k patterns (partial sums per
    task) says for each predicate in turn whether any row is left with those taken before it.
    """
    preds = [F.coalesce(ci_equals(c, v), F.lit(False)) for c, v in entities if c in df.columns]
    if not preds:
        return df
    bits = reduce(lambda a, b: a + b, [F.when(p, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(preds)])
    patterns = df.select(bits.cast("long").alias("_bits")).groupBy().agg(F.collect_set("_bits").alias("_met"))
    taken = F.lit(0).cast("long")
    for i in range(len(preds)):
        more = taken.bitwiseOR(F.lit(1 << i))
        taken = F.when(F.exists("_met", _covers(more)), more).otherwise(taken)
    one = patterns.select(taken.alias("_taken"))
    return (df.withColumn("_bits", bits.cast("long")).crossJoin(F.broadcast(one))
            .where(F.col("_bits").bitwiseAND(F.col("_taken")) == F.col("_taken")).drop("_bits", "_taken"))


def dashboard_filter(df: DataFrame, roles: Roles, date_from=None, date_to=None, in_lists: dict | None = None,
                     loss_only: bool = False, min_sales: float | None = None) -> DataFrame:
    """Date range (NULL dates kept; end compared at midnight), IN-lists on the
    string form, loss rows only, minimum sales."""
    out = df
    d = roles.present("date", df.columns)
    if d and date_from is not None and date_to is not None:
        lo, hi = F.to_timestamp(F.lit(str(date_from))), F.to_timestamp(F.lit(str(date_to)))
        out = out.where(F.col(d).isNull() | ((F.col(d) >= lo) & (F.col(d) <= hi)))
    for c, vals in (in_lists or {}).items():
        if c in df.columns and vals:
            out = out.where(F.col(c).cast("string").isin([str(v) for v in vals]))
    p, s = roles.present("profit", df.columns), roles.present("sales", df.columns)
    if loss_only and p:
        out = out.where(F.col(p) < 0)
    if min_sales not in (None, 0) and s:
        out = out.where(F.col(s) >= float(min_sales))
    return out


def loss_rows(df: DataFrame, roles: Roles) -> DataFrame:
    """C4: profit < 0 (NULL profit is not a loss)."""
    return df.where(F.col(roles.present("profit", df.columns)) < 0)


def high_discount_loss_rows(df: DataFrame, roles: Roles, threshold: float = 30.0) -> DataFrame:
    """Discount >= threshold (0-100 scale) and a loss."""
    d, p = roles.present("discount", df.columns), roles.present("profit", df.columns)
    return df.where((F.col(d) >= threshold) & (F.col(p) < 0))


def multi_condition_loss(df: DataFrame, roles: Roles, entities: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Entity equalities AND loss -> (summary row, top-10 loss products)."""
    p, s = roles.present("profit", df.columns), roles.present("sales", df.columns)
    sub = loss_rows(entity_filter(df, entities), roles)
    summary = sub.agg(F.count(F.lit(1)).alias("loss_rows"), F.coalesce(msum(p), F.lit(0.0)).alias("loss_amount"),
                      F.coalesce(msum(s), F.lit(0.0)).alias("sales"))
    prod = roles.present("product", df.columns)
    top = sub.groupBy(F.col(prod).alias("product")).agg(msum(p).alias("loss_amount"), F.count(F.lit(1)).alias("loss_rows")) \
             .orderBy(F.col("loss_amount").asc(), "product").limit(10)
    return summary, top


def unprofitable_pct(df: DataFrame, roles: Roles, entities: list[tuple[str, str]] | None = None) -> DataFrame:
    """Loss rows / all rows * 100, optionally inside an entity filter."""
    sub = entity_filter(df, entities) if entities else df
    p = F.col(roles.present("profit", df.columns))
    return sub.agg(F.sum((p < 0).cast("long")).alias("loss_rows"), F.count(F.lit(1)).alias("rows"),
                   (F.avg(F.when(p < 0, 1.0).otherwise(0.0)) * 100).alias("unprofitable_percent"))


def values_not_found(df: DataFrame, roles: Roles, values: list[str], dims: list[str]) -> DataFrame:
    """Requested values absent from every dimension (case-insensitive)."""
    spark = df.sparkSession
    req = spark.createDataFrame([(str(v),) for v in values], "requested string") \
               .withColumn("_k", F.lower(F.col("requested")))
    cols = [roles.present(d, df.columns) for d in dims if roles.present(d, df.columns)]
    known = None
    for c in cols:
        part = df.select(F.lower(F.col(c).cast("string")).alias("_k"))
        known = part if known is None else known.unionByName(part)
    known = known.distinct()
    return req.join(known, "_k", "left_anti").select("requested")


def bi_projection(df: DataFrame, roles: Roles) -> DataFrame:
    """C11: BI-ready columns.  Without an order id each row gets a key of its own, ``ROW-`` and its stable id (digest of the
    row and number among equal rows)."""
    def num(role):
        c = roles.present(role, df.columns)
        return F.col(c).cast("double") if c else F.lit(0.0)
    s, p, q, d = num("sales"), num("profit"), num("quantity"), num("discount")
    o, dt = roles.present("order_id", df.columns), roles.present("date", df.columns)
    key = F.col(o).cast("string") if o else F.concat(F.lit("ROW-"), F.col("_row").cast("string"))
    if not o:
        df = numbered(df, "_row")
    out = df.select(
        *[c for c in df.columns if c != "_row"], s.alias("bi_sales"), p.alias("bi_profit"), q.alias("bi_quantity"), d.alias("bi_discount"),
        (s - p).alias("bi_cost"), profit_margin(p, s).alias("bi_margin_percent"),
        F.when(p < 0, p).otherwise(F.lit(0.0)).alias("bi_loss_amount"), F.coalesce(p < 0, F.lit(False)).alias("bi_is_loss"),
        bi_discount_band(d).alias("bi_discount_band"),
        key.alias("bi_order_key"),
        (F.col(dt) if dt else F.lit(None).cast("timestamp")).alias("bi_date"))
    return out.withColumn("bi_year_month", F.coalesce(month_key("bi_date"), F.lit("Unknown"))) \
              .withColumn("bi_year", F.year("bi_date")) \
              .withColumn("bi_quarter", F.coalesce(F.concat(F.lit("Q"), F.quarter("bi_date").cast("string")), F.lit("Unknown")))


__all__ = ["entity_filter", "entity_filter_lenient", "dashboard_filter", "loss_rows", "high_discount_loss_rows",
           "multi_condition_loss", "unprofitable_pct", "values_not_found", "bi_projection",
           "performance", "quarter_key"]
