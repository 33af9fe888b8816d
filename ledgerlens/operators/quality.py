"""Data-quality tables and score.

Per-column statistics for many columns are computed by unpivoting values into
``(column, value)`` pairs and aggregating once (one shuffle, map-side partial
aggregation) instead of one job per column.  IQR bounds are one aggregate;
outlier counts a second pass with the bounds broadcast as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import date_columns, ensure_datetime, invalid_dates
from ledgerlens.operators.digests import row_counts
from ledgerlens.operators.quantiles import iqr_bounds, outside, with_quantiles
from ledgerlens.roles import Roles
from ledgerlens.session import materialise

# --- fixed values --------------------------------------------------------
BUSINESS_METRIC_ROLES = ("sales", "revenue", "profit", "cost", "quantity", "discount")
RETURN_WORDS = ("return", "refund", "credit", "cancel", "rma", "debit note", "credit note")
RETURN_VALUE_PATTERN = "return|refund|credit|cancel|rma"
SCORE_CAPS = {"missing": (35, 1.5), "duplicates": (20, 2.0), "empty": (15, 5.0), "constant": (10, 1.5),
              "outliers": (8, 0.4), "negatives": (10, 1.0), "dates": (15, 1.0)}
TOP_VALUES = 5
SAMPLE_VALUES = 5
# ------------------------------------------------------------------------

_NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint", "decimal")


def _is_numeric(t: str) -> bool:
    return t.split("(")[0] in _NUMERIC


def _is_datetime(t: str) -> bool:
    return t.startswith("timestamp") or t == "date"


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if _is_numeric(t)]


def datetime_columns(df: DataFrame) -> list[str]:
    """Typed date columns and text or compact-number columns that hold dates."""
    return date_columns(df)


def outlier_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, outlier_count) for numeric ``cols`` in two passes."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, outlier_count long")
    t = df.select(*cols).crossJoin(F.broadcast(iqr_bounds(df, [(f"_{i}", c) for i, c in enumerate(cols)])))
    one = t.agg(*[F.sum(outside(f"_{i}", F.col(c).cast("double")).cast("long")).alias(f"o_{i}") for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o_{i}").alias("outlier_count"))
                                          for i, c in enumerate(cols)])).alias("r")).select("r.*")


def _pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unpivot to (column, value-as-string); NULL values kept."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("p")).select("p.*")


def _at_most_one(c: str, dtype: str) -> Column:
    """Aggregate: does the column hold at most one value?  Texts are compared by two 64-bit hashes: their least and greatest
    can't be kept in an aggregate's row, and comparing them would take the aggregate out of compiled code."""
    x = F.col(f"`{c}`")
    if dtype != "string":
        return F.min(x).eqNullSafe(F.max(x))
    hashes = [F.when(x.isNotNull(), F.xxhash64(F.lit(k), x)) for k in (1, 2)]
    return F.min(hashes[0]).eqNullSafe(F.max(hashes[0])) & F.min(hashes[1]).eqNullSafe(F.max(hashes[1]))


def missing_counts(df: DataFrame) -> DataFrame:
    """Per column: missing count, rows and whether it holds at most one value, in one pass without a shuffle of values."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[a for i, (c, t) in enumerate(df.dtypes) for a in (
        F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"m{i}"), _at_most_one(c, t).alias(f"k{i}"))])
    cells = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("missing_count"), F.col(f"k{i}").alias("constant"))
             for i, c in enumerate(df.columns)]
    return one.select("rows", F.explode(F.array(*cells)).alias("r")).select("r.*", "rows")


def distinct_values(df: DataFrame) -> DataFrame:
    """(column, value): the distinct values of all columns, written once (both the counts and the samples read them)."""
    return materialise(_pairs(df, df.columns).where(F.col("value").isNotNull()).distinct(), "values")


def column_stats(df: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Per column: missing and exact distinct counts."""
    uniq = (distinct_values(df) if values is None else values).groupBy("column").agg(F.count("value").alias("unique_count"))
    return missing_counts(df).join(uniq, "column", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("long")))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values, most first."""
    st = missing_counts(df)
    return st.where(F.col("missing_count") > 0).select(
        "column", "missing_count", (F.col("missing_count") / F.col("rows") * 100).alias("missing_percent")) \
        .orderBy(F.col("missing_count").desc(), "column")


def column_profile(df: DataFrame) -> DataFrame:
    """Dtype, missing and unique counts and %, IQR outliers (numeric), issues."""
    dtypes = df.sparkSession.createDataFrame(list(df.dtypes), "column string, dtype string")
    vals = distinct_values(df)
    st = column_stats(df, vals).join(F.broadcast(dtypes), "column")
    oc = outlier_counts(df, numeric_columns(df))
    t = st.join(oc, "column", "left")
    # five smallest distinct values, taken per column by rank before anything is gathered
    w = Window.partitionBy("column").orderBy("value")
    samples = vals.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= SAMPLE_VALUES).groupBy("column") \
                  .agg(F.array_join(F.sort_array(F.collect_list("value")), " | ").alias("sample_values"))
    t = t.join(samples, "column", "left")
    issues = F.concat_ws("; ", F.when(F.col("missing_count") > 0, F.lit("missing values")),
                         F.when(F.col("unique_count") <= 1, F.lit("constant or near-empty column")),
                         F.when(F.col("outlier_count") > 0, F.concat(F.col("outlier_count").cast("string"), F.lit(" IQR outliers"))))
    return t.select("column", "dtype", "missing_count", (F.col("missing_count") / F.col("rows") * 100).alias("missing_percent"),
                    "unique_count", (F.col("unique_count") / F.col("rows") * 100).alias("unique_percent"), "outlier_count",
                    issues.alias("detected_issues"), F.coalesce("sample_values", F.lit("")).alias("sample_values")).orderBy("column")


def numeric_checks(df: DataFrame, roles: Roles) -> DataFrame:
    """Per metric role negative/zero counts, min, max, mean, median, outlier count."""
    specs = [(m, roles.present(m, df.columns)) for m in ("sales", "profit", "quantity", "discount", "cost") if roles.present(m, df.columns)]
    cols = [c for _, c in specs]
    aggs = []
    for m, c in specs:
        x = F.col(c).cast("double")
        aggs += [F.sum((x < 0).cast("long")).alias(f"{m}__negative_count"), F.sum((x == 0).cast("long")).alias(f"{m}__zero_count"),
                 F.min(x).alias(f"{m}__min"), F.max(x).alias(f"{m}__max"), F.avg(x).alias(f"{m}__mean")]
    one = with_quantiles(df.agg(*aggs), df, {f"{m}__median": (F.col(c), 0.5) for m, c in specs})
    oc = outlier_counts(df, cols)
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column"),
                     *[F.col(f"{m}__{k}").alias(k) for k in ("negative_count", "zero_count", "min", "max", "mean", "median")])
            for m, c in specs]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").join(oc, "column", "left").orderBy("metric")


def date_checks(df: DataFrame, roles: Roles) -> DataFrame:
    """Invalid dates (values that are there but no date), min, max and span in days."""
    d = roles.present("date", df.columns)
    x = ensure_datetime(df, d)
    out = df.agg(F.coalesce(invalid_dates(df, d), F.lit(0).cast("long")).alias("invalid_dates"), F.date_format(F.min(x), "yyyy-MM-dd").alias("min_date"),
                 F.date_format(F.max(x), "yyyy-MM-dd").alias("max_date"), F.count(x).alias("_n"),
                 F.datediff(F.max(x), F.min(x)).alias("_span"))
    return out.select("invalid_dates", "min_date", "max_date",
                      F.when(F.col("_n") >= 2, F.col("_span")).alias("date_range_days"))


def has_return_context(df: DataFrame) -> DataFrame:
    """Return words in a column name, or a value in any text column."""
    if any(any(w in c.lower() for w in RETURN_WORDS) for c in df.columns):
        return df.sparkSession.range(1).select(F.lit(True).alias("has_return_context"))
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df.sparkSession.range(1).select(F.lit(False).alias("has_return_context"))
    hit = None
    for c in text:
        h = F.coalesce(F.lower(F.col(c)).rlike(RETURN_VALUE_PATTERN), F.lit(False))
        hit = h if hit is None else hit | h
    return df.agg(F.coalesce(F.max(hit), F.lit(False)).alias("has_return_context"))


def _duplicates(df: DataFrame) -> DataFrame:
    return row_counts(df).select(F.col("duplicate_rows").alias("duplicate_rows_count"))


def dq_basic(df: DataFrame) -> DataFrame:
    """I11 basic checks (one row)."""
    st = missing_counts(df)
    n_cols = len(df.columns)
    num, dts = numeric_columns(df), datetime_columns(df)
    cat = [c for c in df.columns if c not in num and c not in dts]
    agg = st.agg(F.first("rows").alias("row_count"), F.sum("missing_count").alias("missing_cells_total"),
                 # one entry per column: bounded by the schema width, not by the data
                 F.array_join(F.sort_array(F.collect_list(F.when(F.col("missing_count") == F.col("rows"), F.col("column")))), ",").alias("empty_columns"),
                 F.array_join(F.sort_array(F.collect_list(F.when(F.col("constant"), F.col("column")))), ",").alias("constant_columns"),
                 F.array_join(F.sort_array(F.collect_list(F.when(F.col("missing_count") > 0, F.col("column")))), ",").alias("columns_with_missing_values"),
                 F.sum(F.when(F.col("missing_count") == F.col("rows"), 1).otherwise(0)).alias("_n_empty"),
                 F.sum(F.col("constant").cast("int")).alias("_n_constant"))
    out = agg.crossJoin(_duplicates(df)).withColumn("column_count", F.lit(n_cols))
    return out.select(
        "row_count", "column_count", "duplicate_rows_count",
        (F.col("duplicate_rows_count") / F.greatest(F.col("row_count"), F.lit(1)) * 100).alias("duplicate_rows_percent"),
        "missing_cells_total", (F.col("missing_cells_total") / F.greatest(F.col("row_count") * n_cols, F.lit(1)) * 100).alias("missing_cells_percent"),
        "columns_with_missing_values", "empty_columns", "constant_columns", "_n_empty", "_n_constant",
        F.lit(",".join(num)).alias("numeric_columns"), F.lit(",".join(cat)).alias("categorical_columns"),
        F.lit(",".join(dts)).alias("datetime_columns"))


def dq_outliers(df: DataFrame, roles: Roles) -> DataFrame:
    """IQR outliers per numeric column, split into technical vs business-metric columns."""
    business = {roles.get(r) for r in BUSINESS_METRIC_ROLES if roles.present(r, df.columns)}
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    oc = outlier_counts(df, numeric_columns(df)).where(F.col("outlier_count") > 0)
    return oc.crossJoin(F.broadcast(rows)).select(
        "column", "outlier_count", (F.col("outlier_count") / F.greatest(F.col("_rows"), F.lit(1)) * 100).alias("outlier_percent"),
        F.col("column").isin(*business).alias("business_metric")).orderBy("column")


def dq_signals(df: DataFrame, roles: Roles) -> DataFrame:
    """Negative values as warnings or business signals (negative profit is a signal;
    negative sales/quantity are signals only with return context)."""
    ret = has_return_context(df)
    specs = [(m, roles.present(m, df.columns)) for m in ("sales", "profit", "quantity", "discount", "cost") if roles.present(m, df.columns)]
    one = df.agg(*[F.sum((F.col(c).cast("double") < 0).cast("long")).alias(m) for m, c in specs]).crossJoin(ret)
    rows = []
    for m, c in specs:
        if m == "profit":
            kind = F.lit("business_signal")
        elif m in ("sales", "quantity"):
            kind = F.when(F.col("has_return_context"), F.lit("business_signal")).otherwise(F.lit("warning"))
        else:
            kind = F.lit("warning")
        rows.append(F.struct(kind.alias("kind"), F.lit(m).alias("metric"), F.lit(c).alias("column"), F.col(m).alias("negative_count")))
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("negative_count") > 0)
    return out.orderBy("metric")


def dq_score(df: DataFrame, roles: Roles) -> DataFrame:
    """100 minus capped penalties, clipped to 0..100, rounded to 2."""
    basic = dq_basic(df)
    business = {roles.get(r) for r in BUSINESS_METRIC_ROLES if roles.present(r, df.columns)}
    tech = outlier_counts(df, [c for c in numeric_columns(df) if c not in business]).agg(
        F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("tech_outliers"))
    sig = dq_signals(df, roles).where(F.col("kind") == "warning").agg(F.coalesce(F.sum("negative_count"), F.lit(0)).alias("bad_negatives"))
    d = roles.present("date", df.columns)
    bad_dates = df.agg(F.coalesce(invalid_dates(df, d), F.lit(0)).alias("bad_dates")) if d else df.sparkSession.range(1).select(F.lit(0).alias("bad_dates"))
    t = basic.crossJoin(tech).crossJoin(sig).crossJoin(bad_dates)
    rows = F.greatest(F.col("row_count"), F.lit(1))
    pen = lambda k, basis: F.least(F.lit(float(SCORE_CAPS[k][0])), basis * SCORE_CAPS[k][1])
    score = (F.lit(100.0) - pen("missing", F.col("missing_cells_percent")) - pen("duplicates", F.col("duplicate_rows_percent"))
             - pen("empty", F.col("_n_empty").cast("double")) - pen("constant", F.col("_n_constant").cast("double"))
             - pen("outliers", F.col("tech_outliers") / rows * 100) - pen("negatives", F.col("bad_negatives") / rows * 100)
             - pen("dates", F.col("bad_dates") / rows * 100))
    return t.select(F.least(F.greatest(F.bround(score, 2), F.lit(0.0)), F.lit(100.0)).alias("quality_score"),
                    F.col("missing_cells_percent").alias("missing_penalty_basis_percent"),
                    F.col("duplicate_rows_percent").alias("duplicate_penalty_basis_percent"),
                    (F.col("tech_outliers") / rows * 100).alias("technical_outlier_penalty_basis_percent"),
                    (F.col("bad_negatives") / rows * 100).alias("suspicious_negative_penalty_basis_percent"),
                    (F.col("bad_dates") / rows * 100).alias("invalid_date_penalty_basis_percent"))


def numeric_summary(df: DataFrame) -> DataFrame:
    """Per numeric column min, max, mean, median, sample std, IQR outlier count."""
    cols = numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    one = with_quantiles(df.agg(*aggs), df, {f"md{i}": (F.col(c), 0.5) for i, c in enumerate(cols)})
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"mn{i}").alias("min"), F.col(f"mx{i}").alias("max"),
                     F.col(f"av{i}").alias("mean"), F.col(f"md{i}").alias("median"), F.col(f"sd{i}").alias("std"))
            for i, c in enumerate(cols)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").join(outlier_counts(df, cols), "column").orderBy("column")


def categorical_summary(df: DataFrame, top: int = TOP_VALUES) -> DataFrame:
    """Per non-numeric column: distinct count, high-cardinality flag and its top values
    (count desc, value asc; NULL counted as a value)."""
    cols = [c for c, t in df.dtypes if not _is_numeric(t)]
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    vc = _pairs(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("value_count"))
    w = Window.partitionBy("column").orderBy(F.col("value_count").desc(), F.col("value").asc_nulls_first())
    topv = vc.withColumn("value_rank", F.row_number().over(w)).where(F.col("value_rank") <= top)
    uniq = vc.groupBy("column").agg(F.count("value").alias("unique_count")).crossJoin(F.broadcast(rows)) \
             .withColumn("high_cardinality", F.col("unique_count") > F.greatest(F.lit(50.0), F.col("_rows") * 0.5)).drop("_rows")
    return topv.join(uniq, "column").orderBy("column", "value_rank")


def top_values(df: DataFrame, col: str, n: int = 60) -> DataFrame:
    """Value counts of a column, top ``n`` (ties by value)."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")) \
             .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "value").limit(n)
