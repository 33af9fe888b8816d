"""Preparation and missing-value repair.

Preparation decides a few scalars (percent scale, which columns have gaps,
repair medians) with small aggregate jobs, then expresses every repair as one
projection so the cleaned table is a single lazy plan.  Order matters: each
repair reads the output of the previous one, exactly as listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import to_double
from ledgerlens.operators.quantiles import with_quantiles
from ledgerlens.roles import Roles

# --- fixed values --------------------------------------------------------
CORE_NUMERIC_ROLES = ("sales", "revenue", "profit", "cost", "quantity", "discount", "unit_price", "margin_percent")
CATEGORICAL_ROLE_LABELS = {
    "category": "Unknown Category",
    "subcategory": "Unknown Sub-Category",
    "product": "Unknown Product",
    "customer": "Unknown Customer",
    "customer_id": "Unknown Customer ID",
    "region": "Unknown Region",
    "segment": "Unknown Segment",
    "city": "Unknown City",
    "state": "Unknown State",
    "country": "Unknown Country",
}
ID_ROLES = ("order_id", "customer_id")
DATE_ROLES = ("date", "ship_date")
PERCENT_RATIO_SHARE = 0.80      # B4: share of |v| <= 1 that marks a 0-1 ratio column
COST_MEDIAN_MAX_GAP = 0.05      # I4: median-fill cost only when <= 5 % of rows remain
DISCOUNT_ZERO_SHARE = 0.25      # I6
DISCOUNT_SMALL_MEDIAN = 5.0     # I6
OTHER_NUMERIC_PARSE_SHARE = 0.75  # I9
# What a treatment means for the results, by role.
IMPACT = {
    "sales": "rows without sales stay out of sales figures",
    "profit": "profit is worked out where it can be and never averaged",
    "cost": "cost is completed only by formula or over a small gap",
    "quantity": "volumes use the formula first and the median second",
    "discount": "blank discounts follow a stated rule",
    "label": "rows show under an Unknown group",
    "date": "rows without a date stay out of trends and forecasts",
    "other": "the column is completed by a stated statistic",
}
# ------------------------------------------------------------------------


def _dtype(df: DataFrame, c: str) -> str:
    return dict(df.dtypes)[c]


def numeric(df: DataFrame, c: str):
    return to_double(F.col(c), _dtype(df, c))


def profile_for_prepare(df: DataFrame, roles: Roles) -> tuple[dict[str, float], dict[str, int]]:
    """One aggregate deciding the B4 percent scale of the percent roles and
    counting NULLs of every column as it will look after numeric coercion and
    profit derivation (scaling never changes NULL-ness)."""
    pcols = [c for c in (roles.present("discount", df.columns), roles.present("margin_percent", df.columns)) if c]
    shaped, _ = derive_profit(_coerce_numeric_roles(df, roles), roles)
    aggs = []
    for i, c in enumerate(pcols):
        v = numeric(df, c)
        aggs.append(F.avg(F.when(v.isNotNull(), (F.abs(v) <= 1).cast("double"))).alias(f"r{i}"))
    aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(shaped.columns)]
    row = shaped.agg(*aggs).first()
    factors = {c: (100.0 if row[f"r{i}"] is not None and row[f"r{i}"] >= PERCENT_RATIO_SHARE else 1.0)
               for i, c in enumerate(pcols)}
    nulls = {c: int(row[f"n{i}"] or 0) for i, c in enumerate(shaped.columns)}
    return factors, nulls


def _coerce_numeric_roles(df: DataFrame, roles: Roles) -> DataFrame:
    cols = {roles.present(k, df.columns) for k in CORE_NUMERIC_ROLES} - {None}
    return df.select([numeric(df, c).alias(c) if c in cols else F.col(c) for c in df.columns])


def percent_scale_factors(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """One aggregate deciding, per column, whether to multiply by 100."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        v = numeric(df, c)
        aggs.append(F.avg(F.when(v.isNotNull(), (F.abs(v) <= 1).cast("double"))).alias(f"r{i}"))
    row = df.agg(*aggs).first()
    return {c: (100.0 if row[f"r{i}"] is not None and row[f"r{i}"] >= PERCENT_RATIO_SHARE else 1.0)
            for i, c in enumerate(cols)}


def normalize_percents(df: DataFrame, roles: Roles, factors: dict[str, float] | None = None) -> DataFrame:
    """B4 applied once to the discount and margin-percent roles."""
    cols = [c for c in (roles.present("discount", df.columns), roles.present("margin_percent", df.columns)) if c]
    factors = percent_scale_factors(df, cols) if factors is None else factors
    out = df
    for c, k in factors.items():
        v = numeric(df, c)
        out = out.withColumn(c, v * F.lit(k) if k != 1.0 else v)
    return out


def derive_profit(df: DataFrame, roles: Roles) -> tuple[DataFrame, Roles]:
    """profit = sales - cost, else sales * margin% / 100 (estimated)."""
    if roles.present("profit", df.columns):
        return df, roles
    s, c, m = roles.present("sales", df.columns), roles.present("cost", df.columns), roles.present("margin_percent", df.columns)
    if s and c:
        out = df.withColumn("profit", numeric(df, s) - numeric(df, c))
        return out, roles.with_roles(profit="profit", notes=roles.notes + (f"Profit was derived as {s} - {c}.",))
    if s and m:
        out = df.withColumn("profit", numeric(df, s) * (F.col(m) / F.lit(100.0)))
        return out, roles.with_roles(profit="profit", profit_estimated=True,
                                     notes=roles.notes + (f"Profit was estimated as {s} x {m}.",))
    return df, roles


def _null_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    if not cols:
        return {}
    row = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return {c: int(row[f"n{i}"] or 0) for i, c in enumerate(cols)}


def treat_missing(df: DataFrame, roles: Roles, nulls: dict[str, int] | None = None) -> tuple[DataFrame, list[dict]]:
    """I2-I9 on a frame whose percent roles are already normalised.

    Returns the repaired frame and the treatment log rows (I10).
    """
    cols = df.columns
    r = {k: roles.present(k, cols) for k in ("sales", "profit", "cost", "quantity", "unit_price", "margin_percent", "discount")}
    for k in ("sales", "profit", "cost", "quantity", "unit_price", "margin_percent", "discount"):
        if r[k]:
            df = df.withColumn(r[k], numeric(df, r[k]))
    label_cols = {roles.present(k, cols): lab for k, lab in CATEGORICAL_ROLE_LABELS.items() if roles.present(k, cols)}
    date_cols = [roles.present(k, cols) for k in DATE_ROLES if roles.present(k, cols)]
    protected = {c for c in (roles.get(k) for k in CORE_NUMERIC_ROLES + ID_ROLES + DATE_ROLES) if c} | set(label_cols)
    nulls = _null_counts(df, cols) if nulls is None else nulls
    log: list[dict] = []
    if not any(nulls.values()):
        return df, log

    def entry(column, role, before, treatment, fixed=0, derived=0, filled=0, still=0, value=None):
        log.append(dict(column=column, role=role, missing_before=int(before), treatment=treatment,
                        values_fixed=int(fixed), values_derived=int(derived), values_filled=int(filled),
                        values_excluded=int(still),
                        values_still_missing=int(still), method_value=value, impact=IMPACT[role]))

    s, p, c, q, up, m, d = (r[k] for k in ("sales", "profit", "cost", "quantity", "unit_price", "margin_percent", "discount"))

    # What formulas give comes first, for all columns: none of them needs a statistic.
    if s and nulls[s] and q and up:                                 # I2 sales = quantity * unit_price (never mean-filled)
        df = df.withColumn(s, F.coalesce(F.col(s), F.col(q) * F.col(up)))
    if p and nulls[p]:                                              # I3 profit = sales - cost, then sales * margin% / 100
        ways = [F.col(s) - F.col(c)] if s and c else []
        ways += [F.col(s) * (F.col(m) / F.lit(100.0))] if s and m else []
        df = df.withColumn(p, F.coalesce(F.col(p), *ways))
    if c and nulls[c] and s and p:                                  # I4 cost = sales - profit
        df = df.withColumn(c, F.coalesce(F.col(c), F.col(s) - F.col(p)))
    if q and nulls[q] and s and up:                                 # I5 quantity = sales / unit_price (price 0 -> none)
        df = df.withColumn(q, F.coalesce(F.col(q), F.try_divide(F.col(s), F.nullif(F.col(up), F.lit(0.0)))))
    others = [x for x in cols if x not in protected and nulls.get(x) and _dtype(df, x) != "string" and not _dtype(df, x).startswith(("timestamp", "date", "bool"))]
    # Then every count and statistic of every column from one aggregate and one quantile pass.
    left = [x for x in (s, p, c, q) if x and nulls[x]]
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(x).isNull().cast("long")).alias(f"left_{i}") for i, x in enumerate(left)]]
    wanted = {f"med_{x}": (F.col(x), 0.5) for x in (c, q, d) if x and nulls[x]}
    if d and nulls[d]:
        aggs += [F.avg(F.when(F.col(d).isNotNull(), (F.col(d) == 0).cast("double"))).alias("zero"), F.count(F.col(d)).alias("n_discount")]
    for i, x in enumerate(others):
        v = F.col(x).cast("double")
        aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"sd{i}"), F.count(v).alias(f"n{i}")]
        wanted |= {f"m{i}": (v, 0.5), f"q1_{i}": (v, 0.25), f"q3_{i}": (v, 0.75)}
    st = with_quantiles(df.agg(*aggs), df, wanted).first()
    still = {x: int(st[f"left_{i}"] or 0) for i, x in enumerate(left)}

    if s and nulls[s]:
        got = nulls[s] - still[s]
        entry(s, "sales", nulls[s], "derived from quantity x unit price" if got else "left missing", fixed=got, derived=got, still=still[s])
    if p and nulls[p]:
        got = nulls[p] - still[p]
        entry(p, "profit", nulls[p], "derived from sales - cost / sales x margin %", fixed=got, derived=got, still=still[p])
    # I4 then median when the remaining gap is small
    if c and nulls[c]:
        gap, med = still[c], st[f"med_{c}"]
        filled = gap if gap and gap / max(st["rows"], 1) <= COST_MEDIAN_MAX_GAP and med is not None else 0
        if filled:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(float(med))))
        entry(c, "cost", nulls[c], "derived from sales - profit; small gap median", fixed=nulls[c] - gap + filled,
              derived=nulls[c] - gap, filled=filled, still=gap - filled)
    # I5 then median
    if q and nulls[q]:
        gap, med = still[q], st[f"med_{q}"]
        filled = gap if med is not None else 0
        if med is not None:
            df = df.withColumn(q, F.coalesce(F.col(q), F.lit(float(med))))
        entry(q, "quantity", nulls[q], "derived from sales / unit price, then median", fixed=nulls[q] - gap + filled,
              derived=nulls[q] - gap, filled=filled, still=gap - filled, value=med)
    # I6 discount: 0 when blanks likely mean "no discount", else median
    if d and nulls[d]:
        med = st[f"med_{d}"]
        if st["n_discount"] and (st["zero"] >= DISCOUNT_ZERO_SHARE or med <= DISCOUNT_SMALL_MEDIAN):
            fill, how = 0.0, "filled with 0 (blank means no discount)"
        elif st["n_discount"]:
            fill, how = float(med), "filled with median"
        else:
            fill, how = None, "left missing"
        if fill is not None:
            df = df.withColumn(d, F.coalesce(F.col(d), F.lit(fill)))
        entry(d, "discount", nulls[d], how, fixed=nulls[d] if fill is not None else 0,
              filled=nulls[d] if fill is not None else 0, still=0 if fill is not None else nulls[d], value=fill)
    # I7 category labels
    for col, lab in label_cols.items():
        if nulls.get(col):
            df = df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit(lab)) if _dtype(df, col) == "string"
                               else F.col(col))
            if _dtype(df, col) == "string":
                entry(col, "label", nulls[col], f"filled as '{lab}'", fixed=nulls[col], filled=nulls[col])
    # I8 dates: log only
    for col in date_cols:
        if nulls.get(col):
            entry(col, "date", nulls[col], "not filled; excluded from time analysis", still=nulls[col])
    # I9 other numeric columns with gaps: median if skewed else mean
    bounds = {}
    for i, x in enumerate(others):
        iqr = st[f"q3_{i}"] - st[f"q1_{i}"] if st[f"n{i}"] else 0
        if st[f"n{i}"] >= 4 and iqr:
            bounds[i] = (st[f"q1_{i}"] - 1.5 * iqr, st[f"q3_{i}"] + 1.5 * iqr)
    beyond = {}
    if bounds:
        outside = [F.max((F.col(others[i]).cast("double") < lo) | (F.col(others[i]).cast("double") > hi)).alias(f"o{i}") for i, (lo, hi) in bounds.items()]
        found = df.agg(*outside).first()
        beyond = {i: bool(found[f"o{i}"]) for i in bounds}
    for i, x in enumerate(others):
        if not st[f"n{i}"]:
            entry(x, "other", nulls[x], "left missing", still=nulls[x])
            continue
        sd = st[f"sd{i}"]
        skewed = st[f"n{i}"] < 6 or (sd and abs(st[f"mean{i}"] - st[f"m{i}"]) > 0.5 * sd) or beyond.get(i, False)
        fill = float(st[f"m{i}"] if skewed else st[f"mean{i}"])
        df = df.withColumn(x, F.coalesce(F.col(x).cast("double"), F.lit(fill)))
        entry(x, "other", nulls[x], f"filled with {'median' if skewed else 'mean'}", fixed=nulls[x],
              filled=nulls[x], value=round(fill, 4))
    return df, log


def prepare_sales(df: DataFrame, roles: Roles, treat: bool = True) -> tuple[DataFrame, Roles]:
    """Normalise percents once, derive profit, repair gaps.  Idempotent:
    running it on its own output changes nothing (2.13 #1)."""
    if any("prepared" in n for n in roles.notes):
        return df, roles
    factors, nulls = profile_for_prepare(df, roles)
    df = normalize_percents(_coerce_numeric_roles(df, roles), roles, factors)
    df, roles = derive_profit(df, roles)
    if treat:
        df, log = treat_missing(df, roles, nulls)
    else:
        log = []
    return df, roles.with_roles(notes=roles.notes + ("prepared",) + tuple(f"treated:{e['column']}" for e in log))


def treatment_log(spark, df: DataFrame, roles: Roles) -> DataFrame:
    """I10 as a DataFrame (one row per treated column), from the same steps as prepare_sales."""
    factors, nulls = profile_for_prepare(df, roles)
    x = normalize_percents(_coerce_numeric_roles(df, roles), roles, factors)
    x, r2 = derive_profit(x, roles)
    _, log = treat_missing(x, r2, nulls)
    schema = ("column string, role string, missing_before long, treatment string, values_fixed long, "
              "values_derived long, values_filled long, values_excluded long, values_still_missing long, method_value double, impact string")
    keys = ("column", "role", "missing_before", "treatment", "values_fixed", "values_derived", "values_filled",
            "values_excluded", "values_still_missing", "method_value", "impact")
    # one row per treated column: bounded by the number of columns, never by the data
    return spark.createDataFrame([tuple(float(e[k]) if k == "method_value" and e[k] is not None else e[k] for k in keys)
                                  for e in log], schema)
