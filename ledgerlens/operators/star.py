"""Star schema and measures (K1-K5).

Surrogate keys are ``PREFIX-<code>`` where code is the 0-based position of the
attribute string in sorted order (F7), computed with the distributed prefix
count, so no key table is built on the driver.  Fact-to-dimension joins are
plain equi-joins on key tables that are written one by one, so Spark knows each
one's size: a small one is broadcast, and the fact is shuffled only for those
above the threshold.  A fact gets only the keys that its reader asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import bi_discount_band, cents, date_key, msum, profit_margin, safe_text
from ledgerlens.operators.digests import numbered
from ledgerlens.operators.windows import row_number_global
from ledgerlens.roles import Roles
from ledgerlens.session import in_slice, materialise, slice_count

# --- fixed values --------------------------------------------------------
VALUE_SEGMENTS = ((0.50, "Core"), (0.80, "High Value"), (1.00, "Strategic"))
HIGH_DISCOUNT_BANDS = ("30-40%", "40%+")
PROBLEM_MARGIN = 0.05
# ------------------------------------------------------------------------


def _raw_key(df: DataFrame, cols: list[str | None]) -> F.Column:
    avail = [c for c in cols if c and c in df.columns]
    if not avail:
        return F.lit(None).cast("string")
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in avail])


def _key_roles(df: DataFrame, roles: Roles) -> dict[str, list]:
    g = lambda r: roles.present(r, df.columns)
    return {"customer": [g("customer") or g("customer_id")], "product": [g("product"), g("category"), g("subcategory")],
            "geography": [g("country"), g("state"), g("city"), g("region")], "segment": [g("segment")]}


_PREFIX = {"customer": "CUST", "product": "PROD", "geography": "GEO", "segment": "SEG"}
_WIDTH = ("segment", "geography", "customer", "product")   # from the fewest keys to the most, as a rule


def _raw_keys(df: DataFrame, roles: Roles) -> dict[str, F.Column]:
    return {n: _raw_key(df, cols) for n, cols in _key_roles(df, roles).items() if [c for c in cols if c]}


def key_tables(df: DataFrame, roles: Roles, names: tuple[str, ...] = tuple(_PREFIX)) -> dict[str, DataFrame]:
    """(_raw, _code) by key name: the codes of the surrogate keys, built once and written to the shared folder.

    All key tables are coded in ONE pass: the distinct (key name, raw key)
    pairs are numbered in the total order (key name, raw key), and each key
    name's starting position (a four-row table) is subtracted."""
    specs = {n: raw for n, raw in _raw_keys(df, roles).items() if n in names}
    cells = [F.struct(F.lit(n).alias("_kn"), raw.alias("_raw")) for n, raw in specs.items()]
    if not cells:
        return {}
    pairs = df.select(F.explode(F.array(*cells)).alias("_p")).select("_p.*").where(F.col("_raw").isNotNull()).distinct()
    ranked = row_number_global(pairs, [F.col("_kn").asc(), F.col("_raw").asc()], "_pos")
    starts = ranked.groupBy("_kn").agg(F.min("_pos").alias("_start"))
    coded = ranked.join(F.broadcast(starts), "_kn").select("_kn", "_raw", (F.col("_pos") - F.col("_start")).alias("_code"))
    return {n: materialise(coded.where(F.col("_kn") == n).select("_raw", "_code"), f"star-keys-{n}") for n in specs}


def with_keys(df: DataFrame, roles: Roles, names: tuple[str, ...] = tuple(_PREFIX), keys: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add surrogate keys to every row; ``keys`` are the tables of the whole fact (built here when not given)."""
    raw = _raw_keys(df, roles)
    specs = {n: raw[n] for n in _WIDTH if n in raw and n in names}   # the rows are widened by what stays in place first
    keys = key_tables(df, roles, names) if keys is None else keys
    out = df.select("*", *[raw.alias(f"_raw_{name}") for name, raw in specs.items()],
                    *[F.lit(f"{_PREFIX[n]}-Unknown").alias(f"{n}_key") for n in names if n not in specs])
    for name in specs:
        c = keys[name].select(F.col("_raw").alias(f"_raw_{name}"), F.col("_code").alias(f"_code_{name}"))
        out = out.join(c, f"_raw_{name}", "left") \
                 .withColumn(f"{name}_key", F.concat(F.lit(_PREFIX[name] + "-"), F.col(f"_code_{name}").cast("string"))) \
                 .drop(f"_raw_{name}", f"_code_{name}")
    return out


def fact_slices(df: DataFrame, roles: Roles, n: int | None = None, keys: dict[str, DataFrame] | None = None) -> list[DataFrame]:
    """K1 in ``n`` slices (by the size of ``df`` when not given), to be written one after another: each joins the rows of its
    share of the key with the most values to their keys, so no more than that share is shuffled at a time."""
    keys = key_tables(df, roles) if keys is None else keys
    n = slice_count(df) if n is None else n
    base, raw = numbered(df, "row_id"), _raw_keys(df, roles)
    last = next((x for x in reversed(_WIDTH) if x in raw), None)
    if n == 1 or last is None:
        return [fact_sales(df, roles, keys=keys, base=base)]
    some = lambda i: keys | {last: keys[last].where(in_slice(F.col("_raw"), i, n))}
    return [fact_sales(df, roles, keys=some(i), base=base.where(in_slice(raw[last], i, n))) for i in range(n)]


def fact_table(df: DataFrame, roles: Roles) -> DataFrame:
    """K1; the fact of a large table is written slice by slice."""
    slices = fact_slices(df, roles)
    return slices[0] if len(slices) == 1 else materialise(slices, "fact-sales")


def fact_sales(df: DataFrame, roles: Roles, row_id: bool = True, keys: dict[str, DataFrame] | None = None, names: tuple[str, ...] = tuple(_PREFIX),
               base: DataFrame | None = None) -> DataFrame:
    """K1: one row per input row with keys, measures, margin, loss flag/amount and band.
    ``row_id`` (the row's digest and its number among equal rows) is only computed when asked for, as are keys but those of ``names``.
    ``base``: the rows with their ``row_id`` if at hand."""
    g = lambda r: roles.present(r, df.columns)
    num = lambda r: F.col(g(r)).cast("double") if g(r) else F.lit(0.0)
    if base is None:
        base = numbered(df, "row_id") if row_id else df.withColumn("row_id", F.lit(None).cast("string"))
    k = with_keys(base, roles, names, key_tables(df, roles, names) if keys is None else keys)
    s, p = num("sales"), num("profit")
    cost = num("cost") if g("cost") else s - p
    return k.select(
        "row_id",
        (safe_text(F.col(g("order_id"))) if g("order_id") else F.concat(F.lit("ORD-"), F.col("row_id").cast("string"))).alias("order_key"),
        (date_key(F.col(g("date"))) if g("date") else F.lit("Unknown")).alias("order_date_key"),
        (date_key(F.col(g("ship_date"))) if g("ship_date") else F.lit("Unknown")).alias("ship_date_key"),
        *[f"{n}_key" for n in _PREFIX if n in names],
        s.alias("sales"), p.alias("profit"), cost.alias("cost"), num("quantity").alias("quantity"), num("discount").alias("discount"),
        bi_discount_band(num("discount") if g("discount") else F.lit(0.0)).alias("discount_band"),
        profit_margin(p, s).alias("profit_margin_percent"), F.coalesce(p < 0, F.lit(False)).alias("is_loss_order"),
        F.when(p < 0, p).otherwise(F.lit(0.0)).alias("loss_amount"))


def _dimension(df: DataFrame, roles: Roles, name: str, attrs: list[tuple[str, str]], keys: dict[str, DataFrame] | None = None) -> DataFrame:
    """Distinct attributes first, then their keys: the fact is not joined."""
    own = list(dict.fromkeys(c for c in [*_key_roles(df, roles)[name], *(c for c, _ in attrs)] if c))
    k = with_keys(df.select(*own).distinct(), roles, (name,), keys)
    return k.select(f"{name}_key", *[safe_text(F.col(c)).alias(a) for c, a in attrs if c]).distinct().orderBy(f"{name}_key")


def dim_product(df: DataFrame, roles: Roles, keys: dict[str, DataFrame] | None = None) -> DataFrame:
    g = lambda r: roles.present(r, df.columns)
    return _dimension(df, roles, "product", [(g("product"), "product_name"), (g("category"), "category"), (g("subcategory"), "subcategory")], keys)


def dim_geography(df: DataFrame, roles: Roles, keys: dict[str, DataFrame] | None = None) -> DataFrame:
    g = lambda r: roles.present(r, df.columns)
    return _dimension(df, roles, "geography", [(g(r), r) for r in ("country", "state", "city", "region")], keys)


def dim_segment(df: DataFrame, roles: Roles, keys: dict[str, DataFrame] | None = None) -> DataFrame:
    seg = roles.present("segment", df.columns)
    if not seg:
        return df.select(F.lit("SEG-Unknown").alias("segment_key"), F.lit("All Segments").alias("segment")).distinct()
    return _dimension(df, roles, "segment", [(seg, "segment")], keys)


def dim_customer(df: DataFrame, roles: Roles, keys: dict[str, DataFrame] | None = None) -> DataFrame:
    """K2: customers with totals and the value segment (percent rank, first ties).  Totals are taken by customer, so
    the fact gets no keys."""
    g = lambda r: roles.present(r, df.columns)
    cust = g("customer") or g("customer_id")
    num = lambda r: F.col(g(r)).cast("double") if g(r) else F.lit(0.0)
    order = safe_text(F.col(g("order_id"))) if g("order_id") else F.lit(None).cast("string")
    m = df.groupBy(cust).agg(msum(num("sales")).alias("total_sales"), msum(num("profit")).alias("total_profit"),
                             (F.count_distinct(order) if g("order_id") else F.count(F.lit(1))).alias("order_count"))
    d = with_keys(m, roles, ("customer",), keys).select("customer_key", safe_text(F.col(cust)).alias("customer"), "total_sales", "total_profit", "order_count")
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_number_global(d, [F.col("total_sales").asc_nulls_first(), F.col("customer_key").asc()], "_rn")
    pct = F.col("_rn") / F.col("_n")
    seg = F.when(F.col("_n") <= 1, F.lit("Strategic"))
    for hi, label in VALUE_SEGMENTS:
        seg = seg.when(pct <= hi, F.lit(label))
    return ranked.crossJoin(F.broadcast(n)).withColumn("customer_value_segment", seg).drop("_rn", "_n").orderBy("customer_key")


def dim_date(df: DataFrame, roles: Roles) -> DataFrame:
    """K3: distinct order and ship dates with calendar attributes (not a dense calendar)."""
    cols = [c for c in (roles.present("date", df.columns), roles.present("ship_date", df.columns)) if c]
    u = None
    for c in cols:
        part = df.select(F.to_date(F.col(c)).alias("d"))
        u = part if u is None else u.unionByName(part)
    d = u.where(F.col("d").isNotNull()).distinct()
    return d.select(F.date_format("d", "yyyyMMdd").alias("date_key"), F.date_format("d", "yyyy-MM-dd").alias("date"),
                    F.year("d").alias("year"), F.concat(F.lit("Q"), F.quarter("d").cast("string")).alias("quarter"),
                    F.month("d").alias("month_number"), F.date_format("d", "MMMM").alias("month_name"),
                    F.date_format("d", "yyyy-MM").alias("year_month"), F.date_format("d", "EEEE").alias("weekday")) \
            .orderBy("date_key")


def _tables(df: DataFrame, roles: Roles, fact) -> dict:
    """Makers of the six tables, with the codes of the keys built once; ``fact(keys)`` makes the fact."""
    keys = key_tables(df, roles)
    return {"fact_sales": lambda: fact(keys), "dim_date": lambda: dim_date(df, roles), "dim_customer": lambda: dim_customer(df, roles, keys),
            "dim_product": lambda: dim_product(df, roles, keys), "dim_geography": lambda: dim_geography(df, roles, keys),
            "dim_segment": lambda: dim_segment(df, roles, keys)}


def star_schema(df: DataFrame, roles: Roles) -> dict[str, DataFrame]:
    return {name: make() for name, make in _tables(df, roles, lambda keys: fact_sales(df, roles, keys=keys)).items()}


def star_slices(df: DataFrame, roles: Roles, *only: str) -> dict[str, list[DataFrame]]:
    """The tables (or ``only`` these) as slices to be written one after another."""
    made = {name: make() for name, make in _tables(df, roles, lambda keys: fact_slices(df, roles, keys=keys)).items() if not only or name in only}
    return {name: [t] if isinstance(t, DataFrame) else t for name, t in made.items()}


def star_summary(df: DataFrame, roles: Roles) -> DataFrame:
    """K4: rows and columns per table."""
    parts = []
    for name, t in star_schema(df, roles).items():
        parts.append(t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows",
                                                                    F.lit(len(t.columns)).alias("columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def measures(df: DataFrame, roles: Roles, by: str) -> DataFrame:
    """K5: the measure catalogue evaluated per dimension attribute.

    ``by`` is ``category``/``subcategory``/``product_name`` (DimProduct), ``region``/``state``
    (DimGeography), ``segment`` (DimSegment) or ``year_month`` (DimDate, adds month-on-month).

    The joined fact is written once with the few columns that measures need; orders and customers are counted from their
    distinct pairs with the attribute, apart from the sums, so no row is copied for each distinct count."""
    own = {"category": "product", "subcategory": "product", "product_name": "product", "segment": "segment", "year_month": None}.get(by, "geography")
    names = tuple(n for n in _PREFIX if n in ("customer", own))
    keys = key_tables(df, roles, names)
    fact = fact_sales(df, roles, row_id=False, keys=keys, names=names)
    if by in ("category", "subcategory", "product_name"):
        j = fact.join(materialise(dim_product(df, roles, keys), "dim"), "product_key", "left")   # written: its size is known
    elif by in ("region", "state", "country", "city"):
        j = fact.join(materialise(dim_geography(df, roles, keys), "dim"), "geography_key", "left")
    elif by == "segment":
        j = fact.join(materialise(dim_segment(df, roles, keys), "dim"), "segment_key", "left")
    elif by == "year_month":
        j = fact.join(materialise(dim_date(df, roles).select(F.col("date_key").alias("order_date_key"), "year_month"), "dim"), "order_date_key", "left")
    else:
        raise ValueError(by)
    j = materialise(j.select(F.col(by), "order_key", "customer_key", "sales", "profit", "cost", "quantity", "discount", "discount_band", "is_loss_order", "loss_amount"), "measures")
    hd = F.col("discount_band").isin(*HIGH_DISCOUNT_BANDS)
    sums = j.groupBy(F.col(by)).agg(
        msum("sales").alias("total_sales"), msum("profit").alias("total_profit"), msum("cost").alias("total_cost"),
        F.sum("quantity").alias("total_quantity"), msum("loss_amount").alias("loss_amount"), F.avg("discount").alias("average_discount"),
        msum(F.when(hd, F.col("sales"))).alias("high_discount_sales"), msum(F.when(hd, F.col("profit"))).alias("high_discount_profit"))
    orders = j.groupBy(F.col(by), "order_key").agg(F.max("is_loss_order").alias("_loss")).groupBy(F.col(by).alias("_by_order")).agg(
        F.count("order_key").alias("total_orders"), F.count(F.when(F.col("_loss"), F.col("order_key"))).alias("loss_orders"))
    customers = j.select(by, "customer_key").distinct().groupBy(F.col(by).alias("_by_customer")).agg(F.count("customer_key").alias("customer_count"))
    g = sums.join(orders, F.col(by).eqNullSafe(F.col("_by_order"))).join(customers, F.col(by).eqNullSafe(F.col("_by_customer"))).drop("_by_order", "_by_customer")
    div = lambda a, b: F.when(b != 0, a / b)  # noqa: E731  (DIVIDE: blank on zero)
    tot = g.agg(msum("total_sales").alias("_s"), msum("total_profit").alias("_p"), F.abs(msum("loss_amount")).alias("_l"))
    g = g.crossJoin(F.broadcast(tot))
    out = g.select(
        by, "total_sales", "total_profit", "total_cost", "total_quantity", "total_orders",
        div(cents(F.col("total_sales")), F.col("total_orders")).alias("average_order_value"),
        div(F.col("total_profit"), F.col("total_sales")).alias("profit_margin"),
        "loss_amount", "loss_orders", div(F.col("loss_orders"), F.col("total_orders")).alias("loss_order_share"),
        "average_discount", div(cents(F.col("total_profit")), F.col("total_orders")).alias("profit_per_order"),
        div(F.col("total_sales"), F.col("_s")).alias("sales_contribution"),
        div(F.col("total_profit"), F.col("_p")).alias("profit_contribution"),
        div(F.abs(F.col("loss_amount")), F.col("_l")).alias("loss_contribution"),
        "high_discount_sales", "high_discount_profit",
        div(F.col("high_discount_profit"), F.col("high_discount_sales")).alias("high_discount_margin"),
        "customer_count", div(cents(F.col("total_sales")), F.col("customer_count")).alias("sales_per_customer"),
        div(cents(F.col("total_profit")), F.col("customer_count")).alias("profit_per_customer"),
        F.when((F.col("total_profit") < 0) | (div(F.col("total_profit"), F.col("total_sales")) < PROBLEM_MARGIN), 1)
         .otherwise(0).alias("problem_flag"))
    if by == "year_month":
        w = Window.orderBy("year_month")
        out = out.withColumn("sales_last_month", F.lag("total_sales").over(w)) \
                 .withColumn("profit_last_month", F.lag("total_profit").over(w)) \
                 .withColumn("sales_mom", div(F.col("total_sales") - F.col("sales_last_month"), F.col("sales_last_month"))) \
                 .withColumn("profit_mom", div(F.col("total_profit") - F.col("profit_last_month"), F.col("profit_last_month")))
    return out.orderBy(by)
