"""Composite outputs.

Each composite is a union of small top-k DataFrames computed by the operators
above (bounded row counts), so the composite is still one lazy Spark plan.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import bi_discount_band as bi_band, cents, month_key, msum, profit_margin, round_doubles
from ledgerlens.operators import customer as CU
from ledgerlens.operators import portfolio as PF
from ledgerlens.operators import profit as PR
from ledgerlens.operators.filters import entity_filter_lenient
from ledgerlens.operators.grouped import PERF_COLUMNS
from ledgerlens.roles import Roles
from ledgerlens.session import materialise

# --- fixed values --------------------------------------------------------
BI_BAND_ORDER = ("0%", "0-10%", "10-20%", "20-30%", "30-40%", "40%+", "Unknown")
MAX_INSIGHTS = 10
DRIVER_DIMS = ("region", "segment", "customer", "category", "subcategory")
MAX_DRIVERS = 4
EXPLAINED_GROUPS = 5
DIM_LABELS = {"category": "Category", "subcategory": "Sub-Category", "product": "Product", "region": "Region",
              "segment": "Segment", "customer": "Customer", "state": "State"}
# ------------------------------------------------------------------------


def bi_summary(df: DataFrame, roles: Roles) -> DataFrame:
    """Totals, distinct orders, AOV, margin, loss amount/rows, loss rows per distinct order,
    average discount, records, and the latest month's deltas vs the previous month."""
    g = lambda r: roles.present(r, df.columns)
    s, p, q, d, o, dt = (F.col(g(r)) if g(r) else F.lit(0.0) for r in ("sales", "profit", "quantity", "discount", "order_id", "date"))
    base = df.agg(msum(s).alias("total_sales"), msum(p).alias("total_profit"), msum(s - p).alias("total_cost"),
                  F.sum(q).alias("total_quantity"),
                  # without an order id every row is an order
                  (F.count_distinct(o.cast("string")) if g("order_id") else F.count(F.lit(1))).alias("total_orders"),
                  msum(F.when(p < 0, p).otherwise(0.0)).alias("loss_amount"), F.sum((p < 0).cast("long")).alias("loss_orders"),
                  F.avg(d).alias("average_discount"), F.count(F.lit(1)).alias("record_count"))
    base = base.withColumn("average_order_value", F.when(F.col("total_orders") > 0, cents(F.col("total_sales")) / F.col("total_orders")).otherwise(0.0)) \
               .withColumn("profit_margin_percent", profit_margin("total_profit", "total_sales")) \
               .withColumn("loss_order_percent", F.when(F.col("total_orders") > 0, F.col("loss_orders") / F.col("total_orders") * 100).otherwise(0.0))
    ym = F.coalesce(month_key(dt), F.lit("Unknown"))
    tr = df.groupBy(ym.alias("ym")).agg(msum(s).alias("s"), msum(p).alias("p"))
    last2 = tr.orderBy(F.col("ym").desc()).limit(2)
    w = Window.orderBy("ym")
    d2 = last2.withColumn("ps", F.lag("s").over(w)).withColumn("pp", F.lag("p").over(w))
    latest = d2.where(F.col("ps").isNotNull() & (F.col("ym") != "Unknown")).select(
        F.col("ym").alias("latest_period"), (F.col("s") - F.col("ps")).alias("sales_delta_vs_prev"),
        (F.col("p") - F.col("pp")).alias("profit_delta_vs_prev"))
    latest1 = latest.agg(F.first("latest_period").alias("latest_period"), F.first("sales_delta_vs_prev").alias("sales_delta_vs_prev"),
                         F.first("profit_delta_vs_prev").alias("profit_delta_vs_prev"))   # one row even when empty
    return base.crossJoin(latest1)


def bi_discount_band(df: DataFrame, roles: Roles) -> DataFrame:
    """BI band table in the fixed band order (NULL discount -> 'Unknown')."""
    g = lambda r: roles.present(r, df.columns)
    s, p, d, o = F.col(g("sales")), F.col(g("profit")), F.col(g("discount")), F.col(g("order_id"))
    t = df.groupBy(bi_band(d).alias("discount_band")).agg(
        msum(s).alias("sales"), msum(p).alias("profit"), F.count_distinct(o.cast("string")).alias("orders"),
        F.avg(d).alias("average_discount"), msum(F.when(p < 0, p).otherwise(0.0)).alias("loss_amount"))
    order = F.lit(999)
    for i, b in reversed(list(enumerate(BI_BAND_ORDER))):
        order = F.when(F.col("discount_band") == b, F.lit(i)).otherwise(order)
    return t.withColumn("band_order", order).withColumn("margin_percent", profit_margin("profit", "sales")).orderBy("band_order")


def loss_group_drivers(df: DataFrame, roles: Roles, dim: str = "state", n: int = 10) -> DataFrame:
    """The ``n`` worst loss groups; the first five explained by up to four drivers, checked in order:
    the loss itself, margin more than 5 points under overall, discount >= 20 and above overall,
    negative profit per unit, cost >= 85 % of sales, returns (negative sales/quantity) present,
    and the loss concentrated in the worst value of the first other dimension with a loss."""
    g = lambda r: roles.present(r, df.columns)
    c, s, p, d, q = g(dim), g("sales"), g("profit"), g("discount"), g("quantity")
    t = df.groupBy(F.col(c).alias("dimension_value")).agg(
        msum(s).alias("sales"), msum(p).alias("profit"), F.avg(d).alias("average_discount"), F.sum(q).alias("quantity"),
        F.max(((F.col(s) < 0) | (F.col(q) < 0)).cast("int")).alias("_returns"))
    t = t.withColumn("profit_margin_percent", profit_margin("profit", "sales")).where(F.col("profit") < 0)
    overall = df.agg(profit_margin(msum(p), msum(s)).alias("_om"), F.avg(d).alias("_od"))
    w = Window.orderBy("profit", "dimension_value")
    top = t.orderBy("profit", "dimension_value").limit(n).withColumn("rank", F.row_number().over(w)).crossJoin(F.broadcast(overall))
    # concentration: for each loss group, worst value of the first other dimension (in DRIVER_DIMS order) with a loss
    others = [x for x in DRIVER_DIMS if x != dim and g(x)]
    parts = []
    for i, x in enumerate(others):
        parts.append(df.groupBy(F.col(c).alias("dimension_value"), F.col(g(x)).cast("string").alias("_v"))
                     .agg(msum(p).alias("_p")).where(F.col("_p") < 0).withColumn("_d", F.lit(x)).withColumn("_o", F.lit(i)))
    conc = None
    if parts:
        u = parts[0]
        for x in parts[1:]:
            u = u.unionByName(x)
        u = u.join(top.select("dimension_value"), "dimension_value", "left_semi")
        wc = Window.partitionBy("dimension_value").orderBy("_o", "_p", "_v")
        conc = u.withColumn("_rn", F.row_number().over(wc)).where(F.col("_rn") == 1) \
                .select("dimension_value", F.concat(F.lit("loss concentrated in "), F.col("_d"), F.lit(" "), F.col("_v")).alias("_conc"))
        top = top.join(conc, "dimension_value", "left")
    else:
        top = top.withColumn("_conc", F.lit(None).cast("string"))
    checks = [F.when(F.col("profit") < 0, F.lit("loss-making")),
              F.when(F.col("profit_margin_percent") < F.col("_om") - 5, F.lit("margin well below overall")),
              F.when((F.col("average_discount") >= 20) & (F.col("average_discount") > F.col("_od")), F.lit("high discount")),
              F.when(F.col("profit") / F.col("quantity") < 0, F.lit("negative profit per unit")),
              F.when(F.col("sales") != 0, F.when((F.col("sales") - F.col("profit")) / F.col("sales") >= 0.85, F.lit("cost at least 85% of sales"))),
              F.when(F.col("_returns") == 1, F.lit("returns present")), F.col("_conc")]
    drivers = F.slice(F.filter(F.array(*checks), lambda x: x.isNotNull()), 1, MAX_DRIVERS)
    return top.withColumn("drivers", F.when(F.col("rank") <= EXPLAINED_GROUPS, F.array_join(drivers, "; "))) \
              .select("rank", "dimension_value", "sales", "profit", "profit_margin_percent", "average_discount", "drivers").orderBy("rank")


class Shared:
    """Tables that several composites read: each is computed at most once and written to the shared folder."""

    def __init__(self, df: DataFrame, roles: Roles):
        self.df, self.roles = df, roles

    @cached_property
    def points(self) -> DataFrame:
        return materialise(PR.leakage_points(self.df, self.roles), "leakage")

    @cached_property
    def top(self) -> DataFrame:
        return materialise(PR.top_leakage(self.df, self.roles, self.points), "top-leakage")

    @cached_property
    def drivers(self) -> DataFrame:
        return materialise(PR.leakage_drivers(self.df, self.roles, self.top), "drivers")

    @cached_property
    def portfolio(self) -> DataFrame:
        return materialise(PF.product_portfolio(self.df, self.roles), "portfolio")

    @cached_property
    def segments(self) -> DataFrame:
        return materialise(CU.customer_segments(self.df, self.roles), "segments")


def hidden_insights(df: DataFrame, roles: Roles, shared: Shared | None = None) -> DataFrame:
    """Three worst leakage points, worst problem product, worst unprofitable customer,
    weakest region -- de-duplicated by title, at most 10."""
    shared = shared or Shared(df, roles)
    lk = shared.points.orderBy("profit", "dimension", "dimension_value").limit(3)
    label = F.lit(None).cast("string")
    for k, v in DIM_LABELS.items():
        label = F.when(F.col("dimension") == k, F.lit(v)).otherwise(label)
    a = lk.select(F.concat(F.lit("Profit leakage: "), label, F.lit(" = "), F.col("dimension_value")).alias("title"),
                  F.when(F.col("profit") < 0, "High").otherwise("Medium").alias("severity"), F.lit("Profit").alias("business_area"),
                  "sales", "profit", "profit_margin_percent", F.lit(0).alias("_area"),
                  F.row_number().over(Window.orderBy("profit", "dimension", "dimension_value")).alias("_pos"))
    prob = shared.portfolio.where(F.col("portfolio_class") == "Problem Products").orderBy("profit", "dimension_value").limit(1)
    b = prob.select(F.concat(F.lit("Problem product: "), F.col("dimension_value")).alias("title"), F.lit("High").alias("severity"),
                    F.lit("Product").alias("business_area"), "sales", "profit", "profit_margin_percent", F.lit(1).alias("_area"), F.lit(1).alias("_pos"))
    unp = shared.segments.where(F.col("customer_segment").isin(*CU.SEGMENT_LABELS[:2])).orderBy("total_profit", "customer").limit(1)
    c = unp.select(F.concat(F.lit("Unprofitable customer risk: "), F.col("customer").cast("string")).alias("title"), F.lit("Medium").alias("severity"),
                   F.lit("Customer").alias("business_area"), F.col("total_sales").alias("sales"), F.col("total_profit").alias("profit"),
                   "profit_margin_percent", F.lit(2).alias("_area"), F.lit(1).alias("_pos"))
    reg = PF.weak_regions(df, roles).limit(1)
    d = reg.select(F.concat(F.lit("Weak region: "), F.col("dimension_value")).alias("title"), F.lit("Medium").alias("severity"),
                   F.lit("Region").alias("business_area"), "sales", "profit", "profit_margin_percent", F.lit(3).alias("_area"), F.lit(1).alias("_pos"))
    first = Window.partitionBy("title").orderBy("_area", "_pos")
    u = a.unionByName(b).unionByName(c).unionByName(d).withColumn("_turn", F.row_number().over(first)).where(F.col("_turn") == 1).drop("_turn")
    w = Window.orderBy("_area", "_pos", "title")
    return u.withColumn("position", F.row_number().over(w)).where(F.col("position") <= MAX_INSIGHTS).drop("_area", "_pos").orderBy("position")


def recommendations(df: DataFrame, roles: Roles, shared: Shared | None = None) -> DataFrame:
    """Prioritised actions from leakage, drivers, products, customers and regions."""
    shared = shared or Shared(df, roles)
    r1 = shared.top.select(F.lit("High").alias("priority"), F.lit("Profit").alias("area"),
                    F.concat(F.lit("Fix profit leakage in "), F.col("dimension"), F.lit(" "), F.col("dimension_value")).alias("action"),
                    F.col("profit").alias("impact"), F.lit(1).alias("_o"))
    dr = shared.drivers
    r2 = dr.select(F.lit("Medium").alias("priority"), F.lit("Profit").alias("area"),
                   F.concat(F.lit("Inside "), F.col("context_value"), F.lit(": review "), F.col("driver_dimension"), F.lit(" "),
                            F.col("driver_value")).alias("action"), F.col("profit").alias("impact"), F.lit(2).alias("_o"))
    pp = shared.portfolio.where(F.col("portfolio_class") == "Problem Products").agg(
        F.count(F.lit(1)).alias("n"), msum("profit").alias("loss")).where(F.col("n") > 0)
    r3 = pp.select(F.lit("High").alias("priority"), F.lit("Product").alias("area"),
                   F.concat(F.lit("Reprice or retire "), F.col("n").cast("string"), F.lit(" problem products")).alias("action"),
                   F.col("loss").alias("impact"), F.lit(3).alias("_o"))
    cs = shared.segments.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("n"), msum("total_profit").alias("p")) \
            .where(F.col("customer_segment").isin("Unprofitable Customer", "At-Risk Loyal Customer"))
    r4 = cs.select(F.lit("Medium").alias("priority"), F.lit("Customer").alias("area"),
                   F.concat(F.lit("Act on "), F.col("n").cast("string"), F.lit(" "), F.lower("customer_segment"), F.lit("s")).alias("action"),
                   F.col("p").alias("impact"), F.when(F.col("customer_segment") == "Unprofitable Customer", 4).otherwise(5).alias("_o"))
    wr = PF.weak_regions(df, roles).limit(1)
    r5 = wr.select(F.when(F.col("profit") < 0, "Medium").otherwise("Low").alias("priority"), F.lit("Region").alias("area"),
                   F.concat(F.lit("Audit discounts and mix in "), F.col("dimension_value")).alias("action"),
                   F.col("profit").alias("impact"), F.lit(6).alias("_o"))
    u = r1.unionByName(r2).unionByName(r3).unionByName(r4).unionByName(r5)
    prio = F.when(F.col("priority") == "High", 0).when(F.col("priority") == "Medium", 1).otherwise(2)
    w = Window.orderBy(prio, "_o", "action")
    return u.withColumn("position", F.row_number().over(w)).drop("_o").orderBy("position")


def executive_summary(df: DataFrame, roles: Roles, shared: Shared | None = None) -> DataFrame:
    """One row of computed facts: performance, problem, cause, impact, action."""
    shared = shared or Shared(df, roles)
    s, p = roles.present("sales", df.columns), roles.present("profit", df.columns)
    base = df.agg(msum(s).alias("total_sales"), msum(p).alias("total_profit"),
                  msum(F.when(F.col(p) < 0, F.col(p))).alias("loss_amount"))
    base = base.withColumn("profit_margin_percent", profit_margin("total_profit", "total_sales"))
    top = shared.top.agg(F.first("dimension").alias("problem_dimension"), F.first("dimension_value").alias("problem_value"),
                                        F.first("profit").alias("problem_profit"))
    cause = shared.drivers.limit(1).agg(F.first("driver_dimension").alias("cause_dimension"),
                                                       F.first("driver_value").alias("cause_value"))
    out = base.crossJoin(top).crossJoin(cause)
    return out.withColumn("performance", F.format_string("Sales %.2f, profit %.2f, margin %.2f%%", "total_sales", "total_profit", "profit_margin_percent")) \
              .withColumn("action", F.when(F.col("problem_value").isNotNull(),
                                           F.concat(F.lit("Fix "), F.col("problem_dimension"), F.lit(" "), F.col("problem_value"), F.lit(" first"))))


def headline_flags(df: DataFrame, roles: Roles) -> DataFrame:
    """Cleaned-data, unresolved rows, negative company profit, losses present, table sizes."""
    s, p = roles.present("sales", df.columns), roles.present("profit", df.columns)
    prod, cust = roles.present("product", df.columns), roles.present("customer", df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(s).isNull().cast("long")).alias("unresolved_sales_rows"),
                  F.sum(F.col(p).isNull().cast("long")).alias("unresolved_profit_rows"), msum(p).alias("_tp"),
                  F.sum((F.col(p) < 0).cast("long")).alias("loss_rows"), F.count_distinct(prod).alias("products"),
                  F.count_distinct(cust).alias("customers")) \
             .select("rows", F.lit(any(n.startswith("treated:") for n in roles.notes)).alias("cleaned_data_used"),
                     "unresolved_sales_rows", "unresolved_profit_rows", (F.col("_tp") < 0).alias("negative_company_profit"),
                     (F.col("loss_rows") > 0).alias("losses_present"), "loss_rows", "products", "customers")


def entity_root_causes(df: DataFrame, roles: Roles, entities: list[tuple[str, str]]) -> DataFrame:
    """E34 for all entities (column, value) at once: rows are keyed to the entities they belong to by one lookup in the
    list that was asked for, and one aggregate makes a row for each entity that has any."""
    by_column = {c: r for r, c in roles.as_dict().items()}
    asked = [(by_column[c], c, v) for c, v in entities if c in df.columns and c in by_column]
    columns = dict.fromkeys(c for _, c, _ in asked)
    s, p, d = (roles.present(r, df.columns) for r in ("sales", "profit", "discount"))
    schema = "target_dimension string, _column string, target_value string"
    wanted = df.sparkSession.createDataFrame(asked, schema).distinct().withColumn("_key", F.lower("target_value"))
    cells = F.array(*[F.struct(F.lit(c).alias("_column"), F.lower(F.col(c).cast("string")).alias("_key")) for c in columns]) if columns \
        else F.array().cast("array<struct<_column:string,_key:string>>")
    keyed = df.select(F.col(s).alias("_s"), F.col(p).alias("_p"), F.col(d).alias("_d"), F.explode(cells).alias("_e")).select("_s", "_p", "_d", "_e.*")
    out = (keyed.join(F.broadcast(wanted), ["_column", "_key"])   # as long as the caller's list
           .groupBy("target_dimension", "target_value")
           .agg(msum("_s").alias("sales"), msum("_p").alias("profit"), F.coalesce(msum(F.when(F.col("_p") < 0, F.col("_p"))), F.lit(0.0)).alias("loss_amount"),
                F.count(F.lit(1)).alias("order_count"), F.avg("_d").alias("average_discount")))
    return (out.withColumn("margin", F.when(F.col("sales") != 0, profit_margin("profit", "sales")))
            .withColumn("loss_making", F.col("profit") < 0).withColumn("discount_pressure", F.col("average_discount") > 20))


class Bundle(Mapping):
    """Tables by name, each computed when it is first asked for."""

    def __init__(self, makers: dict):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


#: Areas that an analyst's question may touch.
AREAS = ("profit", "customer", "product", "region", "time", "hidden")
LOSS_DIMS = ("category", "subcategory", "product", "region", "segment", "customer", "discount_band")


def analyst_bundle(df: DataFrame, roles: Roles, entities: list[tuple[str, str]] | None = None, areas: tuple[str, ...] = AREAS) -> Bundle:
    """J40 (computation part): the tables an analyst answer draws on, over the rows of the named entities (values that
    match nothing, or nothing together, are skipped), and what stands behind each entity's result.  ``areas`` chooses the
    groups of tables; a table is only computed when it is asked for."""
    from ledgerlens.operators import anomaly, forecast, kpis, trend
    whole, entities = df, entities or []
    df = entity_filter_lenient(df, entities)
    sh = Shared(df, roles)
    has = lambda d: d == "discount_band" or roles.present(d, df.columns)
    perf = lambda t: t.select(*PERF_COLUMNS)
    by_area = {
        "profit": {"profit_summary": lambda: PR.profit_summary(df, roles, sh.top), "leakage_points": lambda: sh.points,
                   **{f"loss_by_{d}": (lambda d=d: perf(PR.loss_by(df, roles, d))) for d in LOSS_DIMS if has(d)},
                   "relationship_summary": lambda: PR.relationship_summary(df, roles), "loss_concentration": lambda: perf(PR.loss_concentration(df, roles)),
                   "monthly_profit": lambda: PR.monthly_profit(df, roles), "metric_drop": lambda: trend.metric_drop(df, roles)},
        "customer": {"customer_loyalty": lambda: CU.customer_loyalty(df, roles)},
        "product": {"product_portfolio": lambda: sh.portfolio.select(*PERF_COLUMNS, "portfolio_class")},
        "region": {"weak_regions": lambda: PF.weak_regions(df, roles)},
        "time": {"performance_over_time_month": lambda: trend.performance_over_time(df, roles, "M"), "forecast": lambda: forecast.forecast(df, roles),
                 "anomaly_outliers": lambda: anomaly.metric_outliers(df, roles), "anomaly_periods": lambda: anomaly.period_anomalies(df, roles),
                 "anomaly_low_margin": lambda: anomaly.high_sales_low_margin(df, roles)},
        "hidden": {"hidden_insights": lambda: hidden_insights(df, roles, sh)},
    }
    makers = {"kpis": lambda: kpis.kpis(df, roles)}
    for area in areas:
        makers |= by_area[area]
    if entities:
        makers["entity_root_causes"] = lambda: entity_root_causes(whole, roles, entities)
    makers["recommendations"] = lambda: recommendations(df, roles, sh)
    makers["executive_summary"] = lambda: executive_summary(df, roles, sh)
    return Bundle(makers)


def cell_text(c: Column) -> Column:
    """A cell as text that any engine can make: numbers (also in text) as whole ten-thousandths, NULL as the empty text."""
    number = c.cast("string").try_cast("double")
    return F.coalesce(F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e14), F.floor(number * 10000 + 0.5).cast("long").cast("string")).otherwise(c.cast("string")), F.lit(""))


def table_digest(name: str, table: DataFrame) -> DataFrame:
    """One row: the table's name, rows, and the sum of a 52-bit hash of every whole row (order doesn't matter)."""
    cells = [F.concat(F.lit(f"{c}="), cell_text(F.col(f"`{c}`"))) for c in sorted(table.columns)]
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *cells).cast("binary")), 1, 13), 16, 10).cast("decimal(38,0)")
    return (round_doubles(table).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))
            .select(F.lit(name).alias("table"), "rows", "digest"))


def bundle_digest(bundle: Mapping, names: list[str]) -> DataFrame:
    # one row a table, written table by table: a single plan over all of them would be planned anew after each of its stages
    parts = [materialise(table_digest(n, bundle[n]), f"digest-{n}") for n in names]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u
