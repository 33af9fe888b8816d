"""Inline fixtures re-asserted on Spark (values the original tests assert)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean, customer, grouped, kpis, profit
from ledgerlens.roles import Roles

CORE_ROLES = Roles(order_id="Order ID", date="Order Date", customer="Customer Name", region="Region",
                   category="Category", subcategory="Sub-Category", product="Product Name", sales="Sales",
                   quantity="Quantity", discount="Discount", profit="Profit")


@pytest.fixture(scope="module")
def core(spark):
    d = lambda s: dt.datetime.fromisoformat(s)
    rows = [("1", d("2024-01-01"), "A", "South", "Furniture", "Tables", "Table X", 1000, 2, 0.4, -300),
            ("2", d("2024-01-03"), "A", "South", "Furniture", "Tables", "Table X", 1200, 2, 0.5, -500),
            ("3", d("2024-02-01"), "A", "North", "Technology", "Phones", "Phone A", 2000, 1, 0.1, 400),
            ("4", d("2024-02-05"), "B", "South", "Furniture", "Tables", "Table Y", 1500, 3, 0.4, -600),
            ("5", d("2024-03-01"), "C", "West", "Office Supplies", "Paper", "Paper A", 200, 4, 0.0, 60),
            ("6", d("2024-03-02"), "C", "West", "Technology", "Copiers", "Copier A", 3000, 1, 0.1, 900),
            ("7", d("2024-03-07"), "D", "South", "Furniture", "Chairs", "Chair A", 700, 1, 0.2, 80),
            ("8", d("2024-03-10"), "D", "East", "Technology", "Phones", "Phone B", 2500, 2, 0.05, 500)]
    df = spark.createDataFrame(rows, "`Order ID` string, `Order Date` timestamp, `Customer Name` string, Region string, "
                                     "Category string, `Sub-Category` string, `Product Name` string, Sales long, "
                                     "Quantity long, Discount double, Profit long")
    return clean.prepare_sales(df, CORE_ROLES)


def test_core_kpis(core):
    df, roles = core
    k = kpis.kpis(df, roles).first()
    assert k["total_sales"] == 12100
    assert k["total_profit"] == 540
    assert k["loss_making_orders_count"] == 3


def test_discount_ratio_normalised_once(core):
    df, roles = core
    assert df.agg(F.max("Discount")).first()[0] == pytest.approx(50.0)
    again, roles2 = clean.prepare_sales(df, roles)
    assert again.agg(F.max("Discount")).first()[0] == pytest.approx(50.0)


def test_customer_loyalty_not_empty(core):
    df, roles = core
    t = customer.customer_loyalty(df, roles)
    assert t.count() == 4
    assert "loyalty_score" in t.columns


def test_top_leakage_is_tables(core):
    df, roles = core
    top = profit.top_leakage(df, roles).first()
    assert top["dimension_value"] in ("Tables", "Furniture")
    assert top["profit"] == -1400


def test_group_sums_equal_totals_and_shares_sum_to_100(core):
    df, roles = core
    g = grouped.performance(df, roles, "category")
    s = g.agg(F.sum("sales"), F.sum("profit"), F.sum("sales_contribution_percent"), F.sum("profit_contribution_percent")).first()
    assert s[0] == 12100 and s[1] == 540
    assert s[2] == pytest.approx(100.0) and s[3] == pytest.approx(100.0)


def test_missing_value_treatment(spark):
    rows = [("2024-01-01", "O1", "A", "Furniture", "Chair", 100.0, 2.0, 50, 60.0, 40.0, None),
            (None, "O2", "B", None, "Table", None, 5.0, 20, 80.0, None, "10%"),
            ("2024-01-03", "O3", None, "Technology", "Phone", 300.0, None, 100, None, 90.0, "0")]
    df = spark.createDataFrame(rows, "`Order Date` string, `Order ID` string, `Customer Name` string, Category string, "
                                     "`Product Name` string, Sales double, Quantity double, `Unit Price` long, Cost double, "
                                     "Profit double, Discount string")
    roles = Roles(date="Order Date", order_id="Order ID", customer="Customer Name", category="Category",
                  product="Product Name", sales="Sales", quantity="Quantity", unit_price="Unit Price", cost="Cost",
                  profit="Profit", discount="Discount")
    out, r2 = clean.prepare_sales(df, roles)
    got = {row["Order ID"]: row for row in out.collect()}
    assert got["O2"]["Sales"] == 100.0
    assert got["O2"]["Profit"] == 20.0
    assert got["O3"]["Quantity"] == 3.0
    assert got["O1"]["Discount"] == 0.0
    assert got["O2"]["Category"] == "Unknown Category"
    assert got["O3"]["Customer Name"] == "Unknown Customer"
    k = kpis.kpis(out, r2).first()
    assert k["total_sales"] == 500.0 and k["total_profit"] == 150.0
    log = clean.treatment_log(spark, df, roles)
    assert log.where(F.col("column") == "Order Date").first()["values_still_missing"] == 1


def test_core_sales_not_mean_filled(spark):
    df = spark.createDataFrame([("2024-01-01", "A", 100.0, 20.0), ("2024-01-02", "B", None, None),
                                ("2024-01-03", "C", 300.0, -50.0)], "Date string, Product string, Sales double, Profit double")
    roles = Roles(date="Date", product="Product", sales="Sales", profit="Profit")
    out, _ = clean.prepare_sales(df, roles)
    row = out.where(F.col("Product") == "B").first()
    assert row["Sales"] is None and row["Profit"] is None


def test_percent_text_discount(spark):
    rows = [("1", "A", 100.0, "40%", -100.0), ("2", "B", 200.0, "0%", 50.0), ("3", "C", 50.0, "40%", -160.0),
            ("4", "D", 10.0, "10%", 0.0)]
    df = spark.createDataFrame(rows, "`Order ID` string, Product string, Sales double, Discount string, Profit double")
    roles = Roles(order_id="Order ID", product="Product", sales="Sales", discount="Discount", profit="Profit")
    out, r2 = clean.prepare_sales(df, roles)
    k = kpis.kpis(out, r2).first()
    assert k["total_profit"] == -210 and k["loss_making_orders_count"] == 2
    assert out.agg(F.max("Discount")).first()[0] == 40.0


def test_shuffle_partitions_do_not_change_answers(spark, core):
    df, roles = core
    before = sorted(grouped.performance(df, roles, "subcategory").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        after = sorted(grouped.performance(df, roles, "subcategory").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert before == after


def test_gaps_in_other_numeric_columns(spark):
    """The mean for an even column, the median for a skewed one, for one with an outlier and for a short one."""
    rows = [(f"o{i}", 100.0 + i, 10.0, float(i % 10) if i % 7 else None, float(2 ** i) if i < 14 and i % 5 else None, 1000.0 if i == 3 else float(i % 4) if i % 6 else None, None, float(i) if i < 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "`Order ID` string, Sales double, Profit double, even double, skewed double, outlier double, hollow double, short double")
    roles = Roles(order_id="Order ID", sales="Sales", profit="Profit")
    out, roles = clean.prepare_sales(df, roles)
    log = {r["column"]: r for r in clean.treatment_log(spark, df, Roles(order_id="Order ID", sales="Sales", profit="Profit")).collect()}
    even = [r[3] for r in rows if r[3] is not None]
    assert log["even"]["treatment"] == "filled with mean" and log["even"]["method_value"] == pytest.approx(sum(even) / len(even), abs=1e-4)
    for c, k in (("skewed", 4), ("outlier", 5), ("short", 7)):
        import statistics
        assert log[c]["treatment"] == "filled with median" and log[c]["method_value"] == pytest.approx(statistics.median(r[k] for r in rows if r[k] is not None), abs=1e-4), c
    assert (log["hollow"]["treatment"], log["hollow"]["values_excluded"], log["hollow"]["values_still_missing"]) == ("left missing", 40, 40)
    left = out.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in ("even", "skewed", "outlier", "hollow", "short")]).first().asDict()
    assert left == {"even": 0, "skewed": 0, "outlier": 0, "hollow": 40, "short": 0}
    assert all(r["impact"] for r in log.values())


def test_aggregate_grain_is_a_limitation(spark):
    from ledgerlens.sources.roles_detect import limitations
    df = spark.createDataFrame([("2024-01", "A", 5.0)], "Month string, Category string, Sales double")
    roles = Roles(date="Month", category="Category", sales="Sales")
    assert "grain" in {r["topic"] for r in limitations(df, roles).collect()}
    core = spark.createDataFrame([("1", "2024-01", 5.0)], "`Order ID` string, Month string, Sales double")
    assert "grain" not in {r["topic"] for r in limitations(core, Roles(order_id="Order ID", date="Month", sales="Sales")).collect()}


def test_profile_names_a_bounded_list(spark):
    df = spark.createDataFrame([(f"c{i:03d}", "r", None, 1.0, 1.0, "o", "x", "2024-01-01") for i in range(120)], "category string, region string, segment string, sales double, profit double, order_id string, customer string, d string")
    r = kpis.dataset_profile(df, Roles(category="category", region="region", segment="segment", sales="sales", profit="profit", order_id="order_id", customer="customer", date="d")).first()
    assert (r["category_values"], len(r["category_list"].split(", ")), r["region_list"], r["segment_values"]) == (120, 50, "r", 0)
