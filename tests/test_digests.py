"""Row digests: duplicates and stable row ids against plain Python."""

import collections

from pyspark.sql import functions as F

from ledgerlens.operators.digests import numbered, row_counts


def test_counts_with_nulls_and_a_hot_row(spark):
    rows = [(1, None, "a"), (1, "a", None), (None, 1.0, None)] and [(1, None, "a", 0.0), (1, "a", None, 0.0), (None, None, None, None), (None, None, None, None), (1, None, "a", -0.0)]
    df = spark.createDataFrame(rows + [(7, "hot", "hot", 1.5)] * 1000, "a int, b string, c string, d double").repartition(7)
    assert row_counts(df).first().asDict() == {"rows": 1005, "duplicate_rows": 1001}
    assert row_counts(df.limit(0)).first().asDict() == {"rows": 0, "duplicate_rows": 0}


def test_ids_are_unique_stable_and_outlive_appends(spark):
    rows = [(i % 40, f"t{i % 40}", i % 40 / 7) for i in range(400)] + [(99, None, None)] * 600
    df = spark.createDataFrame(rows, "a int, b string, c double")
    ids = lambda d: {r["row_id"]: (r.a, r.b, r.c) for r in numbered(d, "row_id").collect()}
    first = ids(df.repartition(5))
    assert len(first) == 1000 and collections.Counter(first.values()) == collections.Counter((a, b, c) for a, b, c in rows)
    assert first == ids(df.repartition(11, F.rand(3)))
    more = ids(df.union(spark.createDataFrame([(99, None, None), (5, "new", 1.0)], df.schema)).repartition(3))
    assert first.items() <= more.items() and len(more) == 1002


def test_no_global_sort(spark):
    df = spark.range(1000).selectExpr("id", "id * 0.5 as x")
    plan = numbered(df, "row_id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_rows_that_are_not_repeated_stay_where_they_are(spark):
    df = spark.range(1000).selectExpr("id", "id * 0.5 as x", "CAST(NULL AS string) AS s")
    assert "Exchange" not in numbered(df, "row_id")._jdf.queryExecution().executedPlan().toString()
    zeros = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (float("inf"), "b"), (float("inf"), "b"), (1.0, None)], "x double, s string").repartition(3)
    assert sorted(r["row_id"].split("-")[1] for r in numbered(zeros, "row_id").collect()) == ["1", "1", "1", "2", "2"]   # one text, one digest


def test_a_fact_gets_the_keys_that_are_asked_for(spark):
    from ledgerlens.operators import star
    from ledgerlens.roles import Roles

    df = spark.createDataFrame([("o1", "A", "p|q", "S", 10.0, 1.0), ("o2", "A", None, None, 5.0, -1.0), ("o2", None, "p", "S", 5.0, 2.0)],
                               "oid string, cust string, prod string, seg string, sales double, profit double")
    roles = Roles(order_id="oid", customer="cust", product="prod", segment="seg", sales="sales", profit="profit")
    f = star.fact_sales(df, roles, row_id=False, names=("segment",))
    assert [c for c in f.columns if c.endswith("_key")] == ["order_key", "order_date_key", "ship_date_key", "segment_key"]
    m = {r["segment"]: (r["total_sales"], r["total_orders"], r["loss_orders"], r["customer_count"]) for r in star.measures(df, roles, "segment").collect()}
    assert m == {"S": (15.0, 2, 0, 2), "Unknown": (5.0, 1, 1, 1)}
    assert set(star.key_tables(df, roles, ("customer",))) == {"customer"}
