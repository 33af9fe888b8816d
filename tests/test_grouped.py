"""Groups of many dimensions in one pass."""

from __future__ import annotations

from ledgerlens.operators.grouped import dim_perf
from ledgerlens.roles import Roles

ROLES = Roles(sales="s", profit="p", order_id="o", customer_id="c", region="r", segment="g")


def test_dim_perf_counts_orders_and_customers(spark):
    rows = [(1.0, 1.0, 1, 7, "A", "X"), (2.0, -1.0, 1, 7, "A", None), (3.0, 1.0, 2, None, None, "X"), (4.0, 1.0, None, 8, "A", "X"), (5.0, 1.0, 3, 8, "B", None)]
    t = dim_perf(spark.createDataFrame(rows, "s double, p double, o long, c long, r string, g string"), ROLES, ["region", "segment"], customers=True)
    found = {(r.dimension, r.dimension_value): (r.sales, r.order_count, r.row_count, r.customer_count) for r in t.collect()}
    assert found == {("region", "A"): (7.0, 1, 3, 2), ("region", "B"): (5.0, 1, 1, 1), ("region", None): (3.0, 1, 1, 0),
                     ("segment", "X"): (8.0, 2, 3, 2), ("segment", None): (7.0, 2, 2, 2)}


def test_dim_perf_makes_its_groups_once(spark):
    t = dim_perf(spark.range(100).selectExpr("1D AS s", "1D AS p", "id AS o", "id % 3 AS c", "'a' AS r", "'b' AS g"), ROLES, ["region", "segment"], customers=True)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan   # rows are not expanded again by those who read the groups
