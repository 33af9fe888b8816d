"""Missing counts and constant columns."""

from __future__ import annotations

from ledgerlens.operators.quality import missing_counts


def test_constant_columns_in_a_compiled_aggregate(spark):
    rows = [("x", None, "a", "", None, 1.0, 1), ("x", None, "b", "", "y", 1.0, 2), ("x", None, "a", "", "y", 1.0, 1)]
    t = missing_counts(spark.createDataFrame(rows, "same string, none string, two string, blank string, holes string, d double, i int"))
    assert {r.column: (r.missing_count, r.constant, r.rows) for r in t.collect()} == {
        "same": (0, True, 3), "none": (3, True, 3), "two": (0, False, 3), "blank": (0, True, 3), "holes": (1, True, 3), "d": (0, True, 3), "i": (0, False, 3)}
    assert "SortAggregate" not in t._jdf.queryExecution().executedPlan().toString()
