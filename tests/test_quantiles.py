"""Exact quantiles equal numpy's, for distinct and hot values, all signs and sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.quantiles import exact_quantiles, iqr_bounds

SHARES = (0.0, 0.25, 0.5, 0.6, 0.75, 1.0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 9_999, 60_000])
def test_all_distinct_doubles_and_a_hot_value(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) * 1e3
    y = np.where(rng.random(n) < 0.4, 5.0, np.round(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").union(spark.createDataFrame([(None, float("nan"))], "x double, y double"))
    row = exact_quantiles(df, {f"{c}{q}": (F.col(c), q) for c in "xy" for q in SHARES}).first()
    for c, v in (("x", x), ("y", y)):
        for q in SHARES:
            if n:
                assert row[f"{c}{q}"] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-9), (c, q)
            else:
                assert row[f"{c}{q}"] is None


def test_extreme_values(spark):
    x = [float("-inf"), -1.7e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 2.2250738585072014e-308, 1.0, 1.0000000000000002, 1.7e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in reversed(x)] + [(float("nan"),), (None,)], "x double")
    row = exact_quantiles(df, {f"q{i}": (F.col("x"), i / 11) for i in range(12)}).first()
    assert [row[f"q{i}"] for i in range(12)] == x


def test_no_window_or_sort_over_values(spark):
    df = spark.range(200_000).select((F.col("id") * 1.5).alias("x"))
    plan = exact_quantiles(df, {"m": (F.col("x"), 0.5)})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median" not in plan
    # windows run over bins, which aggregates have made of the values
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("n#" in line and "v#" not in line for line in windows)


def test_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "x double")
    assert iqr_bounds(df, [("x", "x")]).first().asDict() == {"_rows": 6, "x_n": 5, "x_q1": 2.0, "x_q3": 4.0}
