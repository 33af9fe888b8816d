"""The distributed prefix sum equals a single ordered window, including a hot tied value."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.windows import dense_code, global_prefix, percent_rank_average


def _data(spark):
    # a third of the rows share one value (a hot key); the key column breaks ties
    return spark.range(0, 3000).select(F.col("id").alias("k"),
                                       F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 37 % 101).cast("double")).alias("v"))


def test_distributed_matches_single_window(spark):
    df = _data(spark)
    order = [F.col("v").desc(), F.col("k").asc()]
    dist = global_prefix(df, order, {"cum": F.col("v"), "rn": F.lit(1).cast("long")}, partitions=7)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = df.select("k", F.sum("v").over(w).alias("cum"), F.sum(F.lit(1).cast("long")).over(w).alias("rn"))
    a = sorted((r["k"], r["rn"], r["cum"]) for r in dist.collect())
    b = sorted((r["k"], r["rn"], r["cum"]) for r in one.collect())
    assert a == b
    assert sorted(r[1] for r in a) == list(range(1, 3001))


def test_dense_code_and_percent_rank(spark):
    df = _data(spark)
    codes = dense_code(df, F.col("v"), "code").select("v", "code").distinct().orderBy("v").collect()
    assert [r["code"] for r in codes] == list(range(len(codes)))
    pr = percent_rank_average(df, "v", "pr").where(F.col("v") == 7.0).select("pr").distinct().collect()
    n_below = df.where(F.col("v") < 7.0).count()
    n_eq = df.where(F.col("v") == 7.0).count()
    assert abs(pr[0]["pr"] - (n_below + (n_eq + 1) / 2) / 3000) < 1e-12
