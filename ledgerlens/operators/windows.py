"""Global running sums and ranks without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` pulls every row into one task.
For tables that can be large (customers, products, distinct values) we instead:

1. range-partition on the total order (ties broken by a key, so the range
   partitioner can split any hot value across tasks);
2. write that result to the shared checkpoint folder so partition ids are fixed
   even if executors are lost and stages are recomputed; the partition count
   follows the row count, so a partition never outgrows a task;
3. sum each partition (one row per partition), turn those into offsets with a
   tiny window, broadcast them back (bounded by the partition count);
4. finish with a window partitioned by the partition id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialise

ROWS_PER_PARTITION = 1_000_000


def global_prefix(df: DataFrame, order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums ``sums`` over the total order ``order``."""
    spark = df.sparkSession
    names = list(sums)
    tmp = materialise(df.select("*", *[sums[n].alias(f"__v{i}") for i, n in enumerate(names)]), "prefix-in")
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tmp.count() // ROWS_PER_PARTITION))
    ranged = materialise(tmp.repartitionByRange(parts, *order).withColumn("__pid", F.spark_partition_id()), "prefix")
    totals = ranged.groupBy("__pid").agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(names))])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__o{i}")
                                       for i in range(len(names))])
    local = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(offsets), "__pid")
    return out.select(*df.columns, *[(F.sum(f"__v{i}").over(local) + F.col(f"__o{i}")).alias(n) for i, n in enumerate(names)])


def row_number_global(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """1..n in a total order (distributed)."""
    return global_prefix(df, order, {name: F.lit(1).cast("long")})


def percent_rank_average(df: DataFrame, value: str, name: str) -> DataFrame:
    """pandas ``rank(pct=True)`` with average ties: (first_rank + last_rank)/2 / n."""
    counts = df.groupBy(F.col(value).alias("__val")).agg(F.count(F.lit(1)).alias("__cnt")).where(F.col("__val").isNotNull())
    pref = global_prefix(counts, [F.col("__val").asc()], {"__cum": F.col("__cnt")})
    n = df.agg(F.count(F.col(value)).alias("__n"))
    ranks = pref.crossJoin(F.broadcast(n)).select(
        "__val", ((F.col("__cum") - (F.col("__cnt") - 1) / 2.0) / F.col("__n")).alias(name))
    return df.join(ranks, df[value] == ranks["__val"], "left").drop("__val")


def dense_code(df: DataFrame, key: Column, name: str = "code") -> DataFrame:
    """0-based code of each distinct key in sorted order (``factorize(sort=True)``)."""
    keys = df.select(key.alias("__k")).where(F.col("__k").isNotNull()).distinct()
    coded = global_prefix(keys, [F.col("__k").asc()], {"__c": F.lit(1).cast("long")}) \
        .select("__k", (F.col("__c") - 1).alias(name))
    return df.withColumn("__k", key).join(coded, "__k", "left").drop("__k")
