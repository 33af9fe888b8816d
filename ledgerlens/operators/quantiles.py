"""Exact quantiles by radix selection: bounded histograms, no sketch, no task that sees all values.

A double becomes a 64-bit code of the same order (its exponent and fraction as an integer, with its sign).  Four passes
settle 16 bits each: the values whose code begins with a wanted prefix are counted by their next 16 bits (at most 65,536
bins a prefix, combined before the shuffle), and the bin that holds a wanted rank lengthens its prefix.  After the fourth
pass the prefix is the value itself.  Later passes only touch values between a prefix's bounds, so codes are worked out
once for the whole column and then for ever fewer rows; equal values share a bin, so a hot value is one row.

The result is one lazy row of a chain of four aggregates; prefixes are two rows per wanted quantile and joined back as a
broadcast.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, PASSES = 16, 4
# --- fixed values: the 64-bit floating-point format ----------------------
FRACTION, BIAS, SPECIAL = 52, 1023, 2047
# ------------------------------------------------------------------------


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, which keeps the expression small."""
    return F.get(F.transform(F.array(value), use), 0)


def double_code(v: Column) -> Column:
    """A 64-bit integer of the same order as a double (exponent and fraction, with its sign; 0 for -0.0)."""
    def parts(a: Column) -> Column:
        # the logarithm may be off by one next to a power of two; scaling by powers of two is exact
        e = F.floor(F.log2(F.least(a, F.lit(sys.float_info.max)))).cast("int")
        return _bind(e, lambda e: _bind(a * F.pow(F.lit(2.0), -e), lambda m: F.when(m >= 2, fixed(e + 1, m / 2)).when(m < 1, fixed(e - 1, m * 2)).otherwise(fixed(e, m))))

    def fixed(e: Column, m: Column) -> Column:
        return (e.cast("long") + BIAS) * (1 << FRACTION) + ((m - 1) * float(1 << FRACTION)).cast("long")

    def size(a: Column) -> Column:
        tiny = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
        return (F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(SPECIAL << FRACTION))
                .when(a < 2.0 ** (1 - BIAS), tiny).otherwise(parts(a)))

    return F.when(v < 0, -1).otherwise(1) * _bind(F.abs(v), size)


def _value(code: Column) -> Column:
    """The double of a code."""
    def size(n: Column) -> Column:
        e, fraction = F.shiftright(n, FRACTION), n.bitwiseAND(F.lit((1 << FRACTION) - 1)).cast("double")
        return (F.when(e >= SPECIAL, F.lit(float("inf"))).when(e == 0, fraction * F.lit(2.0 ** -537) * F.lit(2.0 ** -537))
                .otherwise((1 + fraction / float(1 << FRACTION)) * F.pow(F.lit(2.0), e - BIAS)))

    return _bind(code, lambda c: F.when(c < 0, -1.0).otherwise(1.0) * _bind(F.abs(c), size))


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row: for each name the quantile ``(value, share)`` over non-NULL, non-NaN values, NULL when there are none."""
    spark, names = df.sparkSession, list(wanted)
    columns = {str(c): c for c, _ in wanted.values()}       # quantiles of one column share its histograms
    place = {text: k for k, text in enumerate(columns)}
    cells = [F.struct(F.lit(k).alias("k"), c.cast("double").alias("v")) for k, c in enumerate(columns.values())]
    values = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    shares = spark.createDataFrame([(t, place[str(c)], float(q)) for t, (c, q) in enumerate(wanted.values())], "t int, k int, share double")

    first = values.groupBy("k", F.shiftright(double_code(F.col("v")), 64 - BITS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("k")
    first = first.withColumn("below", F.sum("n").over(of.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(of))
    # per quantile the two ranks that it lies between
    spot = F.col("share") * (F.col("all") - 1)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("spot").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("spot").alias("rank"))))
    ranked = (first.join(F.broadcast(shares), "k").withColumn("spot", spot).select("*", ends.alias("e"))
              .where((F.col("e.rank") >= F.col("below")) & (F.col("e.rank") < F.col("below") + F.col("n"))))
    found = ranked.select("t", "k", "spot", "e.side", F.col("bin").alias("prefix"), (F.col("e.rank") - F.col("below")).alias("rank"))
    for step in range(1, PASSES):
        left = 64 - BITS * (step + 1)                        # bits still open after this pass
        low = F.shiftleft("prefix", left + BITS)
        high = low.bitwiseOR(F.lit((1 << left + BITS) - 1))
        bounds = found.select("t", "k", "spot", "side", "prefix", "rank", _value(low).alias("start"), _value(high).alias("stop"))
        inside = values.join(F.broadcast(bounds), "k").where(F.col("v").between(F.col("start"), F.col("stop")))
        bins = inside.groupBy("t", "spot", "side", "k", "prefix", "rank", F.shiftright(double_code(F.col("v")), left).bitwiseAND(F.lit((1 << BITS) - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        bins = bins.withColumn("below", F.sum("n").over(Window.partitionBy("t", "side").orderBy("bin")) - F.col("n"))
        hit = bins.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        found = hit.select("t", "k", "spot", "side", F.shiftleft("prefix", BITS).bitwiseOR(F.col("bin")).alias("prefix"), (F.col("rank") - F.col("below")).alias("rank"))
    both = found.groupBy("t", "spot").agg(*[F.max(F.when(F.col("side") == i, _value(F.col("prefix")))).alias(n) for i, n in enumerate("ab")])
    low, high = F.floor("spot"), F.ceil("spot")
    value = F.when(low == high, F.col("a")).otherwise((high - F.col("spot")) * F.col("a") + (F.col("spot") - low) * F.col("b"))
    return both.select("t", value.alias("x")).agg(*[F.max(F.when(F.col("t") == i, F.col("x"))).alias(n) for i, n in enumerate(names)])


def with_quantiles(one_row: DataFrame, df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """A one-row aggregate of ``df`` with quantiles of ``df`` beside it."""
    return one_row.crossJoin(F.broadcast(exact_quantiles(df, wanted))) if wanted else one_row


def iqr_bounds(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    """One row: ``<name>_q1``, ``<name>_q3`` and ``<name>_n`` (non-NULL count) for (name, column) pairs."""
    x = {n: F.col(c).cast("double") for n, c in cols}
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(v).alias(f"{n}_n") for n, v in x.items()])
    wanted = {f"{n}_{k}": (v, q) for n, v in x.items() for k, q in (("q1", 0.25), ("q3", 0.75))}
    return with_quantiles(counts, df, wanted)


def outside(name: str, x: Column) -> Column:
    """Is ``x`` an IQR outlier by the columns of :func:`iqr_bounds`?  Needs 4 values and a spread."""
    q1, q3 = F.col(f"{name}_q1"), F.col(f"{name}_q3")
    iqr = q3 - q1
    return F.coalesce((F.col(f"{name}_n") >= 4) & (iqr != 0) & ((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)), F.lit(False))
