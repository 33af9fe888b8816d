"""Row digests: whole rows compared, counted and numbered by 128 bits instead of all their columns.

A row's digest is two 64-bit hashes over every column and its NULL mark (the hash alone passes over NULLs).  Equal rows
are counted per task before the shuffle, so a row that fills a third of the table arrives as one partial count per task,
and only 24 bytes per distinct row are shuffled, however wide the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.quantiles import double_code
from ledgerlens.session import materialise

DIGEST = ("_d1", "_d2")


def with_digest(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns ``_d1`` and ``_d2``: the digest of each row (of ``cols``)."""
    cells = [x for c in (cols or df.columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return df.select("*", F.xxhash64(F.lit(1), *cells).alias("_d1"), F.xxhash64(F.lit(2), *reversed(cells)).alias("_d2"))


def row_counts(df: DataFrame) -> DataFrame:
    """One row: rows, duplicate_rows (those beyond the first of equal rows)."""
    counts = with_digest(df).groupBy(*DIGEST).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def canonical(df: DataFrame) -> Column:
    """Each row as one text that any engine can make: per column ``-`` for NULL, else length, colon, value; doubles by
    their 64-bit code, times to the second."""
    cells = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t in ("double", "float"):
            text = double_code(x.cast("double")).cast("string")
        else:
            text = F.date_format(x, "yyyy-MM-dd HH:mm:ss") if t.startswith("timestamp") else x.cast("string")
        cells.append(F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*cells)


def _content_key(df: DataFrame) -> Column:
    """64 bits of a row: equal for rows whose canonical texts are equal, and hardly ever else."""
    cells = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t in ("double", "float"):   # as the code has it: one zero, and no difference between NaN and infinity
            x = F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x.cast("double") + F.lit(0.0))
        else:
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss") if t.startswith("timestamp") else x.cast("string")
        cells += [x.isNull(), x]
    return F.xxhash64(F.lit(1), *cells)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``name``: a stable id of every row, the MD5 of its content and its number among equal rows.

    A count of 64-bit keys, the only thing shuffled of every row, finds what may be repeated.  All other rows get their id
    where they are read.  Equal rows are numbered within the task that read them, and the counts of the tasks before (one
    row per digest and task) are added where a digest is in several.  No row is compared with another, nothing is sorted over the
    whole table, a row repeated any number of times stays spread over its tasks, and rows that are added change no id given before.
    """
    key, digest, at, part, n, before, k = "_key", "_digest", "_at", "_part", "_n", "_before", "_k"
    plain, own = [F.col(f"`{c}`") for c in df.columns], F.md5(canonical(df).cast("binary"))
    keyed = df.withColumn(key, _content_key(df))
    # written, so that Spark knows its size: a small one is broadcast and the rows stay where they are
    again = materialise(keyed.groupBy(key).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(key), "repeated")
    if again.isEmpty():
        return df.select(*plain, F.concat(own, F.lit("-1")).alias(name))
    single = keyed.join(again, key, "left_anti").select(*plain, F.concat(own, F.lit("-1")).alias(name))
    rows = materialise(keyed.join(again, key, "left_semi").select(*plain, own.alias(digest), F.monotonically_increasing_id().alias(at)), "numbered")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    sizes = rows.groupBy(digest, part).agg(F.count(F.lit(1)).alias(n))
    several = Window.partitionBy(digest)   # at most one row per task
    sizes = sizes.withColumn(before, F.sum(n).over(several.orderBy(part)) - F.col(n)).withColumn("_all", F.sum(n).over(several))
    repeated = sizes.where("_all > 1").select(F.col(digest).alias("_d"), F.col(part).alias("_p"), before, n)
    mine = rows.join(repeated, (F.col(digest) == F.col("_d")) & (F.col(part) == F.col("_p")), "left")
    lone = mine.where(F.coalesce(F.col(n), F.lit(1)) == 1).withColumn(k, F.coalesce(F.col(before), F.lit(0)) + 1)
    many = mine.where(F.col(n) > 1).withColumn(k, F.col(before) + F.row_number().over(Window.partitionBy(digest, part).orderBy(at)))
    return single.unionByName(lone.unionByName(many).select(*plain, F.concat(F.col(digest), F.lit("-"), F.col(k).cast("string")).alias(name)))
