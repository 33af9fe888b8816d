"""Helpers shared by the operators: shared scratch tables, hot-key joins, text rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import shared_dir

#: The ASCII white space of the contracts, ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Keys handled by broadcast in ``join_unique``; a top-k, so the broadcast side has at most this many rows.
HOT_KEYS = 1024


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def planned_partitions(rows: DataFrame, most: int) -> int:
    """Shuffle partitions for ``rows`` so that one holds about ``most`` bytes of text: the session's number at least."""
    text = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in rows.dtypes if t in ("string", "binary")]
    size = rows.agg(F.sum(sum(text, F.lit(64)).cast("long")).alias("n")).first()["n"] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def text_of(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have (any letter case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, how: str = "left") -> DataFrame:
    """Join ``right`` (one row per key, never null) to ``left``, where one key may hold a third of the rows.

    The ``HOT_KEYS`` heaviest keys by ``weight`` are broadcast (a top-k, so bounded); the rows of these keys never
    meet in one task. All other rows take the shuffled join, where no key weighs more than 1/HOT_KEYS of the rows.
    Both sides are read twice and should be materialised.
    """
    keys = list(keys)
    extra = [c for c in right.columns if c not in keys]
    (mark,) = fresh(left.select("*", *[F.lit(0).alias(c) for c in extra]), "hot_key")
    hot = right.orderBy(F.desc(weight), *keys).limit(HOT_KEYS).withColumn(mark, F.lit(True))
    tried = left.join(F.broadcast(hot), keys, "left")
    out = [*left.columns, *extra]
    rest = tried.filter(F.col(mark).isNull()).select(*left.columns).join(right, keys, how)
    return tried.filter(mark).select(*out).unionByName(rest.select(*out))


def keep_rows(docs: DataFrame, keys: dict[str, Column], keepers: DataFrame, ties: bool) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` are in ``keepers`` (columns named as the keys, one row per key).

    ``ties``: several rows of ``docs`` may share a key; then the row with the smallest hash of all columns stays
    (min_by is combined before the shuffle, so a row repeated very often meets as partial results only).
    """
    names = dict(zip(keys, fresh(docs, *[f"key_{k}" for k in keys])))
    own = docs.withColumns({names[k]: c for k, c in keys.items()})
    right = keepers.select(*[F.col(k).alias(f"{names[k]}_r") for k in keys])
    on = [F.col(names[k]).eqNullSafe(F.col(f"{names[k]}_r")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = own.join(right, cond, "left_semi")
    if ties:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        out = (out.groupBy(*names.values())
               .agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
               .select("row.*"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def slices(batches: Iterator, column: str, most: int = 1 << 22) -> Iterator:
    """Cut Arrow record batches so that each slice holds about ``most`` characters of ``column`` (or one row)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        pa.default_memory_pool().release_unused()  # what the batch before has left with the allocator
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
