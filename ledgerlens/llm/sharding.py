"""Sharding by weighted rendezvous hashing.

Every record key is scored against every shard: u is a hash of (key, shard) in (0, 1), the score is -weight / ln(u), and
the record goes to the shard with the highest score. A shard then gets a share of the keys in proportion to its weight, the
place of a record depends on nothing but its key and the list of shards, and a change of the list moves only what it must: a
new shard takes its share from all others and moves nothing between them, a shard that is taken away hands its records on, and
a raised weight only draws records in.

``write_shards`` deals whole records out: one range-partitioned sort by (shard, key), written as Parquet in one
folder a shard. A hot shard or key is spread over as many tasks and files as it needs (rows of one key are split by row). A record's
slot, its gapless number in the shard, isn't counted row by row: rows carry their place in the sort, and one row per
(shard, sort partition) gives the place that the shard's rows start at.

Defined results: a null key is a key like any other (its rows go to one shard, first in it); rows with equal keys go to
one shard, ordered by a hash of their columns, then as read; repeated rows each get a slot; an empty table gives no rows; a
null text has size 1 and checksum 0. Texts of any length pass whole, in the JVM only. Records are kept in one struct column, so their
own columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import planned_partitions, scratch, text_of

#: Bytes of text that a sort partition is planned for.
PARTITION_BYTES = 128 << 20
#: Hexadecimal digits of the MD5 that make up u: 52 bits, all that a double holds with a half added.
DIGITS = 13

Shard = tuple[int, float]


def equal_shards(n: int) -> list[Shard]:
    return [(i, 1.0) for i in range(n)]


def _checked(shards: Sequence[Shard]) -> list[Shard]:
    if not shards or len({i for i, _ in shards}) != len(shards) or any(not w > 0 for _, w in shards):
        raise ValueError("shards must be distinct (number, weight) pairs with weights over 0")
    return sorted(shards)


def key_of(key: Column) -> Column:
    """The stable text of a record key; null is the empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def score(key: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u), u from the first 52 bits of MD5(``key:shard``)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return -weight / F.log((bits + 0.5) / float(1 << 4 * DIGITS))


def shard_of(key: Column, shards: Sequence[Shard]) -> Column:
    """The number of the shard that scores highest for ``key``; of equal scores the smaller number."""
    text = key_of(key)
    listed = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in _checked(shards)])
    best = F.array_max(F.transform(listed, lambda s: F.struct(score(text, s["shard"], s["weight"]).alias("score"), (-s["shard"]).alias("minus"))))
    return -best["minus"]


def moves(rows: DataFrame, key: str, before: Sequence[Shard], after: Sequence[Shard]) -> DataFrame:
    """The records of ``rows`` that another list of shards moves: source and target shard, and the record as a struct."""
    placed = rows.select(shard_of(F.col(key), before).alias("source"), shard_of(F.col(key), after).alias("target"), F.struct("*").alias("record"))
    return placed.filter("source <> target")


def write_shards(rows: DataFrame, shards: Sequence[Shard], path: str | None = None, key: str = "doc_id") -> str:
    """Write ``rows`` into one folder a shard under ``path``/records; returns the path for ``read_shards``."""
    spark = rows.sparkSession
    path = path or scratch(spark, "shards")
    placed = rows.select(shard_of(F.col(key), shards).alias("shard"), F.xxhash64("*").alias("tie"), F.monotonically_increasing_id().alias("row"), F.struct("*").alias("record"))
    parts = planned_partitions(rows, PARTITION_BYTES)
    order = ["shard", F.col(f"record.`{key}`").asc_nulls_first(), "tie", "row"]
    # place: number of the sort partition, then of the row in it
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("shard", F.monotonically_increasing_id().alias("place"), "record")
    ranged.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/records")
    # one row a (shard, sort partition)
    pieces = spark.read.schema("shard int, place long").parquet(f"{path}/records").groupBy("shard", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("at"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (pieces.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "part", "at", "start", "n")
     .write.mode("overwrite").parquet(f"{path}/starts"))
    rows.limit(0).select(F.struct("*").alias("record")).write.mode("overwrite").parquet(f"{path}/schema")
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, slot and record of all records under ``path``."""
    kind = spark.read.parquet(f"{path}/schema").schema["record"].dataType
    records = spark.read.schema(T.StructType().add("shard", T.IntegerType()).add("place", T.LongType()).add("record", kind)).parquet(f"{path}/records")
    starts = spark.read.schema("shard int, part long, at long, start long, n long").parquet(f"{path}/starts").select(F.col("shard").alias("s"), "part", "at", "start")
    # at most as many rows as sort partitions and shards
    both = records.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.shiftright("place", 33) == F.col("part")))
    return both.select("shard", (F.col("start") + F.col("place") - F.col("at")).alias("slot"), "record")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = read_shards(spark, write_shards(docs, equal_shards(16)))
    doc_id, text = F.col("record.doc_id").cast("long"), F.col("record.text")
    return placed.select(doc_id.alias("doc_id"), (F.octet_length(text_of(text)) + 1).cast("long").alias("size"), F.crc32(text_of(text)).alias("text_crc32"),
                         F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("record.doc_id"), equal_shards(17)).alias("grown_shard"))


SQL = r"""
WITH crc_table AS (SELECT list(list_reduce(list_concat([i], [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
c AS MATERIALIZED (SELECT rid, doc_id, key, strlen(text) + 1 AS size, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc_table),
s AS MATERIALIZED (SELECT rid, shard, -1.0 / ln((CAST('0x' || substr(md5(key || ':' || shard), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score FROM d, range(17) r(shard)),
a AS (SELECT rid, arg_max(shard, score) FILTER (shard < 16) AS shard, arg_max(shard, score) AS grown FROM s GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM c JOIN a USING (rid)
"""
