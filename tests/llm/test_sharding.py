import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import sharding as S
from ledgerlens.llm.common import scratch


def place(key, shards):
    def score(i, w):
        h = int(hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16)
        return -w / math.log((h + 0.5) / 2**52)

    return max(shards, key=lambda s: (score(*s), -s[0]))[0]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "PARTITION_BYTES", 4000)  # many sort partitions a shard
    rng = random.Random(4)
    rows = [(rng.choice([None, i, i, i % 50]), rng.choice([None, "", f"text É {i}"]), i) for i in range(1500)] + [(7, "same", 0)] * 60 + [(8, "long " * 200_000, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard int").selectExpr("*", "1 as place", "2 as record", "3 as slot")
    shards = [(0, 1.0), (1, 2.5), (4, 0.5), (9, 1.0)]
    found = S.read_shards(spark, S.write_shards(d, shards)).select("shard", "slot", "record.doc_id", "record.text", F.col("record.shard").alias("own")).collect()
    assert sorted(((r.doc_id, r.text, r.own) for r in found), key=repr) == sorted(rows, key=repr)
    assert all(r.shard == place(r.doc_id, shards) for r in found)
    by_shard = collections.defaultdict(list)
    for r in found:
        by_shard[r.shard].append((r.slot, r.doc_id is not None, r.doc_id or 0))
    for slots in by_shard.values():
        slots.sort()
        assert [s for s, *_ in slots] == list(range(len(slots)))
        assert [s[1:] for s in slots] == sorted(s[1:] for s in slots)


def test_moves_and_weights(spark):
    d = spark.range(20_000).withColumnRenamed("id", "doc_id")
    four = S.equal_shards(4)
    share = {r.s: r.n for r in d.groupBy(S.shard_of(F.col("doc_id"), [(0, 1.0), (1, 3.0)]).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert abs(share[1] / 20_000 - 0.75) < 0.02
    grown = S.moves(d, "doc_id", four, S.equal_shards(5))
    assert {r.target for r in grown.select("target").distinct().collect()} == {4} and abs(grown.count() / 20_000 - 0.2) < 0.02
    less = S.moves(d, "doc_id", four, four[:3])
    assert {r.source for r in less.select("source").distinct().collect()} == {3} and abs(less.count() / 20_000 - 0.25) < 0.02
    raised = S.moves(d, "doc_id", four, [(0, 1.0), (1, 2.0), (2, 1.0), (3, 1.0)])
    assert {r.target for r in raised.select("target").distinct().collect()} == {1}


def test_query_small_and_empty_tables(spark):
    rows = [(i if i % 9 else None, None if i % 7 == 0 else f"t{i}É") for i in range(200)]
    path = scratch(spark, "test-docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    out = S.op12_sharding(spark, path).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", place(i, S.equal_shards(16)), place(i, S.equal_shards(17))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in out) == want
    assert all(r.grown_shard in (r.shard, 16) for r in out) and any(r.grown_shard == 16 for r in out)
    empty = scratch(spark, "test-docs")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    assert S.op12_sharding(spark, empty).count() == 0


def test_shards_are_checked():
    for bad in ([], [(0, 1.0), (0, 1.0)], [(0, 0.0)]):
        with pytest.raises(ValueError):
            S._checked(bad)
