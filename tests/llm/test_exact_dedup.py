import hashlib
import re

import pytest

from ledgerlens.llm import exact_dedup as X
from ledgerlens.llm.common import scratch

ROWS = [(5, "a  b"), (3, "a b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (4, "\x0b"), (None, "a b"), (None, "lone"), (8, "é x"), (8, "é x")]


def digest(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    keep = {h: min((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    out, used = [], set()
    for i, t in rows:
        h = digest(t)
        first = i == keep[h] and h not in used
        used |= {h} if first else set()
        out.append((i, keep[h], len(groups[h]), first, h))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in df.collect()), key=repr)


def test_one_batch(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as KEPT", "3 as copies")
    assert got(X.exact_dedup(d)) == brute(ROWS)
    kept = X.drop_exact_copies(d)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, digest(r.text)) for r in kept.collect()), key=repr) == sorted([(i, h) for i, _, _, k, h in brute(ROWS) if k], key=repr)
    assert X.exact_dedup(d.limit(0)).count() == 0


def test_later_batches_are_held_against_the_index(spark):
    path = scratch(spark, "test-index")
    first = spark.createDataFrame(ROWS[:4], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a b"), (0, "new"), (7, "new"), (2, "a b ")], "doc_id long, text string")
    index = X.DigestIndex(spark, path, 4)
    assert got(index.dedup(first)) == brute(ROWS[:4])
    again = X.DigestIndex(spark, path, 4)  # opened anew
    assert [x[:4] for x in got(again.dedup(second))] == [(0, 0, 2, True), (1, 3, 1, False), (2, 9, 1, False), (7, 0, 2, False)]
    assert again.table().count() == 3
    assert sorted(map(tuple, X.DigestIndex(spark, path, 4).new_documents(spark.createDataFrame([(6, "other"), (0, "new")], "doc_id long, text string")).collect())) == [(6, "other")]


def test_the_index_side_is_not_shuffled(spark):
    index = X.DigestIndex(spark, scratch(spark, "test-index"), 4)
    index.dedup(spark.createDataFrame(ROWS, "doc_id long, text string"))
    groups = spark.range(9).selectExpr("unhex(sha2(cast(id as string), 256)) as digest").repartition(4, "digest")
    plan = groups.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan


def test_a_group_with_most_rows(spark):
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(3000)]
    assert got(X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_another_number_of_buckets_is_refused(spark):
    path = scratch(spark, "test-index")
    first = X.DigestIndex(spark, path, 8)
    first.dedup(spark.createDataFrame(ROWS, "doc_id long, text string"))
    with pytest.raises(ValueError, match="8 buckets"):
        X.DigestIndex(spark, path, 4)
    again = X.DigestIndex(spark, path)  # takes the number that the index has
    assert again.buckets == 8
    assert not any(r.kept for r in again.dedup(spark.createDataFrame(ROWS, "doc_id long, text string")).collect())
    assert X.DigestIndex(spark, scratch(spark, "test-index"), expected=1_000_000_000).buckets == 500


def test_a_batch_run_again_keeps_the_same_rows(spark):
    index = X.DigestIndex(spark, scratch(spark, "test-index"), 4)
    index.dedup(spark.createDataFrame([(1, "old")], "doc_id long, text string"), "monday")
    batch = spark.createDataFrame([(4, "new"), (5, "new"), (6, "old")], "doc_id long, text string")
    first = got(index.dedup(batch, "tuesday"))
    assert got(index.dedup(batch, "tuesday")) == first and [r[0] for r in first if r[3]] == [4]
    assert index.table().count() == 2
    assert not any(r[3] for r in got(index.dedup(batch, "wednesday")))


def test_very_long_text_and_a_row_repeated_often(spark, monkeypatch):
    monkeypatch.setattr(X, "RUN", 7)
    rows = [(1, "word " * 1_000_000), (2, "word  " * 1_000_000)] + [(3, "again")] * 50
    assert got(X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
