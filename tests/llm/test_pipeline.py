import hashlib
import random

import numpy as np

import corpus_pipeline as P
from ledgerlens.llm import bpe, quality
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_quality import data, prose
from tests.llm.test_simhash import brute_fingerprint, brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(spark, folder):
    rng = random.Random(6)
    rows = [(i, t) for i, t, _ in data(400, seed=2)]
    base = [t for _, t in rows[:40]]
    items = [(i, prose(rng, 25)) for i in range(4)]
    for t in base[:10]:  # exact and near copies, leaks
        rows += [(len(rows), t.replace(" ", "  ")), (len(rows) + 1, t + " tail")]
    rows += [(len(rows) + k, prose(rng, 60) + " " + t + " " + prose(rng, 40)) for k, (_, t) in enumerate(items)]
    rows += [(9000, None), (9001, ""), (9002, prose(rng, 20_000))]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(docs, quality.label(docs))
    left = [(i, t) for i, t in rows if model.score(quality.View(t or "")) >= 0.5]
    assert 300 < len(left) < len(rows)
    stay = {x[0] for x in brute_exact(left) if x[3]}
    assert len(stay) < len(left)
    left = sorted((i, t) for i, t in left if i in stay)
    roots = brute_groups([brute_fingerprint(t) for _, t in left])
    left = [x for k, x in enumerate(left) if roots[k] == k]
    stay = {x[0] for x in brute_leaks(left, items, 10) if not x[2]}
    assert len(left) - len(stay) == 4
    enc = bpe.Encoder(bpe.rank_file())
    want = []
    for (i, t), ids in zip(kept := [x for x in left if x[0] in stay], enc.encode_batch([t or "" for _, t in kept])):
        want.append((i, len(np.frombuffer(ids, "<u4")), hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, P.run(spark, str(tmp_path)).collect())) == want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "decontaminate", "encode"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == COLUMNS
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
