import random

import numpy as np

from ledgerlens.llm import quality as Q


def prose(rng, n):
    words = ["tion", "the", "sandre", "hewhat", "Étre", "and", "ofreat", "by", "nouère", "ered"]
    out = []
    while len(out) < n:
        s = [rng.choice(words) + rng.choice(["", "", "ing", "ly"]) for _ in range(rng.randint(4, 14))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out)


def junk(rng, n):
    t = prose(rng, n)
    return rng.choice([
        lambda: " ".join(w + rng.choice(["###", "***", "$$$"]) for w in t.split()),
        lambda: " ".join(w.upper() + "!!" for w in t.split()),
        lambda: " ".join(w for w in t.split()[:max(3, n // 20)] for _ in range(20)),
        lambda: " | ".join(w.strip(".") for w in t.split()),
    ])()


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, junk(rng, rng.randint(30, 300)) if rng.random() < 0.12 else None) for i in range(n)], rng


def data(n=1500, seed=1):
    rows, rng = corpus(n, seed)
    return [(i, t or prose(rng, rng.randint(8, 300)), t is None) for i, t in rows]


def test_em_finds_the_accuracies_of_planted_labellers():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    counts = {}
    for y in truth:
        says = np.where(rng.random(5) < right, y, ~y)
        seen = rng.random(5) < 0.7
        p = "".join("g" if s and v else "b" if v else "-" for s, v in zip(says, seen))
        counts[p] = counts.get(p, 0) + 1
    prior, table, post = Q.fit_em(counts)
    assert abs(prior - 0.8) < 0.03
    found = [t[1, 2] / (t[1, 1] + t[1, 2]) for t in table]
    assert np.abs(np.array(found) - right).max() < 0.05
    assert post["ggggg"] > 0.99 and post["bbbbb"] < 0.02


def test_held_out_accuracy_without_labels(spark):
    train, held = data(), data(400, seed=9)
    model = Q.fit(d := spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string"), Q.label(d))
    right = [(model.score(Q.View(t)) >= 0.5) == good for _, t, good in held]
    assert sum(right) >= 0.98 * len(right)
    clean = [model.score(Q.View(t)) >= 0.5 for _, t, good in held if good]
    assert sum(clean) >= 0.99 * len(clean)


def test_query_rows_equal_the_model_on_each_text(spark):
    rows = [(i, t) for i, t, _ in data(300)] + [(None, "a b"), (1000, None), (1001, ""), (5, "same"), (5, "same"), (1002, "word " * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as votes")
    model = Q.fit(d, Q.label(d))
    want = sorted(((i, Q.votes(v := Q.View(t or "")), round(model.score(v), 6)) for i, t in rows), key=repr)
    found = Q.classify(d).collect()
    assert sorted(((r.doc_id, r.votes, r.score) for r in found), key=repr) == want
    kept = Q.drop_rejected(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in found if r.kept), key=repr)
    assert Q.classify(d.limit(0)).count() == 0 and Q.drop_rejected(d.limit(0)).count() == 0


def test_the_sample_is_bounded(spark):
    d = spark.createDataFrame([(i, t) for i, t, _ in data(600)], "doc_id long, text string")
    model = Q.fit(d, Q.label(d), train_rows=100)
    assert sum((model.score(Q.View(t)) >= 0.5) == good for _, t, good in data(200, seed=4)) >= 180


def test_a_corpus_without_junk_is_kept(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(3, 200))) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Q.drop_rejected(d).count() == len(rows)
