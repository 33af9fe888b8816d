import random
import re

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(values, bits=3):
    """Smallest index reachable by value, over distinct values."""
    v = np.array(values, np.uint64)
    root = list(range(len(v)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def near(rng, x, least, most):
    for b in rng.sample(range(64), rng.randint(least, most)):
        x ^= 1 << b
    return x


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints():
    rng = random.Random(1)
    for t in ["", " \t\n", "a", "a b", "A b c", "Éa B c d\x0be f g", " x  y\nz w ", *[" ".join(rng.choice("aBcÉ") for _ in range(rng.randint(3, 200))) for _ in range(20)]]:
        assert S.fingerprint(t) == brute_fingerprint(t), t


@pytest.mark.parametrize("longest", [1 << 12, 8])
def test_components_equal_all_pairs(spark, monkeypatch, longest):
    """One large group around a centre, small groups and lone values; short runs force the refinement."""
    monkeypatch.setattr(S, "LONGEST_RUN", longest)
    rng = random.Random(longest)
    centre = rng.getrandbits(64)
    vals = {rng.getrandbits(64) for _ in range(150)}
    vals |= {near(rng, centre, 0, 6) for _ in range(500)}
    vals |= {near(rng, v, 1, 4) for v in list(vals)[:100]}
    vals = sorted(vals)
    roots = brute_groups(vals)
    want = {frozenset(v for v, r in zip(vals, roots) if r == k) for k in set(roots)}
    links = S.hamming_links(spark.createDataFrame([(signed(v),) for v in vals], "fp long"), 3)
    found = {}
    for node, root in S.components(links).collect():
        found.setdefault(root, set()).add(node & (1 << 64) - 1)
    assert {frozenset(x) for x in found.values()} == {x for x in want if len(x) > 1}


def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 300))) for _ in range(30)]
    out = base + [base[0]] * 5
    for t in base[:12]:
        w = t.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    out += ["", None, "  ", "short", "Short", "two words"]
    rng.shuffle(out)
    return list(enumerate(out))


def test_documents_against_brute_force(spark):
    data = rows()
    fps = [brute_fingerprint(t) for _, t in data]
    roots = brute_groups(fps)
    want = sorted((i, fps[i], min(j for j, r in enumerate(roots) if r == roots[i])) for i, _ in data)
    d = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in S.simhash_groups(d).collect())
    assert got == want
    kept = S.drop_near_copies(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def test_repeated_rows_null_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "zz yy xx ww vv"), (9, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_groups(d).collect()), key=repr)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None), (9, 9)], key=repr)
    assert sorted(map(tuple, S.drop_near_copies(d).collect()), key=repr) == sorted([(7, "a b c d"), (None, "zz yy xx ww vv"), (9, "")], key=repr)
    assert S.simhash_groups(d.limit(0)).count() == 0
    assert S.drop_near_copies(d.limit(0)).count() == 0


def test_unrelated_documents_without_an_id_or_with_the_same_id_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    data = [(None, text(1)), (None, text(2)), (None, text(2)), (5, text(3)), (5, text(4)), (5, text(4)), (6, text(4)), (None, text(3))]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in S.simhash_groups(d).collect()]
    assert sorted(got, key=repr) == sorted([(None, None)] * 3 + [(5, 5)] * 3 + [(6, 5), (None, 5)], key=repr)
    kept = sorted(map(tuple, S.drop_near_copies(d).collect()), key=repr)
    assert kept == sorted([(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4))], key=repr)
