import hashlib
import random
import zlib

from pyspark.sql import functions as F

from ledgerlens.llm import merkle as M

H = lambda *xs: hashlib.sha256("".join(xs).encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tree(nodes):
    """Root, and for each leaf its (position, run) level by level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at):
            way.append((i % 16, nodes[i // 16 * 16:i // 16 * 16 + 16]))
        at = [i // 16 for i in at]
        nodes = [H(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], ways


def brute(rows):
    sources = {}
    for i, s, la, n, t in rows:
        leaf = H(enc(i), enc(s), enc(la), enc(n), enc(t))
        claim = H(enc(i), enc(s), enc(la), enc(n), enc(lowered(t))) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else leaf
        sources.setdefault(s, []).append(((i is not None, i or 0), leaf, i, claim))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[1] for x in sorted(sources[s])]) for s in names]
    root, tops = tree([t[0] for t in trees])
    out = []
    for s, (subroot, ways), top in zip(names, trees, tops):
        for (_, leaf, i, claim), way in zip(sorted(sources[s]), ways):
            proof, h = [], claim
            for pos, run in way + top:
                proof += run[:pos] + run[pos + 1:]
                h = H(*run[:pos], h, *run[pos + 1:])
            out.append((i, leaf, subroot, root, H(*proof), h, h == root))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as leaf", "2 as tree", "'x' as part", "0 as idx")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, M.leaf_of([*M.FIELDS[:-1], M.lower_ascii(F.col("text"))]))
    m = M.Manifest.build(d, extra={"tampered": tampered})
    p = m.prove(m.wanted().withColumn("claim", F.coalesce("tampered", "leaf")), "claim", **kw)
    return m, p


def cols(p):
    return sorted(map(tuple, p.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def rows_of(n, seed=3):
    rng = random.Random(seed)
    sources = [None, "", "a", "é", "z", "ab", *[f"s{k}" for k in range(40)]]
    return [(i, "hot" if rng.random() < 0.4 else rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i * 7]), rng.choice([None, "", f"Text É {i}", "SAME"])) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_PARTITION", 90)  # many partitions, so that a source spans several
    rows = rows_of(1500) + [(None, "a", "en", 1, "x"), (None, None, None, None, None), (7, "a", "en", 1, "x"), (7, "a", "en", 2, "X")] + [(9, "hot", "en", 1, "A copy")] * 70
    m, p = got(spark, rows)
    assert cols(p) == brute(rows)
    assert m.root() == brute(rows)[0][3]


def test_small_tables(spark):
    one = [(3, None, None, None, "Ünique\n" + "Long " * 300_000)]
    assert cols(got(spark, one)[1]) == brute(one)
    leaf = brute(one)[0]
    assert leaf[1] == leaf[2] == leaf[3] and leaf[4] == H()
    for n in (16, 17):
        rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
        assert cols(got(spark, rows)[1]) == brute(rows)
    m, p = got(spark, [])
    assert p.count() == 0 and m.root() is None


def test_some_leaves_later_from_the_written_manifest(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_PARTITION", 90)
    rows = rows_of(700)
    m, _ = got(spark, rows)
    again = M.Manifest(spark, m.path)
    some = again.prove(again.wanted().filter("doc_id % 41 = 3"), whole=True).collect()
    want = {r[0]: r for r in brute(rows)}
    assert {r.doc_id for r in some} == {i for i in want if i % 41 == 3}
    for r in some:
        proof = [(x.pos, x.siblings) for x in r.proof]
        assert (r.leaf, r.proof_sha256, r.folded_root, r.verified) == (want[r.doc_id][1], want[r.doc_id][4], m.root(), True)
        assert M.fold(r.leaf, proof) == m.root() and M.fold(H("other"), proof) != m.root()


def test_missing_is_minimal():
    import numpy as np

    # leaves 20..40 of 1000: runs 16..47 less own, then nodes 0 and 3..15 of level 1, then 1..3 of level 2
    found = M.missing(np.arange(20, 41), 1000)
    assert found == [(0, i) for i in [*range(16, 20), *range(41, 48)]] + [(1, 0), *[(1, i) for i in range(3, 16)]] + [(2, i) for i in range(1, 4)]
    assert M.missing(np.arange(100), 100) == []
