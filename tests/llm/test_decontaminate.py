import random
import re

from pyspark.sql import Row

from ledgerlens.llm import decontaminate as D

RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, width):
    wins = []
    for i, t in items:
        w = RE.findall(low(t))
        if w:
            k = min(width, len(w))
            wins += [(i, tuple(w[a:a + k])) for a in range(len(w) - k + 1)]
    out = []
    for d, t in docs:
        w = RE.findall(low(t))
        hit, found = set(), set()
        for i, x in wins:
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a:a + len(x)]) == x:
                    hit.update(range(a, a + len(x)))
                    found.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["a", "B", "éa", "ÉA", "x1", " ", "zz", "q"]
    text = lambda n: rng.choice([" ", "--", "\n", "."]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (None, "a B a B"), (5, "a"), (5, "a")]
    items = [(i, text(rng.choice([1, 2, 3, 4, 9, 12]))) for i in range(12)] + [(90, None), (91, "..."), (None, "a B a"), (93, "a B a")]
    return docs, items


def test_against_brute_force_in_one_and_several_blocks(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", __import__("pyspark").sql.functions.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    for width in (3, 10):
        want = brute(docs, items, width)
        assert any(x[2] for x in want)
        for block in (1 << 20, 20):
            got = [(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in D.decontaminate(d, b, width, block).collect()]
            assert sorted(got, key=repr) == want, (width, block)
            kept = sorted(((r.doc_id, r.hits) for r in D.drop_contaminated(d, b, width, block).collect()), key=repr)
            assert kept == sorted(((x[0], 1) for x in want if not x[2]), key=repr)


def test_spans_are_offsets_in_the_original(spark):
    text = "Éé -- One,two\n THREE four?!"
    m = D.Matcher([("1", "two three four")], 10)
    n, ranges, items = m.scan(text)
    assert (n, ranges, items) == (5, [[2, 5]], [0])
    assert [text[a:b] for a, b in D.char_spans(text, ranges)] == ["two\n THREE four"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(none, items).count() == 0
    some = spark.createDataFrame([Row(doc_id=1, text="a b")])
    assert [tuple(r)[:4] for r in D.decontaminate(some, items).collect()] == [(1, 2, 0, 0)]


def test_blocks_are_bounded_by_their_windows(spark):
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    items = [(1, text(1, 500)), (2, "short"), (3, None), (4, text(4, 30)), (5, text(5, 9))]
    b = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(D._blocks(b, 10, 4000))
    windows = [{(i, w) for i, t in block for w in D.windows_of(D.words_of(t), 10)} for block in blocks]
    assert all(sum(len(w) + 2 for _, w in found) <= 4000 for found in windows)
    assert sum(map(len, windows)) == len(set().union(*windows))
    assert set().union(*windows) == {(str(i), w) for i, t in items for w in D.windows_of(D.words_of(t or ""), 10)}
    assert len(list(D._blocks(b, 10, 1 << 20))) == 1
