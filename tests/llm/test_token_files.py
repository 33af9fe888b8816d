import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import token_files as T


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=300))
def test_elias_fano_round_trip_and_select(values):
    v = sorted(values)
    e = T.EliasFano.of(np.array(v, np.uint64))
    assert e.all().tolist() == v
    assert [e.select(i) for i in range(len(v))] == v


def test_size_is_near_the_bound():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 10_000))
    e = T.EliasFano.of(v)
    bits = 8 * (len(e.low) + len(e.high) + len(e.hints)) / len(v)
    assert bits < 2 + np.log2((1 << 30) / len(v)) + 1.6


def texts(n=300, seed=2):
    rng = random.Random(seed)
    parts = ["The", "the,", "don't", "x.", "É", "é", "İ", "ΑΣ", "Σ", "<|endoftext|>", "<|startoftext|>a", "\t", "  ", "\n", " ", "12", "½", "字", "😀", "é", "'s", "''", "ab|", "́", ",", "­", "﻿", "\x00", "a.b,", "Straße,"]
    return [rng.choice([" ", "", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_words_equal_whole_texts():
    t = Tokenizer.from_file(T.vocabulary())
    enc = T.WordEncoder(T.vocabulary())
    assert enc.by_word
    batch = texts() + ["", "a" * 3000 + "."]
    for _ in range(2):
        for got, text in zip(enc.encode(batch), batch):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_arrow_slices_and_full_caches_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 20)
    t = Tokenizer.from_file(T.vocabulary())
    enc = T.WordEncoder(T.vocabulary())
    odd = ["ÀÖØöøÿß.", "ª", "µm", "xº,", "×", "a÷b", "a.̸", "word<|endoftext|>", "<|ENDOFTEXT|>", "it's!", "''", "a\tb", "B" * 70 + "!" * 70, "日本 Ωa, a字"]
    batch = pa.array(["not in the slice", *odd, "", "\n \n", *texts(200, 7)])[1:]
    for _ in range(2):
        for at in range(0, len(batch), 30):
            part = batch[at:at + 30]
            want = [np.array(t.encode(x, add_special_tokens=False).ids, enc.kind).tobytes() for x in part.to_pylist()]
            assert enc.packed(part) == want
    assert enc.packed(batch[:0]) == []
    assert max(map(len, enc.cache)) <= 64


def test_known_words_are_looked_up_once_a_slice(monkeypatch):
    """A word that comes again in a slice, with other marks or in capitals, costs no lookup and no question of its own."""
    enc = T.WordEncoder(T.vocabulary())
    asked, words = [], []
    ids, part_ids = enc._ids, enc._part_ids
    monkeypatch.setattr(enc, "_ids", lambda x: asked.extend(x) or ids(x))
    monkeypatch.setattr(enc, "_part_ids", lambda x: words.extend(x) or part_ids(x))
    enc.packed(pa.array(["alpha Alpha, ALPHA! beta.\n" * 1000] * 3))
    assert sorted(words) == ["", "!", ",", ".", "alpha", "beta"]
    assert sorted(asked) == ["!", ",", ".", "alpha beta"]
    enc.packed(pa.array(["beta, alpha."]))
    assert len(asked) == 4


def test_files_hold_all_documents_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT_IDS", 200)
    t = Tokenizer.from_file(T.vocabulary())
    rows = [(i * 3, x) for i, x in enumerate(texts(80))] + [(None, "null id"), (1, None), (2, ""), (-7, "below"), (9, "same id"), (9, "same id"), (9, "other")]
    random.Random(4).shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as part", "3 as start").repartition(5)
    path = str(tmp_path / "ids")
    T.write_ids(d, path, T.vocabulary())
    got = sorted(T.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((i is not None, i or 0) for i, _ in rows)
    want = sorted((i or 0, np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, x in rows)
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    for row in T.segments(spark, path).limit(3).collect():
        _, ids, ends = T._documents(row.asDict())
        assert all(T.ids_of(row.asDict(), i).tolist() == ids[(ends[i - 1] if i else 0):ends[i]].tolist() for i in range(row.n_docs))


def test_empty_table(spark, tmp_path):
    T.write_ids(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), T.vocabulary())
    assert T.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_crc_is_over_32_bit_ids(spark, tmp_path):
    T.write_ids(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(tmp_path / "c"), T.vocabulary())
    row = T.read_ids(spark, str(tmp_path / "c")).selectExpr("ids", "crc32(ids) as c").first()
    assert row.c == zlib.crc32(bytes(row.ids))
