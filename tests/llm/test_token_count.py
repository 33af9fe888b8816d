import random

import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import token_count as T
from tests.llm.test_token_files import texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.vocabulary())


def counted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(library):
    own = T.Compiled(T.vocabulary())
    rng = random.Random(9)
    parts = ["'s", "'t", "'ll", "'ve", "'re", "'l", "'v", "'", "''", "s", "l", "e", "Don", "É", " ", "\n", "\t", "\x1c", "\x85", " ", "!", "12", "٣", "字", "😀", "́", "İ", "Σ", "ΑΣ", "ﬁ", "_", "<|endoftext|>", "<|ENDOFTEXT|>", "<|"]
    batch = texts(200) + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(600)]
    batch += ["", "a" * 500, "ab" * 200, "é" * 90, "!" * 300, "The" * 50]
    batch += [chr(c) + "a" + chr(c) + "1 " + chr(c) for c in [*range(0x0, 0xD800, 13), *range(0xE000, 0x110000, 1999)]]
    for got, t in zip(own.count(batch).tolist(), batch):
        assert got == counted(library, t), repr(t)


def test_chunk_maps_compose_in_any_cut(library):
    own = T.Compiled(T.vocabulary())
    rng = random.Random(3)
    for t in texts(60, seed=8):
        cuts = sorted(rng.randint(0, len(t)) for _ in range(rng.randint(0, 6)))
        chunks = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]
        assert own.compose(own.chunk_maps(chunks)) == counted(library, t), (t, chunks)


def test_documents_of_one_and_many_chunks(spark, library):
    rows = list(enumerate(texts(60))) + [(None, "no id"), (100, None), (101, ""), (5, "again and again " * 9), (5, "again and again " * 9), (5, "other"), (102, "x" * 64)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as n_bytes")
    want = sorted(((i, len((t or "").encode()), counted(library, t)) for i, t in rows), key=repr)
    for chunk in (16, 1 << 16):
        got = T.token_counts(d, T.vocabulary(), chunk).select("doc_id", "n_bytes", "n_tokens").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert T.token_counts(d.limit(0), T.vocabulary()).count() == 0
