import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerlens.llm import bpe, scan

PATH = bpe.rank_file()


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=400, seed=5):
    rng = random.Random(seed)
    parts = ["'s", "'t", "'ll", "'ve", "'re", "'l", "'v", "'d", "'m", "'", "''", "s", "l", "e", "don", "The", "é", "ß", " ", "  ", "\n", "\t", " \n", " ", " ", "\x1c", "\x85", "!", "...", "12", "٣", "½", "字", "😀", "́", "x" * 40, "#", "<|endoftext|>", "　", "ⅷ", "_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_states_equal_a_sequential_walk():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 5, (4, 5)).astype(np.uint8)
    for n in (0, 1, 7, 255, 256, 257, 5000):
        s = rng.integers(0, 4, n).astype(np.uint8)
        want, at = [], 2
        for c in s:
            at = table[c, at]
            want.append(at)
        assert scan.states_after(s, table, 2, 16).tolist() == want


def test_ids_equal_tiktoken_and_decode_round_trip(own):
    enc, dec = bpe.Encoder(PATH), bpe.Decoder(PATH)
    batch = texts() + ["", "a" * 5000, "ab" * 3000 + "!" * 2000, " " * 3000 + "x", "é" * 500]
    batch += [chr(c) + "a" + chr(c) + "1 " + chr(c) for c in [*range(0x0, 0xD800, 7), *range(0xE000, 0x110000, 997)]]
    for got, t in zip(enc.encode_batch(batch), batch):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == own.encode_ordinary(t), repr(t)
        assert dec.decode(ids, dec.offsets(ids)) == t.encode()


def test_query_columns(spark, own):
    rows = [(1, "It's a test\n"), (None, None), (2, ""), (2, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = lambda t: np.array(own.encode_ordinary(t or ""), "<u4")
    want = sorted([(i, len(ids(t)), sha(ids(t).tobytes()), sha((t or "").encode())) for i, t in rows], key=repr)
    assert sorted(map(tuple, bpe.digests(d, PATH).collect()), key=repr) == want
    assert bpe.digests(d.limit(0), PATH).count() == 0
    apart = bpe.decode(bpe.encode(d, PATH), PATH).selectExpr("doc_id", "cast(decoded as string)").collect()
    assert sorted(map(tuple, apart), key=repr) == sorted([(i, t or "") for i, t in rows], key=repr)
