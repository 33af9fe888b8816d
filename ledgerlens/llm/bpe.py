"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised and uses no regular expression: code points become classes, a small automaton (which
only follows contractions) is run over all texts of a batch by an associative scan of its transition functions, and
array comparisons of classes and states give the boundaries. The slices go through a bounded cache of merged pieces;
a piece that isn't there is merged pair by pair by rank. Offsets (the end of each token in bytes) are kept; decoding
places each token's bytes by them.

The split is that of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

Defined results: a null or empty text has no ids and decodes to nothing; an empty table gives no rows; repeated rows
each give a row; special-token strings are plain text. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import slices, text_of
from ledgerlens.llm.scan import BREAK, BREAK_CHAR, LETTER, NUMBER, OTHER, SPACE, codepoint_classes, codepoints, states_after

#: Characters of text in a batch, and pieces in each of the two generations of a worker's cache.
BATCH = 1 << 19
CACHE = 120_000

# Symbols of the automaton: the five classes, and what contractions are made of.
_BLANK, _APOSTROPHE, _ONE, _L, _V, _R, _E = range(5, 12)
# States: anything else / after a blank / in a run of other marks / after an apostrophe that starts a slice / after 'l, 'v or 'r / a contraction is complete.
_REST, _AFTER_BLANK, _MARKS, _OPEN, _OPEN_L, _OPEN_VR, _DONE = range(7)


def _symbol_table() -> np.ndarray:
    """Symbol by code point."""
    out = codepoint_classes()
    for chars, symbol in ((" ", _BLANK), ("'", _APOSTROPHE), ("sdmt", _ONE), ("l", _L), ("v", _V), ("r", _R), ("e", _E)):
        out[[ord(c) for c in chars]] = symbol
    return out


def _transitions() -> np.ndarray:
    out = np.zeros((12, 7), np.uint8)
    out[[LETTER, NUMBER, SPACE, BREAK]] = _REST
    out[OTHER] = _MARKS
    out[_BLANK] = _AFTER_BLANK
    for state in range(7):
        out[_APOSTROPHE, state] = _MARKS if state in (_AFTER_BLANK, _MARKS, _OPEN) else _OPEN
    out[_ONE, _OPEN] = _DONE
    out[_L, _OPEN] = _OPEN_L
    out[_L, _OPEN_L] = _DONE
    out[[_V, _R], _OPEN] = _OPEN_VR
    out[_E, _OPEN_VR] = _DONE
    return out


_CLASS_OF = np.array([LETTER, NUMBER, SPACE, OTHER, BREAK, SPACE, OTHER, LETTER, LETTER, LETTER, LETTER, LETTER], np.uint8)


class PreTokenizer:
    def __init__(self):
        self.symbols, self.table = _symbol_table(), _transitions()

    def starts(self, text: str) -> np.ndarray:
        """Where slices of ``text`` start; separators between texts are slices too."""
        symbol = self.symbols[codepoints(text)]
        n = len(symbol)
        if not n:
            return np.zeros(0, np.int64)
        kind = _CLASS_OF[symbol]
        state = states_after(symbol, self.table)
        start = np.ones(n, bool)
        before, now = kind[:-1], kind[1:]
        same = before == now
        # a run of one class is one slice, as is a blank with the run after it
        start[1:] = ~same
        start[1:] &= ~((symbol[:-1] == _BLANK) & (now != SPACE) & (now != BREAK))
        # the last white space before a text goes on is a slice of its own (or joins the next run)
        last = np.zeros(n, bool)
        last[:-1] = (kind[:-1] == SPACE) & (now != SPACE) & (now != BREAK)
        start |= last
        start[kind == BREAK] = True
        # contractions: the letters join the apostrophe, and what follows starts anew
        done = np.flatnonzero(state == _DONE)
        if len(done):
            one = symbol[done] == _ONE
            start[np.where(one, done, done - 1)] = False
            start[done[done + 1 < n] + 1] = True
        return np.flatnonzero(start)


class Encoder:
    """Ranks of a tiktoken file and what a worker keeps of merged pieces."""

    def __init__(self, path: str):
        import base64

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pre, self.cache, self.older = PreTokenizer(), {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of lowest rank is merged, the leftmost first, until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n <= 24:
            none, get = 1 << 40, ranks.get
            parts = [piece[i:i + 1] for i in range(n)]
            pairs = [get(piece[i:i + 2], none) for i in range(n - 1)]
            while pairs:
                low = min(pairs)
                if low == none:
                    break
                i = pairs.index(low)
                parts[i] += parts.pop(i + 1)
                pairs.pop(i)
                if i:
                    pairs[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(pairs):
                    pairs[i] = get(parts[i] + parts[i + 1], none)
            return [ranks[p] for p in parts]
        end, back = [i + 1 for i in range(n)], [i - 1 for i in range(n)]  # parts as a linked list over positions
        alive = bytearray(b"\x01" * n)

        def rank(i):
            j = end[i]
            return ranks.get(piece[i:end[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != to:
                continue  # one of the two has been merged since
            j = end[i]
            alive[j], end[i] = 0, to
            if to < n:
                back[to] = i
            for k in (back[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        joined = BREAK_CHAR.join(texts)
        starts = self.pre.starts(joined)
        at = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])]
        if len(self.cache) > CACHE:  # the generation before serves pieces that come again
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        cache[BREAK_CHAR] = b""
        found = list(map(cache.get, pieces))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    p = pieces[i]
                    x = cache.get(p) or older.get(p)
                    if x is None:
                        x = np.array(self.merge(p.encode()), "<u4").tobytes()
                    if len(p) <= 64:
                        cache[p] = x
                    found[i] = x
        edges = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        edges[-1] = len(joined) + 1
        first = np.searchsorted(starts, edges).tolist()
        return [b"".join(found[a:b]) for a, b in zip(first, first[1:])]


class Decoder:
    """Bytes of the tokens in one pool."""

    def __init__(self, path: str):
        import base64

        with open(path, "rb") as f:
            tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        size = max(tokens, default=-1) + 1
        self.length = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.begin = np.r_[0, np.cumsum(self.length)][:-1]
        self.pool = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """End of each token in bytes."""
        return np.cumsum(self.length[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        length = self.length[ids]
        return self.pool[np.repeat(self.begin[ids] - (ends - length), length) + np.arange(int(ends[-1]))].tobytes()

    def decode_all(self, ids: list[bytes], ends: list[bytes]) -> list[bytes]:
        return [self.decode(np.frombuffer(i, "<u4"), np.frombuffer(e, "<u4").astype(np.int64)) for i, e in zip(ids, ends)]


_LOADED: dict = {}


def _load(kind, path: str):
    """One encoder or decoder by worker process and file."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode(docs: DataFrame, path: str, round_trip: bool = False) -> DataFrame:
    """doc_id, ids and ends (offsets of token ends in bytes), both as little-endian unsigned 32-bit integers.

    round_trip: also ``decoded``, the bytes that the ids and offsets give back, by the same worker.
    """

    def run(batches):
        import pyarrow as pa

        enc, dec = _load(Encoder, path), _load(Decoder, path)
        for b in slices(batches, "text", BATCH):
            ids = enc.encode_batch(b.column(1).to_pylist())
            ends = [dec.offsets(np.frombuffer(x, "<u4")).astype("<u4").tobytes() for x in ids]
            columns, names = [b.column(0), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], ["doc_id", "ids", "ends"]
            if round_trip:
                columns, names = [*columns, pa.array(dec.decode_all(ids, ends), pa.binary())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, ends binary" + ", decoded binary" * round_trip)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids, ends) with a column ``decoded``: the bytes of the text."""

    def run(batches):
        import pyarrow as pa

        dec = _load(Decoder, path)
        for b in slices(batches, "ids", 4 * BATCH):
            out = pa.array(dec.decode_all(b.column(1).to_pylist(), b.column(2).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])

    return encoded.select("doc_id", "ids", "ends").mapInArrow(run, "doc_id long, ids binary, ends binary, decoded binary")


def rank_file() -> str:
    """The public vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode(docs, path, round_trip=True)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), rank_file())
