"""Token-id files with Elias-Fano document boundaries.

Texts are encoded, each document gets an end id, and the ids of all documents follow one another in ascending doc_id
order. The files are Parquet rows, one per segment of that sequence, so any storage that Spark reaches can hold them:

    part, seq        place of the segment: range partition, number within it
    before           ids in the partition's segments before it
    n_docs, n_ids    documents and ids in it
    width            bytes per id (2 or 4)
    ids              the concatenated ids, little-endian
    ends_*           Elias-Fano of the documents' ends (in ids, within the segment)
    id_nulls, id_*   documents without a doc_id (they come first), and Elias-Fano of the other doc_ids

An Elias-Fano list of n values up to u takes about 2 + log2(u / n) bits per value: the low bits packed, the high bits as unary
gaps, and every 64th one's place as a hint for select. A document's offset, in lookups (``ids_of``) and in full scans alike, is
a select in its segment plus the ids of the segments before, which are summed by partition first (one row per range partition), so no table of 64-bit offsets exists.

Words are told apart by Arrow, some 4 MB of text at a time; only the different ones among them are looked up in a bounded cache or,
new ones many at a time, encoded by the tokenizers library. A tokenizer for which texts can't be cut at blanks (found out by trial and by
the file's rules) gets whole texts. A text of any length is encoded whole: its ids (2 or 4 bytes each) and its words are in one worker's
memory while it is (measured: 7 to 12 bytes per character, 30 where every word is a new one).

Defined results: a null or empty text has the end id only; rows that share a doc_id are ordered by a hash of the text;
rows without an id come first; an empty table gives no rows and an empty file. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import scratch, slices, text_of

END_ID = 1
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1 << 14
CACHE = 400_000
HINT = 64
#: Words that the library is asked for as one text.
TOGETHER = 512
#: Fixed value: what the last piece of a word ends with in such vocabularies.
WORD_END = "</w>"

SCHEMA = ("part int, seq int, before bigint, n_docs int, n_ids bigint, width int, ids binary, "
          "ends_low binary, ends_bits int, ends_high binary, ends_hints binary, id_nulls int, id_first bigint, id_low binary, id_bits int, id_high binary, id_hints binary")


class EliasFano:
    """A non-decreasing list of unsigned values."""

    def __init__(self, low: bytes, bits: int, high: bytes, hints: bytes, n: int):
        self.low, self.bits, self.high, self.hints, self.n = low, bits, high, hints, n
        self.words, self.places = np.frombuffer(high, "<u8").tolist(), np.frombuffer(hints, "<u4").tolist()

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(b"", 0, b"", b"", 0)
        bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros((int(places[-1]) // 64 + 1) * 64, np.uint8)
        marks[places] = 1
        return cls(low.tobytes(), bits, np.packbits(marks, bitorder="little").tobytes(), places[::HINT].astype("<u4").tobytes(), n)

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits)
        if not self.bits:
            return high
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.bits).reshape(self.n, self.bits).astype(np.uint64)
        return high | (low << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value number i: from the nearest hint, over whole words, then within one word."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = self.places[i // HINT]
        left, k = i % HINT, at // 64
        word = self.words[k] >> (at % 64) << (at % 64)
        while left >= (n := word.bit_count()):
            left -= n
            k += 1
            word = self.words[k]
        for _ in range(left):
            word &= word - 1
        place = k * 64 + (word & -word).bit_length() - 1
        start = i * self.bits
        low = int.from_bytes(self.low[start // 8:(start + self.bits + 7) // 8], "little") >> start % 8 & (1 << self.bits) - 1
        return (place - i) << self.bits | low


class WordEncoder:
    """Ids by the tokenizers library, word by word where the tokenizer allows."""

    #: The fixed rule of tokenizers that drop white space and cut letters from other marks.
    CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    #: Letters and the marks after them are words of their own and case is folded, so such a word is asked for in two parts.
    MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
    LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
    PLAIN = f"^[{LETTERS}]+[{re.escape(MARKS)}]*$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, "rb") as f:
            rules = json.load(f).get("pre_tokenizer") or {}
        first = (rules.get("pretokenizers") or [rules])[0]
        self.by_word = first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed" and first.get("pattern", {}).get("Regex") == self.CUTS and self._alike()
        words = self.tokenizer.get_vocab()
        self.width = 2 if max(words.values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith(WORD_END)]] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of letters: many are asked for as one text and told apart by the ids that end a word."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            some = words[at:at + TOGETHER]
            ids = np.array(self._ids([" ".join(some)])[0], self.kind)
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * self.width
            if len(ends) != len(some):
                return [np.array(x, self.kind).tobytes() for x in self._ids(words)]
            raw = ids.tobytes()
            ends = ends.tolist()
            out += [raw[x:y] for x, y in zip([0, *ends], ends)]
        return out

    def _alike(self) -> bool:
        a, b, both = self._ids(["Two", "words.", " Two\n words. "])
        words = self._ids(["Éa", "éa", "*|", "ÉA*|"])
        return a + b == both and words[0] == words[1] and words[1] + words[2] == words[3]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [np.frombuffer(x, self.kind).astype("<u4").tobytes() for x in self.packed(texts)]

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        """Packed ids of different parts: the library is asked for those that the cache doesn't have."""
        if len(self.cache) > CACHE:  # the generation before serves parts that come again
            self.cache, self.older = {"": b""}, self.cache
        out = list(map(self.cache.get, parts))
        plain, other = [], []
        for i in [i for i, x in enumerate(out) if x is None]:
            p = parts[i]
            if (known := self.older.get(p)) is not None:
                self.cache[p] = out[i] = known
            else:
                (other if p.strip(self.LETTERS) else plain).append(i)
        new = [np.array(x, self.kind).tobytes() for x in self._ids([parts[i] for i in other])] + self._word_ids([parts[i] for i in plain])
        for i, ids in zip(other + plain, new):
            out[i] = ids
            if len(parts[i]) <= 64:
                self.cache[parts[i]] = ids
        return out

    def packed(self, texts) -> list[bytes]:
        """Ids of each text (a list or an Arrow array), ``width`` bytes each.

        Words are told apart, cut in two and put together over Arrow arrays; only different parts become Python objects."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_word:
            return [np.array(x, self.kind).tobytes() for x in self._ids(texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        words = pc.split_pattern(pc.replace_substring(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "\n", " "), " ")
        coded = words.values.dictionary_encode()
        word = coded.dictionary
        plain = pc.match_substring_regex(word, self.PLAIN)
        heads = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(word, self.MARKS)), word)
        tails = pc.if_else(plain, pc.utf8_ltrim(word, self.LETTERS), "")
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        ids = pa.array(self._part_ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(parts.indices)
        ids = pc.binary_join_element_wise(ids[:len(word)], ids[len(word):], pa.scalar(b"", pa.large_binary())).take(coded.indices)
        edges = np.frombuffer(ids.buffers()[1], np.int64)[words.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [raw[x:y].tobytes() for x, y in zip(edges, edges[1:])]


_LOADED: dict = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


class _Segment:
    """Documents gathered for one row of the file."""

    def __init__(self, width: int):
        self.doc_ids, self.ids, self.n_ids, self.width = [], [], 0, width

    def add(self, doc_id, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.ids.append(ids)
        self.n_ids += len(ids) // self.width

    def full(self) -> bool:
        return self.n_ids >= SEGMENT_IDS or len(self.ids) >= SEGMENT_DOCS

    def row(self, part: int, seq: int, before: int) -> tuple:
        ends = EliasFano.of(np.cumsum([len(x) // self.width for x in self.ids]))
        known = [d for d in self.doc_ids if d is not None]
        first = known[0] if known else 0
        names = EliasFano.of(np.array([d - first for d in known], np.uint64))
        return (part, seq, before, len(self.ids), self.n_ids, self.width, b"".join(self.ids), ends.low, ends.bits, ends.high, ends.hints,
                len(self.doc_ids) - len(known), first, names.low, names.bits, names.high, names.hints)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write the segments to ``path``."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, before, names = TaskContext.get().partitionId(), 0, 0, [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")]
        enc = _encoder(tokenizer)
        end, segment = np.array([end_id], enc.kind).tobytes(), _Segment(enc.width)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(segment.row(part, seq, before), kinds)], names=names)

        for b in slices(batches, "text"):
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.packed(b.column(1))):
                segment.add(doc_id, ids + end)
                if segment.full():
                    yield flush()
                    before += segment.n_ids
                    segment, seq = _Segment(enc.width), seq + 1
        if segment.ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    (rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
     .mapInArrow(run, SCHEMA).write.parquet(path))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``: the ids of all segments before."""
    from pyspark.sql import Window

    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per range partition: the ids themselves are not shuffled
    earlier = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    return rows.join(F.broadcast(earlier), F.col("part") == F.col("p")).withColumn("start", F.col("earlier") + F.col("before")).drop("p", "earlier")


def _documents(row: dict):
    """doc_ids (None for missing ones), ids and ends of one segment."""
    ids = np.frombuffer(row["ids"], f"<u{row['width']}")
    ends = EliasFano(row["ends_low"], row["ends_bits"], row["ends_high"], row["ends_hints"], row["n_docs"]).all().astype(np.int64)
    names = EliasFano(row["id_low"], row["id_bits"], row["id_high"], row["id_hints"], row["n_docs"] - row["id_nulls"]).all()
    doc_ids = [None] * row["id_nulls"] + [int(x) + row["id_first"] for x in names]
    return doc_ids, ids, ends


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers).

    Each document's end is a select in its segment; its ids are a slice of the segment's, widened once."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                (row,) = b.slice(i, 1).to_pylist()
                names = EliasFano(row["id_low"], row["id_bits"], row["id_high"], row["id_hints"], row["n_docs"] - row["id_nulls"])
                doc_ids = [None] * row["id_nulls"] + [names.select(k) + row["id_first"] for k in range(names.n)]
                ends = EliasFano(row["ends_low"], row["ends_bits"], row["ends_high"], row["ends_hints"], row["n_docs"])
                edges = np.array([0, *map(ends.select, range(ends.n))], np.int64)
                # a document may be longer than a segment is meant to be; it comes alone then
                wide = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), ends.n, [None, pa.py_buffer(edges * 4), pa.py_buffer(wide)])
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(edges[:-1] + row["start"]), pa.array(np.diff(edges)), binary.cast(pa.binary())],
                                                 names=["doc_id", "start", "n_tokens", "ids"])

    return segments(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def ids_of(row: dict, i: int) -> np.ndarray:
    """Ids of document number i of one segment, by select only."""
    ends = EliasFano(row["ends_low"], row["ends_bits"], row["ends_high"], row["ends_hints"], row["n_docs"])
    return np.frombuffer(row["ids"], f"<u{row['width']}")[ends.select(i - 1) if i else 0:ends.select(i)]


def vocabulary() -> str:
    """The public vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary())
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
