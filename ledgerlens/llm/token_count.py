"""Token counts by a finite-state cutter and a table of words.

The tokenizer's JSON gives a deterministic transducer that cuts words and a counter of their tokens.

* The cutter reads one symbol class per code point and annotates transitions with "a word starts here". It is run by an
  associative scan: blocks of a text are reduced to functions from entry state to exit state, and these are composed in doubling
  steps (``scan.states_after``).
* The counter is a table from words to the number of tokens that byte-pair merging emits for them. It is no automaton
  over characters with states of its own: a word is merged when first met, and its count is kept in two bounded generations.

Texts of more than ``CHUNK`` code points are cut into chunks of ``CHUNK`` code points, at any place, and every chunk becomes a state map: from the text
still open before it (the part of a word since the last blank) to the tokens emitted and the text open after it. A chunk
with a blank is (head, count, tail): it counts open + head, adds its own count and leaves its tail; one without leaves
open + chunk. Composition is associative, so chunks are counted by any task in any order, and the maps of a document are
composed pairwise in a tree, in one call a document. A shorter text is counted at once, without maps.

The counts are those of the tokenizers library without added tokens: special-token strings inside a text are one token
each.

Defined results: a null or empty text has no bytes and no tokens; an empty table gives no rows; repeated rows each give
a row. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import slices, text_of
from ledgerlens.llm.scan import BREAK, BREAK_CHAR, LETTER, NUMBER, OTHER, SPACE, codepoint_classes, codepoints, states_after

CHUNK = 1 << 16
BATCH = 1 << 20
CACHE = 250_000
LIMIT = 2048
#: Stands for a special token inside a text; no valid text holds it.
SPECIAL_CHAR = "\ud801"

# Symbols: the five classes, the special token, and what contractions are made of.
_SPECIAL, _APOSTROPHE, _ONE, _L, _V, _R, _E = range(5, 12)
# States: anything else / in a run of other marks / after an apostrophe that starts a word / after 'l, 'v or 'r / a contraction is complete.
_REST, _MARKS, _OPEN, _OPEN_L, _OPEN_VR, _DONE = range(6)
_CLASS_OF = np.array([LETTER, NUMBER, SPACE, OTHER, BREAK, BREAK, OTHER, LETTER, LETTER, LETTER, LETTER, LETTER], np.uint8)


class Compiled:
    """The transducers of one tokenizer file."""

    #: The rules that this compiles: fixed values of the file format.
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rules = json.load(f)
        model = rules["model"]
        steps = [n["type"] for n in rules["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != self.NORMALIZERS or rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != self.CUTS:
            raise ValueError("this tokenizer's rules are not compiled here")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary = frozenset(model["vocab"])
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.specials = [t["content"] for t in rules["added_tokens"]]
        # the printable stand-ins of bytes: printable Latin-1 stands for itself, the rest follows from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.byte_chars = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.symbols = codepoint_classes()
        for chars, symbol in (("'", _APOSTROPHE), ("sdmt", _ONE), ("l", _L), ("v", _V), ("r", _R), ("e", _E), (SPECIAL_CHAR, _SPECIAL)):
            self.symbols[[ord(c) for c in chars]] = symbol
        self.table = np.zeros((12, 6), np.uint8)
        self.table[OTHER] = _MARKS
        for state in range(6):
            self.table[_APOSTROPHE, state] = _MARKS if state in (_MARKS, _OPEN) else _OPEN
        self.table[_ONE, _OPEN] = _DONE
        self.table[_L, _OPEN] = _OPEN_L
        self.table[_L, _OPEN_L] = _DONE
        self.table[[_V, _R], _OPEN] = _OPEN_VR
        self.table[_E, _OPEN_VR] = _DONE
        self.words: dict[str, int] = {SPECIAL_CHAR: 1}
        self.older: dict[str, int] = {}

    def emitted(self, word: str) -> int:
        """Tokens that the counter emits on the transition of one word."""
        chars = [self.byte_chars[b] for b in word.encode()]
        chars[-1] += self.suffix
        parts = [c for c in chars if c in self.vocabulary]
        n = len(parts)
        none, ranks = len(self.ranks), self.ranks
        if n > 64:
            return self._emitted_long(parts)
        pairs = [ranks.get(p, none) for p in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(pairs):
                pairs[i] = ranks.get((parts[i], parts[i + 1]), none)
        return len(parts)

    def _emitted_long(self, parts: list[str]) -> int:
        """The same with a heap, for words of any length."""
        import heapq

        n, count = len(parts), len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            count -= 1
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return count

    def normalised(self, text: str) -> str:
        if "<" in text:
            for s in self.specials:
                text = text.replace(s, SPECIAL_CHAR)
        if text.isascii():
            return text.lower()
        # one letter is lowered without regard to its neighbours, so a final sigma is as any other
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text: words found by the cutter, the counter's annotations summed by prefix."""
        if not texts:
            return np.zeros(0, np.int64)
        texts = [self.normalised(t) for t in texts]
        joined = BREAK_CHAR.join(texts)
        symbol = self.symbols[codepoints(joined)]
        n = len(symbol)
        if not n:
            return np.zeros(len(texts), np.int64)
        kind = _CLASS_OF[symbol]
        state = states_after(symbol, self.table)
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == BREAK)
        done = np.flatnonzero(state == _DONE)
        if len(done):  # the letters of a contraction join the apostrophe, and what follows starts anew
            start[np.where(symbol[done] == _ONE, done, done - 1)] = False
            start[done[done + 1 < n] + 1] = True
        at = np.flatnonzero(start)
        to = np.r_[at[1:], n]
        real = (kind[at] != SPACE) & ((kind[at] != BREAK) | (symbol[at] == _SPECIAL))
        at, to = at[real], to[real]
        if len(self.words) > CACHE:
            self.words, self.older = {SPECIAL_CHAR: 1}, self.words
        words, older = self.words, self.older
        found = [joined[a:b] for a, b in zip(at.tolist(), to.tolist())]
        counts = list(map(words.get, found))
        if None in counts:
            for i, c in enumerate(counts):
                if c is None:
                    w = found[i]
                    c = words.get(w)
                    if c is None:
                        c = older.get(w)
                        if c is None:
                            c = self.emitted(w)
                        if len(w) <= 64:
                            words[w] = c
                    counts[i] = c
        edges = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        total = np.r_[0, np.cumsum(np.array(counts, np.int64))]
        return np.diff(total[np.searchsorted(at, edges)])

    def chunk_maps(self, chunks: list[str]) -> list[tuple[str, int, str, bool]]:
        """State maps (head, count, tail, has a blank) of chunks. Blanks are what no rule looks across: space and line feed."""
        cuts = []
        for c in chunks:
            ends = [i for i in (c.find(" "), c.find("\n")) if i >= 0]
            cuts.append((min(ends), max(c.rfind(" "), c.rfind("\n"))) if ends else None)
        inner = self.count([c[x[0]:x[1] + 1] if x else "" for c, x in zip(chunks, cuts)])
        return [(c[:x[0]], int(k), c[x[1] + 1:], True) if x else (c, 0, "", False) for c, x, k in zip(chunks, cuts, inner)]

    def compose(self, maps: list[tuple[str, int, str, bool]]) -> int:
        """Tokens of a text from its chunks' maps in order: pairs are composed in a tree, then applied to nothing open."""
        if not maps:
            return 0
        while len(maps) > 1:
            pairs = list(zip(maps[::2], maps[1::2]))
            met = self.count([a[2] + b[0] if a[3] and b[3] else "" for a, b in pairs]).tolist()
            out = []
            for (a, b), k in zip(pairs, met):
                if a[3] and b[3]:
                    out.append((a[0], a[1] + k + b[1], b[2], True))
                elif a[3]:
                    out.append((a[0], a[1], a[2] + b[0], True))
                else:
                    out.append((a[0] + b[0], b[1], b[2], b[3]))
            maps = out + ([maps[-1]] if len(maps) % 2 else [])
        head, count, tail, _ = maps[0]
        return count + int(self.count([head, tail]).sum())


_LOADED: dict = {}


def _compiled(path: str) -> Compiled:
    if path not in _LOADED:
        _LOADED[path] = Compiled(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""

    def count_texts(batches):
        import pyarrow as pa

        own = _compiled(path)
        for b in slices(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.count(b.column(2).to_pylist()))], names=["doc_id", "n_bytes", "n_tokens"])

    def map_chunks(batches):
        import pyarrow as pa

        own = _compiled(path)
        for b in slices(batches, "text", BATCH):
            maps = zip(*own.chunk_maps(b.column(4).to_pylist()))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(list(c), k) for c, k in zip(maps, kinds))],
                                             names=["doc_id", "text_key", "chunk", "n_bytes", "head", "n", "tail", "blank"])

    def put_together(batches):
        import pyarrow as pa

        own = _compiled(path)
        for b in batches:
            counts = [own.compose([(m["head"], m["n"], m["tail"], m["blank"]) for m in maps]) for maps in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), b.column(2)], names=["doc_id", "n_bytes", "n_tokens", "copies"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    # a text of one chunk: its map applied to nothing open
    short = rows.filter(F.length("text") <= chunk).select("doc_id", n_bytes, "text").mapInArrow(count_texts, "doc_id long, n_bytes long, n_tokens long")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int")), lambda i: F.substring("text", i * chunk + 1, F.lit(chunk)))
    chunks = rows.filter(F.length("text") > chunk).select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(cut).alias("chunk", "text"))
    mapped = (chunks.select("doc_id", "text_key", "chunk", n_bytes, "text")
              .mapInArrow(map_chunks, "doc_id long, text_key long, chunk int, n_bytes long, head string, n long, tail string, blank boolean"))
    # maps are small (what is open at the ends); those of a document meet, repeated rows as one with a count
    by_doc = (mapped.groupBy("doc_id", "text_key", "chunk")
              .agg(F.first("n_bytes").alias("n_bytes"), F.first(F.struct("head", "n", "tail", "blank")).alias("m"), F.count("*").alias("copies"))
              .groupBy("doc_id", "text_key")
              .agg(F.sum("n_bytes").alias("n_bytes"), F.first("copies").alias("copies"),
                   F.sort_array(F.collect_list(F.struct("chunk", "m.head", "m.n", "m.tail", "m.blank"))).alias("maps"))
              .select("doc_id", "n_bytes", "copies", "maps"))
    long = (by_doc.mapInArrow(put_together, "doc_id long, n_bytes long, n_tokens long, copies long")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "n_bytes", "n_tokens"))
    return short.unionByName(long)


def vocabulary() -> str:
    """The public vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
