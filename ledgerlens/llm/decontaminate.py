"""Benchmark decontamination with an Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z lower-cased, words cut at every ASCII byte that is no letter or
digit, one blank between words. A window is ``width`` consecutive words of an item (an item with fewer words, but not
none, is one window). All windows go into one automaton that runs once over each text, so overlapping and nested windows are all
found; the offsets of the hits lead back to words of the original text and to its characters.

The benchmark is read in blocks of at most ``block_bytes`` of window text (the automaton has about one node a byte of it),
each with an automaton of its own, so that what a task holds is bounded however large the benchmark or an item grows; an
item with more windows goes on in the next block, and a usual benchmark is one block. With more blocks, the hits of a
document are put together at the end.

Defined results: a null or empty text has no words and no hits; a null or wordless item has no windows; an item without
an id is matched and listed as the empty id; items with equal text are all listed; repeated document rows each give a row
(rows with the same doc_id and text are the same). Only ``doc_id`` and ``text``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, materialise, slices, text_of

WIDTH = 10
#: Bytes of windows in one automaton; a worker took 0.2 GB for 4 MiB and 0.8 GB for 16 MiB of random words.
BLOCK_BYTES = 8 << 20
#: Bytes by class: letters and digits stay (A-Z lower-cased, all bytes from 0x80 on are letters), the rest is a blank.
WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD).split()


def windows_of(words: list[bytes], width: int) -> Iterator[bytes]:
    for i in range(max(1, len(words) - width + 1) if words else 0):
        yield b" ".join(words[i:i + width])


class Matcher:
    """The automaton of the windows of some items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        import ahocorasick

        found: dict[bytes, list[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            for w in windows_of(words_of(text), width):
                at = found.setdefault(w, [])
                if not at or at[-1] != k:
                    at.append(k)
        self.automaton = ahocorasick.Automaton()
        for w, at in found.items():
            # every byte as one character; the blanks at the ends keep matches on whole words
            self.automaton.add_word(f" {w.decode('latin-1')} ", (len(w), at))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, text: str):
        """Number of words, merged word ranges [from, to) that are hit, positions of the items found."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], []
        found = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return len(words), [], []
        import numpy as np

        first = np.cumsum([0] + [len(w) + 1 for w in words])  # offset of each word in the joined words
        ranges, items = [], set()
        for end, (size, at) in found:
            items.update(at)
            # the match ends on the blank after its last word; the leading blank shifts all offsets by one
            ranges.append((int(np.searchsorted(first, end - 1 - size)), int(np.searchsorted(first, end - 1, side="right"))))
        merged: list[list[int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return len(words), merged, sorted(items)


def char_spans(text: str, ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word ranges."""
    if not ranges:
        return []
    raw = text.encode()
    flat = raw.translate(WORD)
    at, ends, starts = 0, [], []
    for w in flat.split():
        a = flat.index(w, at)
        at = a + len(w)
        starts.append(a)
        ends.append(at)
    return [(len(raw[:starts[a]].decode()), len(raw[:ends[b - 1]].decode())) for a, b in ranges]


def _pieces(text: str, width: int, block_bytes: int) -> Iterator[tuple[str, int]]:
    """An item's text in pieces that share no window but hold all, each with at most ``block_bytes`` of windows or one; and these bytes."""
    words = words_of(text)
    at = size = 0
    for i, w in enumerate(windows_of(words, width)):
        more = len(w) + 2  # the blanks at the ends
        if size and size + more > block_bytes:
            yield b" ".join(words[at:i + width - 1]).decode(), size
            at, size = i, 0
        size += more
    if size:
        yield b" ".join(words[at:]).decode(), size


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks by the bytes of their windows; one partition's rows at a time come to the driver."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_of().alias("text"))
    block, size, given = [], 0, False
    for r in rows.toLocalIterator():
        for text, more in _pieces(r["text"], width, block_bytes):
            if size and size + more > block_bytes:
                yield block
                block, size, given = [], 0, True
            block.append((r["item_id"], text))
            size += more
    if block or not given:  # an empty benchmark is one empty block
        yield block


_MATCHERS: dict = {}


def _matcher(shared, width: int) -> Matcher:
    """One automaton by worker process; an earlier one is let go."""
    items = shared.value
    if _MATCHERS.get("of") is not items:
        _MATCHERS.clear()
        _MATCHERS.update({"of": items, "matcher": Matcher(items, width)})
    return _MATCHERS["matcher"]


def find_hits(docs: DataFrame, items: list[tuple[str, str]], width: int = WIDTH) -> DataFrame:
    """All columns of ``docs`` and a column ``hits`` (underscores in front if taken) for one block of items: n_words, ranges of words, item ids, character spans."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # its windows have at most BLOCK_BYTES
    (out,) = fresh(docs, "hits")
    kind = "struct<n_words:bigint,ranges:array<array<bigint>>,items:array<string>,spans:array<array<bigint>>>"

    def run(batches):
        import pyarrow as pa

        form = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])
        m = _matcher(shared, width)
        for b in slices(batches, "text"):
            found = []
            for t in b.column(b.schema.get_field_index("text")).to_pylist():
                n, ranges, at = m.scan(t or "")
                found.append({"n_words": n, "ranges": ranges, "items": [m.items[i] for i in at], "spans": [list(x) for x in char_spans(t or "", ranges)]})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, form)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(None).cast(kind)).schema)


def _union(hits, name: str):
    """The ranges of several hits values put together."""
    rows = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h[name]))))
    return F.aggregate(rows, F.array().cast("array<array<bigint>>"), lambda done, r: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)[1] >= r[0]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], r[1])))),
    ).otherwise(F.concat(done, F.array(r))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), spans (characters of the original text), contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_key"))
    blocks = _blocks(benchmark, width, block_bytes)
    found = find_hits(rows, next(blocks), width).drop("text")
    more = [materialise(find_hits(rows, items, width).filter(F.size("hits.ranges") > 0).drop("text").distinct(), "hits") for items in blocks]
    if more:  # a benchmark of several blocks: few documents have hits, and those are put together by document
        own = reduce(DataFrame.unionByName, more).groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.collect_list("hits").alias("others"))
        found = (found.join(own, found.doc_id.eqNullSafe(own.id) & (found.text_key == own.key), "left")
                 .withColumn("all", F.concat(F.array("hits"), F.coalesce("others", F.array().cast("array<" + found.schema["hits"].dataType.simpleString() + ">"))))
                 .select("doc_id", F.struct(F.col("hits.n_words").alias("n_words"), _union(F.col("all"), "ranges").alias("ranges"),
                                            F.flatten(F.transform("all", lambda h: h["items"])).alias("items"), _union(F.col("all"), "spans").alias("spans")).alias("hits")))
    n_hit = F.aggregate("hits.ranges", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    items = F.array_sort(F.array_distinct(F.col("hits.items")))
    return found.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                        items.alias("item_ids"), F.col("hits.spans").alias("spans"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns."""
    (mark,) = fresh(docs, "hits")
    for k, items in enumerate(_blocks(benchmark, width, block_bytes)):
        if k:
            docs = materialise(docs, "clean")
        docs = find_hits(docs, items, width).filter(F.size(F.col(mark)["ranges"]) == 0).drop(mark)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, bench)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d),
hit AS (SELECT dw.rid, dw.i, s.size, win.item_id FROM dw JOIN sizes s ON dw.i + s.size - 1 <= len(dw.w)
        JOIN win ON win.size = s.size AND win.win = array_to_string(dw.w[dw.i:dw.i + s.size - 1], ' ')),
words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + size - 1)) AS j FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
