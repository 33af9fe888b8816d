"""SimHash near-dedup by pigeonhole blocks.

1. Fingerprint: 64 bits, a majority vote over the XXH64 values of all word shingles of the whole text.
2. Pigeonhole blocks: the 64 bits are cut into 2k blocks. Fingerprints that differ in at most k bits agree on at least
   k whole blocks, so each distinct fingerprint is listed once under every choice of k blocks (k = 3: 20 lists of 32
   bits) and only fingerprints with an equal key are held against each other.
3. Rows are range-partitioned and sorted by key, and a task walks its sorted rows: short runs of equal keys are compared
   bit by bit (popcount of xor) and give the links of a spanning forest, never all pairs. A run that is too long, or
   that may go on in another partition, is listed again under finer keys (2 of 5 blocks of its free bits). After two
   refinements at most 12 bits are free, so a run of distinct fingerprints has at most 4096 rows: every pair is covered,
   whatever the skew, and no key is gathered in one task.
4. Connected components of the links by alternating stars, each round written to the shared folder.

Equal fingerprints are one class; only classes are linked, and the classes' components go back to the documents with
the heaviest classes broadcast (bounded top-k). Nothing about all documents goes to the driver but counts.

Defined results: a null or wordless text has fingerprint zero and links like any other; an empty table gives no rows;
repeated rows each give a row; null ids count as largest; unrelated documents without an id or with the same id are
components of their own, and one of each stays. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, UPPER, join_unique, keep_rows, materialise, slices, text_of

SEED = 42
#: Longest run that a task compares itself; more than 2 ** MOST_FREE distinct fingerprints can't share a finest key.
MOST_FREE = 12
LONGEST_RUN = 1 << MOST_FREE
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of one text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWERED).split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n < 2:
        return xxh64_intdigest(b" ".join(words), SEED)
    ones = np.zeros(64, np.int64)
    join = b" ".join
    for at in range(0, n, 1 << 16):
        part = words[at:at + (1 << 16) + width - 1]
        m = len(part) - width + 1
        h = np.fromiter((xxh64_intdigest(s, SEED) for s in map(join, zip(*[part[i:i + m] for i in range(width)]))), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_key (a hash of the text) of every row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "text_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_key long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _choices(free: list[int], blocks: int, kept: int) -> list[int]:
    """Masks of every choice of ``kept`` out of ``blocks`` near-equal cuts of the bit positions ``free``."""
    cut = [free[len(free) * i // blocks:len(free) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(1 << p for c in some for p in c) for some in combinations(cut, kept)]


def _finer(mask: int, bits: int) -> list[int]:
    """Masks that any two values agreeing on ``mask`` and differing in at most ``bits`` bits share at least one of."""
    free = [p for p in range(64) if not mask >> p & 1]
    return [mask | m for m in _choices(free, bits + 2, 2)]


class _Forest:
    """Union-find over the rows of a batch, with labels compressed after each step."""

    def __init__(self, n: int):
        import numpy as np

        self.label = np.arange(n)

    def merge(self, u, v) -> list[int]:
        """Positions of the pairs (u[i], v[i]) that join two trees."""
        import numpy as np

        used, root = [], self.label
        for i in np.flatnonzero(root[u] != root[v]):
            a, b = int(u[i]), int(v[i])
            while root[a] != a:
                a = int(root[a])
            while root[b] != b:
                b = int(root[b])
            if a != b:
                root[max(a, b)] = min(a, b)
                used.append(i)
        while used and not np.array_equal(root, root[root]):
            root[:] = root[root]
        return used


def _links(run, fp, bits: int):
    """Spanning links (pairs of row numbers) within sorted runs; ``run`` is the run's number by row."""
    import numpy as np

    forest, out = _Forest(len(fp)), []
    step, at = 1, np.arange(len(fp))
    while True:
        at = at[at + step < len(fp)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            return out
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        out += [(int(near[i]), int(near[i]) + step) for i in forest.merge(near, near + step)]
        step += 1


def _walk(bits: int, whole: bool):
    """The task: rows (mask, key, fp) sorted; gives links (kind 0: a, b) and rows to refine (kind 1: mask, fp).

    whole: runs never go over the edge of a partition.
    """

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        held, first, again = None, True, None  # the last run so far; whether it is the partition's first; key of a run that is refined

        def give(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["kind", "a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            new = np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]
            start = np.r_[np.flatnonzero(new), rows.shape[1]]
            run = np.cumsum(new) - 1
            size = np.diff(start)
            refine = size > LONGEST_RUN
            if again is not None:
                refine[0] |= bool((rows[:2, 0] == again).all())
            if first and not whole:
                refine[0] = True
            last = len(size) - 1
            finished = run < last
            if refine[last]:  # no need to hold it
                again, finished[:] = rows[:2, -1].copy(), True
            else:
                again = None
            out = finished & refine[run]
            if out.any():
                yield give(1, rows[0][out], rows[2][out])
            own = np.flatnonzero(finished & ~refine[run] & (size[run] > 1))
            if len(own):
                fp = rows[2][own]
                pairs = _links(run[own], fp.view(np.uint64), bits)
                if pairs:
                    u, v = np.array(pairs).T
                    yield give(0, fp[u], fp[v])
            held = rows[:, ~finished]
            if not held.shape[1]:
                held = None
            first = first and last == 0
        if held is not None:
            if not whole:
                yield give(1, held[0], held[2])
            else:
                pairs = _links(np.zeros(held.shape[1], int), held[2].view(np.uint64), bits)
                if pairs:
                    u, v = np.array(pairs).T
                    yield give(0, held[2][u], held[2][v])

    return walk


def hamming_links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct values of ``fps.fp`` at most ``bits`` bits apart, enough to connect all that are linked."""
    spark = fps.sparkSession
    nothing = spark.createDataFrame([], "a long, b long")
    if bits < 1:
        return nothing
    first = F.explode(F.array(*[F.lit(_signed(m)) for m in _choices(list(range(64)), 2 * bits, bits)]))
    rows, links, level = fps.select(first.alias("mask"), "fp"), nothing, 0
    free = 32
    while True:
        last = free <= MOST_FREE
        keyed = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        if last:  # a key has at most LONGEST_RUN distinct values
            dealt = keyed.distinct().repartition("mask", "key")
        else:
            dealt = keyed.distinct().repartitionByRange("mask", "key", "fp") if level else keyed.repartitionByRange("mask", "key", "fp")
        found = materialise(dealt.sortWithinPartitions("mask", "key", "fp").mapInArrow(_walk(bits, last), "kind int, a long, b long"), f"links{level}")
        links = links.unionByName(found.filter("kind = 0").select("a", "b"))
        again = found.filter("kind = 1")
        if last or again.isEmpty():
            return links
        masks = [m for m in _masks_at(level, bits)]
        finer = spark.createDataFrame([(_signed(m), [_signed(x) for x in _finer(m, bits)]) for m in masks], "m long, finer array<long>")
        rows = (again.join(F.broadcast(finer), F.col("a") == F.col("m"))  # the masks are a fixed list, whatever the data
                .select(F.explode("finer").alias("mask"), F.col("b").alias("fp")))
        level += 1
        free = max(64 - x.bit_count() for x in _masks_at(level, bits))


def _masks_at(level: int, bits: int) -> list[int]:
    masks = _choices(list(range(64)), 2 * bits, bits)
    for _ in range(level):
        masks = sorted({x for m in masks for x in _finer(m, bits)})
    return masks


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of every node in ``links`` (a, b), by alternating large and small stars."""
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node with very many neighbours meets its least one by broadcast, so its edges stay where they are
        low = materialise(both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("low"), "n"), "low")
        large = materialise(join_unique(both.filter("v > u"), low, ["u"], "n", "inner").select(F.col("v").alias("u"), F.col("low").alias("v")), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")), "low")
        small = (join_unique(large, low, ["u"], "n", "inner").select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
                 .select("e.*").filter("u <> v").distinct())
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def simhash_groups(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, text_key, component_id (smallest doc_id reachable over links) and root.

    ``root``, the component's smallest fingerprint, tells components apart; a component_id may be null or shared.
    """
    rows = materialise(fingerprints(docs, width), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows")), "classes")
    found = components(hamming_links(classes.select("fp"), bits))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "least_id", "n_rows", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "ids")
    by_class = materialise(join_unique(rooted, ids, ["root"], "n", "inner").select("fp", "component_id", "root", "n_rows"), "components")
    return join_unique(rows, by_class, ["fp"], "n_rows", "inner").select("doc_id", "fp", "text_key", "component_id", "root")


def drop_near_copies(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the smallest doc_id."""
    found = materialise(simhash_groups(docs, width, bits), "near")
    one = (found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m"), F.count("*"))
           .select("m.doc_id", "m.text_key"))
    ties = not found.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()
    return keep_rows(docs, {"doc_id": F.col("doc_id").cast("long"), "text_key": F.xxhash64(text_of())}, one, ties)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
