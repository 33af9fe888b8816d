"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf, the SHA-256 of its fields. The leaves of a source ascend by doc_id and are folded 16 at a time until
one node, the source's subroot, remains; the subroots, in source order, are folded in the same way to the root. Leaves and nodes are
Parquet tables in the manifest's folder, so that rows can be proved later without the texts.

``prove`` asks for many proofs at once: the wanted leaves of a range partition know themselves; from their coordinates it
follows which nodes of which level their paths lack (the octopus: the union of siblings less what can be derived from
below). These coordinates, at most 30 a level for a partition that wants all its leaves, are looked up once in one
join, the interior nodes that several paths share are derived once, and every single proof is expanded in place.

Leaves are numbered by a range partition over (source, doc_id, leaf, row), so one source may hold any share of the rows;
a level's groups have at most 16 rows. What reaches the driver is the count of rows and sources and the longest source.

Defined results: a null field is ``-``; a null source comes first, a null doc_id comes first in its source and is never chosen
for tampering; rows with equal source and doc_id are ordered by leaf, repeated rows are leaves of their own beside one another; a source
with one row has its leaf as subroot, a table with one source has its subroot as root; an empty table gives no rows and has no
root. Texts of any length are hashed where they are scanned and never shuffled. Only the five fields are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, UPPER, materialise, scratch
from ledgerlens.operators.windows import row_number_global

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves (some 200 bytes each) that one task holds while it expands proofs.
ROWS_PER_PARTITION = 100_000
#: The tree over the subroots has this number in place of a source's.
TOP = -1


def encoded(col: str | Column) -> Column:
    """``-`` for null, else the value's bytes as text: count, colon, value."""
    s = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(fields: Sequence[str | Column] = FIELDS) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _fold_level(nodes: DataFrame) -> DataFrame:
    """The next level of all trees that have more than one node (columns tree, idx, total, node)."""
    run = F.array_sort(F.collect_list(F.struct("idx", "node")))
    return (nodes.filter("total > 1").groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx"))
            .agg(F.first(F.expr(f"(total + {FANOUT - 1}) div {FANOUT}")).alias("total"), run.alias("run"))
            .select("tree", "idx", "total", F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), ""), 256).alias("node")))


class Manifest:
    """The tables of a manifest at ``path``: leaves (part, source, tree, idx, doc_id, leaf), nodes (tree, level, idx, total, node), roots."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def root(self) -> str | None:
        """The root (one row); None for an empty table."""
        row = self.table("roots").first()
        return row and row["root"]

    def _levels(self, name: str, bottom: DataFrame, most: int) -> list[DataFrame]:
        """All levels above (and with) ``bottom``, written one by one; ``most`` is the size of the largest tree."""
        out, size = [bottom], most
        while size > 1:
            out.append(self._write(f"levels/{name}-{len(out)}", _fold_level(out[-1])))
            size = -(-size // FANOUT)
        return out

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None, key: str = "doc_id", group: str = "source", leaf: Column | None = None, extra: dict[str, Column] | None = None) -> Manifest:
        """Write the manifest of ``rows``; ``extra`` columns are kept beside each leaf."""
        spark, extra = rows.sparkSession, extra or {}
        self = cls(spark, path or scratch(spark, "manifest"))
        flat = materialise(rows.select(F.col(group).cast("string").alias("source"), F.col(key).cast("long").alias("doc_id"),
                                       (leaf_of() if leaf is None else leaf).alias("leaf"), *[c.alias(n) for n, c in extra.items()],
                                       F.monotonically_increasing_id().alias("row")), "leaves")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-flat.count() // ROWS_PER_PARTITION))
        order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]

        def number(batches):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc
            from pyspark import TaskContext

            part, last, at = TaskContext.get().partitionId(), None, 0
            for b in batches:
                if not b.num_rows:
                    continue
                source = b.column(0)
                # a run starts where the source changes; null sources come first
                same = pc.fill_null(pc.equal(source[1:], source[:-1]), False)
                both = pc.and_(pc.is_null(source[1:]), pc.is_null(source[:-1]))
                starts = np.concatenate([[True], ~pc.or_(same, both).to_numpy(zero_copy_only=False)])
                first = np.flatnonzero(starts)
                pos = np.arange(b.num_rows) - np.repeat(first, np.diff(np.append(first, b.num_rows)))
                if last is not None and last[0] == source[0].as_py():
                    pos[:first[1] if len(first) > 1 else None] += at
                last, at = (source[-1].as_py(),), int(pos[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(pos), *b.columns[:-1]],
                                                 names=["part", "pos", *b.schema.names[:-1]])

        kinds = ", ".join(f"{n} {t}" for n, t in flat.drop("row").dtypes)
        ranged = materialise(flat.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, f"part int, pos long, {kinds}"), "ranged")

        pieces = ranged.groupBy("source", "part").agg(F.count("*").alias("n"))
        names = materialise(row_number_global(pieces.select("source").distinct(), [F.col("source").asc_nulls_first()], "tree"), "trees")
        # a source has at most one row a range partition here
        of = Window.partitionBy("source")
        starts = pieces.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("n").over(of.orderBy("part")) - F.col("n")).alias("lo"), F.sum("n").over(of).alias("total"))
        starts = materialise(starts.join(names, starts.s.eqNullSafe(names.source)).select("s", "p", "lo", "total", (F.col("tree") - 1).alias("tree")), "starts")
        leaves = self._write("leaves", ranged.join(starts, (ranged.part == starts.p) & ranged.source.eqNullSafe(starts.s))
                             .select("part", "source", "tree", (F.col("lo") + F.col("pos")).alias("idx"), "total", "doc_id", "leaf", *extra))
        size = starts.agg(F.max("total").alias("most"), F.countDistinct("tree").alias("trees")).first()
        low = self._levels("source", leaves.select("tree", "idx", "total", F.col("leaf").alias("node")), size["most"] or 0)
        done = low[0].filter("total = 1")
        for level in low[1:]:
            done = done.unionByName(level.filter("total = 1"))
        subroots = self._write("subroots", done.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(size["trees"]).cast("long").alias("total"), "node"))
        high = self._levels("top", subroots, size["trees"])
        nodes = None
        for levels in (low, high):
            for k, level in enumerate(levels):
                one = level.select("tree", F.lit(k).alias("level"), "idx", "total", "node")
                nodes = one if nodes is None else nodes.unionByName(one)
        self._write("nodes", nodes)
        self._write("roots", high[-1].select(F.col("node").alias("root"), F.lit(size["trees"]).cast("long").alias("trees")))
        return self

    def wanted(self) -> DataFrame:
        """All leaves; ``prove`` takes any rows of it."""
        return self.table("leaves")

    def prove(self, wanted: DataFrame, claim: str = "leaf", whole: bool = False) -> DataFrame:
        """Proofs of the rows ``wanted`` (of ``wanted()``), folded from the digest in column ``claim``.

        Returns source, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and with ``whole`` the proof:
        by level the position in the run and the siblings' digests.
        """
        trees = self.table("roots").select("root", F.col("trees").alias("n_trees"))  # one row
        known = wanted.crossJoin(F.broadcast(trees)).select("part", "tree", "idx", "total", "n_trees", "root", "source", "doc_id", "leaf", F.col(claim).alias("claim"))
        known = materialise(known, "wanted")

        def lacking(group):
            import numpy as np
            import pyarrow as pa

            out = []
            for tree, total, idx in _by_tree(group):
                out += [(tree, level, i) for level, i in missing(idx, total)]
            out += [(TOP, level, i) for level, i in missing(np.unique(group["tree"].to_numpy()), group["n_trees"][0].as_py())]
            columns = list(zip(*out)) or [(), (), ()]
            return pa.table({"part": pa.array([group["part"][0].as_py()] * len(out), pa.int32()), "tree": pa.array(columns[0], pa.int64()),
                             "level": pa.array(columns[1], pa.int32()), "idx": pa.array(columns[2], pa.int64())})

        asked = known.select("part", "tree", "idx", "total", "n_trees").groupBy("part").applyInArrow(lacking, "part int, tree long, level int, idx long")
        got = asked.join(self.table("nodes").select("tree", "level", "idx", "node"), ["tree", "level", "idx"])
        kinds = "source string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        kinds += ", proof array<struct<pos:int,siblings:array<string>>>" if whole else ""

        def expand(leaves, nodes):
            if not leaves.num_rows:
                return _no_proofs(whole)
            fetched: dict = {}
            for tree, level, idx, node in zip(*(nodes[c].to_pylist() for c in ("tree", "level", "idx", "node"))):
                fetched.setdefault(tree, {})[(level, idx)] = node
            return _expanded(leaves, fetched, whole)

        return known.groupBy("part").cogroup(got.groupBy("part")).applyInArrow(expand, kinds)


def _by_tree(group):
    """(tree, total, sorted distinct leaf numbers) of the sources in a partition's rows."""
    import numpy as np

    tree, idx, total = (group[c].to_numpy() for c in ("tree", "idx", "total"))
    order = np.lexsort((idx, tree))
    tree, idx, total = tree[order], idx[order], total[order]
    cuts = np.flatnonzero(np.diff(tree)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(tree)]):
        yield int(tree[a]), int(total[a]), np.unique(idx[a:z])


def missing(known, total: int) -> list[tuple[int, int]]:
    """The octopus: (level, index) of the nodes that the paths of the ``known`` leaves need and can't derive from below."""
    import numpy as np

    out, level = [], 0
    while total > 1:
        runs = np.unique(known // FANOUT)
        need = (runs[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        out += [(level, int(i)) for i in np.setdiff1d(need[need < total], known, assume_unique=True)]
        known, total, level = runs, -(-total // FANOUT), level + 1
    return out


def paths(known: dict[int, str], total: int, fetched: dict[tuple[int, int], str]) -> tuple[str, list[dict]]:
    """Root of a tree, and for each level the text of every run: (level below the root) -> run number -> digests in order.

    ``known`` are the wanted leaves, ``fetched`` the nodes named by ``missing``; each shared interior node is derived once.
    """
    level, runs_by_level = 0, []
    while total > 1:
        runs = {}
        for run in sorted({i // FANOUT for i in known}):
            ids = range(run * FANOUT, min(total, (run + 1) * FANOUT))
            runs[run] = [known[i] if i in known else fetched[(level, i)] for i in ids]
        runs_by_level.append(runs)
        known = {run: digest("".join(nodes)) for run, nodes in runs.items()}
        total, level = -(-total // FANOUT), level + 1
    (root,) = known.values()
    return root, runs_by_level


def steps(idx: int, runs_by_level: list[dict]) -> list[tuple[int, list[str]]]:
    """One leaf's proof: by level its position in the run and the run's other digests."""
    out = []
    for runs in runs_by_level:
        run, pos = divmod(idx, FANOUT)
        out.append((pos, runs[run][:pos] + runs[run][pos + 1:]))
        idx = run
    return out


def fold(leaf: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and a proof lead to."""
    for pos, siblings in proof:
        leaf = digest("".join([*siblings[:pos], leaf, *siblings[pos:]]))
    return leaf


def _kinds(whole: bool):
    import pyarrow as pa

    names = ["source", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kinds = {n: pa.string() for n in names} | {"doc_id": pa.int64(), "verified": pa.bool_()}
    if whole:
        kinds["proof"] = pa.list_(pa.struct([("pos", pa.int32()), ("siblings", pa.list_(pa.string()))]))
    return [(n, kinds[n]) for n in ("source", "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if whole else []))]


def _no_proofs(whole: bool):
    import pyarrow as pa

    return pa.table({n: pa.array([], k) for n, k in _kinds(whole)})


def _expanded(leaves, fetched: dict, whole: bool):
    """Every row's proof; what the leaves of a run share (their way above it) is joined once."""
    import pyarrow as pa

    rows = leaves.select(["tree", "idx", "total", "n_trees", "root", "source", "doc_id", "leaf", "claim"]).to_pylist()
    trees: dict = {}
    for r in rows:
        trees.setdefault(r["tree"], (r["total"], {}))[1][r["idx"]] = r["leaf"]
    built = {t: paths(known, total, fetched.get(t, {})) for t, (total, known) in trees.items()}
    _, top = paths({t: root for t, (root, _) in built.items()}, rows[0]["n_trees"], fetched.get(TOP, {}))
    above: dict = {}  # (tree, run of leaves) -> proof above the run, and its siblings as one text
    out = []
    for r in rows:
        subroot, runs = built[r["tree"]]
        run, pos = divmod(r["idx"], FANOUT)
        if (r["tree"], run) not in above:
            rest = (steps(run, runs[1:]) if runs else []) + steps(r["tree"], top)
            above[(r["tree"], run)] = rest, "".join("".join(s) for _, s in rest)
        rest, text = above[(r["tree"], run)]
        own = [(pos, runs[0][run][:pos] + runs[0][run][pos + 1:])] if runs else []
        folded = fold(r["claim"], own + rest)
        row = (r["source"], r["doc_id"], r["leaf"], subroot, r["root"], digest("".join("".join(s) for _, s in own) + text), folded, folded == r["root"])
        out.append((*row, [{"pos": p, "siblings": s} for p, s in own + rest]) if whole else row)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(_kinds(whole), zip(*out))})


def lower_ascii(col: str | Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of([*FIELDS[:-1], lower_ascii(F.col("text"))]))
    manifest = Manifest.build(docs, extra={"tampered": tampered})
    proofs = manifest.prove(manifest.wanted().withColumn("claim", F.coalesce("tampered", "leaf")), "claim")
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql() -> str:
    """DuckDB: six levels a source and six for the sources (16 million rows each), written level by level."""
    enc = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
    upper = f"translate(text, '{UPPER}', '{LOWER}')"
    leaf = " || ".join(enc.format(c) for c in FIELDS)
    tampered = " || ".join(enc.format(upper if c == "text" else c) for c in FIELDS)
    depth = 6
    parts = [f"""WITH crc_table AS (SELECT list(list_reduce(list_concat([i], [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
crc AS (SELECT DISTINCT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda h: ascii(h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, crc_table WHERE doc_id IS NOT NULL),
d AS MATERIALIZED (SELECT d.doc_id, source, sha256({leaf}) AS leaf, CASE WHEN crc % 5 = 0 THEN sha256({tampered}) ELSE sha256({leaf}) END AS claim FROM documents d LEFT JOIN crc USING (doc_id)),
s0 AS MATERIALIZED (SELECT doc_id, source, leaf, claim, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf AS x FROM d)"""]

    def level(a: str, k: int, rows: str, tree: str) -> str:
        """Levels k + 1 of a tree from level k: runs of 16 are folded while several nodes remain."""
        return (f"{a}{k + 1} AS MATERIALIZED (SELECT {tree}, i // 16 AS i, (n + 15) // 16 AS n, sha256(string_agg(x, '' ORDER BY i)) AS x FROM {rows} WHERE n > 1 GROUP BY {tree}, i // 16, (n + 15) // 16)")

    parts += [level("s", k, f"s{k}", "source") for k in range(depth)]
    parts.append("t0 AS MATERIALIZED (SELECT 0 AS top, source, x, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM ("
                 + " UNION ALL ".join(f"SELECT source, x FROM s{k} WHERE n = 1" for k in range(depth + 1)) + "))")
    parts += [level("t", k, f"t{k}", "top") for k in range(depth)]
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT x AS root FROM t{k} WHERE n = 1" for k in range(depth + 1)) + ")")
    # w: every leaf on its way up: j, its number at this level; h, the folded digest; p, the siblings so far
    parts.append("w0 AS MATERIALIZED (SELECT rid, doc_id, source, leaf, i AS j, claim AS h, '' AS p FROM s0)")
    step = 0

    def climb(a: str, k: int, on: str) -> str:
        nonlocal step
        step += 1
        return (f"w{step} AS MATERIALIZED (SELECT rid, doc_id, w.source, leaf, CASE WHEN m THEN j // 16 ELSE j END AS j, "
                f"CASE WHEN m THEN sha256(array_to_string(list_concat(b, [h], c), '')) ELSE h END AS h, CASE WHEN m THEN p || array_to_string(list_concat(b, c), '') ELSE p END AS p FROM ("
                f"SELECT w.*, r.xs IS NOT NULL AS m, r.xs[1:(j % 16)::BIGINT] AS b, r.xs[(j % 16 + 2)::BIGINT:] AS c FROM w{step - 1} w LEFT JOIN "
                f"(SELECT {on or '0 AS one'}, i // 16 AS run, list(x ORDER BY i) AS xs FROM {a}{k} WHERE n > 1 GROUP BY ALL) r ON {'w.source IS NOT DISTINCT FROM r.source AND ' if on else ''}w.j // 16 = r.run) w)")

    parts += [climb("s", k, "source") for k in range(depth)]
    step += 1
    parts.append(f"w{step} AS MATERIALIZED (SELECT rid, doc_id, w.source, leaf, t0.i AS j, h, p, t0.x AS subroot FROM w{step - 1} w JOIN t0 ON w.source IS NOT DISTINCT FROM t0.source)")
    top = []
    for k in range(depth):
        top.append(climb("t", k, "").replace("SELECT rid, doc_id, w.source, leaf, CASE", "SELECT rid, doc_id, w.source, leaf, subroot, CASE", 1))
    parts += top
    return ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, h AS folded_root, h = root AS verified FROM w{step}, root"


SQL = _sql()
