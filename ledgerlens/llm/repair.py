"""Conversation structure repair: the cheapest edits that make a conversation's turns alternate, with their audit.

Each row of a conversation is kept (K), given another role (R) or deleted (D), and empty turns may be inserted (I), so that the initials
of the roles read ``(s?(ua)+)?``. A dynamic programme goes over the rows in order with the four states of that
expression. Of equally cheap edits the ASCII-least audit string wins, so states have to compare whole histories: an edit prefix is a linked
node (letter, parent, rolling hash, a jump link for binary lifting), prefixes are shared, and two of them are compared by
searching their longest common prefix through the jumps with hashes; equal hashes are verified letter by letter, with
what was found equal remembered, so that each pair of nodes is walked once.

Two equally cheap histories at the same row and state never are prefixes of one another (the longer one has inserts more), so a
choice made at a row stands whatever follows. The same holds for a piece of a conversation from a state before to a state
after it: a piece is summed up by 16 costs and 16 ranks of its audits. That is how a conversation of any length is handled: rows are
range-sorted by (conv_id, turn, role, hash, row) and conversations inside a range partition are finished there; those at
its edges are solved piece by piece, the pieces' sums are composed (one row a partition), and each piece is then traced between its
two states. Repeats across pieces are found by a grouped join on digests. Only SHA-256 over a whole repaired conversation is sequential by
its nature: it runs over the pieces in order as a stream, one piece in memory.

Defined results: rows without conv_id are one conversation; a null role or text is one space; a null turn comes first; rows of equal turn are ordered
by role, then by a hash of the text; repeated rows are duplicates; an empty role has no initial and can't be kept; texts of any length pass whole;
an empty table gives no rows. Only conv_id, turn, role and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise, planned_partitions, slices

#: White space, sentence ends and legal neighbours of the contract; costs of edits.
SPACE, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. What follows by initial, and by a new or inserted turn.
STATES = 4
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
NAME = ("user", "user", "assistant", "user")
ACCEPTED = (0, 3)
#: Bytes of text that a range partition is planned for.
PARTITION_BYTES = 64 << 20
MODULUS, BASE = (1 << 61) - 1, 911382323


class Audits:
    """Edit prefixes as linked nodes; node 0 is the empty one."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.parent, self.jump, self.depth, self.letter, self.hash = [0], [0], [0], [""], [0]
        self.same: dict[int, int] = {}  # verified equal nodes, as union-find links

    def add(self, node: int, letter: str) -> int:
        jump = self.jump[node]
        # skew-binary lifting: two jumps of one length are followed by one over both
        twice = self.depth[node] - self.depth[jump] == self.depth[jump] - self.depth[self.jump[jump]]
        self.parent.append(node)
        self.jump.append(self.jump[jump] if twice else node)
        self.depth.append(self.depth[node] + 1)
        self.letter.append(letter)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % self.modulus)
        return len(self.parent) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.parent[node]
        return node

    def _find(self, x: int) -> int:
        root = x
        while root in self.same:
            root = self.same[root]
        while x != root:
            self.same[x], x = root, self.same[x]
        return root

    def equal(self, x: int, y: int) -> bool:
        """Do two nodes of one depth stand for one string? Equal hashes are checked by their letters."""
        if x == y:
            return True
        if self.hash[x] != self.hash[y]:
            return False
        walked = []
        while (a := self._find(x)) != (b := self._find(y)):
            if self.letter[x] != self.letter[y]:
                return False  # a collision
            walked.append((a, b))
            x, y = self.parent[x], self.parent[y]
        for a, b in walked:
            a, b = self._find(a), self._find(b)
            if a != b:
                self.same[a] = b
        return True

    def less(self, x: int, y: int) -> bool:
        """Is x's string ASCII-less than y's (a prefix is less)?"""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.equal(a, b):
            return self.depth[x] < self.depth[y]
        while not self.equal(self.parent[a], self.parent[b]):  # the longest common prefix
            if self.equal(self.jump[a], self.jump[b]):
                a, b = self.parent[a], self.parent[b]
            else:
                a, b = self.jump[a], self.jump[b]
        return self.letter[a] < self.letter[b]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))


Way = tuple[int, int]  # cost, node


def _better(audits: Audits, old: Way | None, cost: int, base: int, letter: str) -> Way:
    """The better of ``old`` and the way of ``cost`` that adds ``letter`` to ``base``."""
    if old is not None and old[0] < cost:
        return old
    new = audits.add(base, letter)
    return old if old is not None and old[0] == cost and not audits.less(new, old[1]) else (cost, new)


def _inserted(audits: Audits, ways: list[Way | None]) -> None:
    """Turns inserted between two rows: one or two of them; more never pay."""
    for before, after in ((0, 2), (1, 2), (3, 2), (2, 3)):
        if ways[before] is not None:
            ways[after] = _better(audits, ways[after], ways[before][0] + INSERT, ways[before][1], "I")


def solve(rows: list[tuple[str, str]], state: int, audits: Audits) -> list[Way | None]:
    """The best way from ``state`` over ``rows`` (initial, fault) to each state."""
    ways: list[Way | None] = [None] * STATES
    ways[state] = (0, 0)
    _inserted(audits, ways)
    for initial, fault in rows:
        after: list[Way | None] = [None] * STATES
        for s, way in enumerate(ways):
            if way is None:
                continue
            cost, node = way
            after[s] = _better(audits, after[s], cost + DELETE, node, "D")
            if fault in ("blank", "duplicate"):
                continue
            more = TRUNCATED if fault == "truncated" else 0
            if initial in FOLLOW[s]:
                to = FOLLOW[s][initial]
                after[to] = _better(audits, after[to], cost + KEEP + more, node, "K")
            after[NEXT[s]] = _better(audits, after[NEXT[s]], cost + REROLE + more, node, "R")
        ways = after
        _inserted(audits, ways)
    return ways


def best_end(ways: list[Way | None], audits: Audits) -> int:
    """The accepted state with the best way (state 0 always has one: delete all)."""
    ends = [s for s in ACCEPTED if ways[s] is not None]
    best = ends[0]
    for s in ends[1:]:
        if ways[s][0] < ways[best][0] or (ways[s][0] == ways[best][0] and audits.less(ways[s][1], ways[best][1])):
            best = s
    return best


def summed(rows: list[tuple[str, str]]) -> tuple[list[int], list[int]]:
    """Costs (-1: no way) and ranks of the audits, from state (four each) to state."""
    costs, ranks = [], []
    for state in range(STATES):
        audits = Audits()
        ways = solve(rows, state, audits)
        costs += [-1 if w is None else w[0] for w in ways]
        ranks += [0 if w is None else sum(o is not None and o is not w and audits.less(o[1], w[1]) for o in ways) for w in ways]
    return costs, ranks


def composed(pieces: list[tuple[list[int], list[int]]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of a conversation in pieces, and for each piece the states before and after it."""
    after = [[0 if s in ACCEPTED else None for s in range(STATES)]]
    for costs, _ in reversed(pieces):
        row = []
        for s in range(STATES):
            ends = [costs[s * STATES + t] + after[-1][t] for t in range(STATES) if costs[s * STATES + t] >= 0 and after[-1][t] is not None]
            row.append(min(ends, default=None))
        after.append(row)
    total, state, out = after[-1][0] or 0, 0, []
    for (costs, ranks), rest in zip(pieces, reversed(after[:-1])):
        # of equal sums the audit that is less so far; where one is another's prefix, the shorter one holds the longer one's ways too
        _, _, to = min((costs[state * STATES + t] + rest[t], ranks[state * STATES + t], t) for t in range(STATES) if costs[state * STATES + t] >= 0 and rest[t] is not None)
        out.append((state, to))
        state = to
    return total, out


def digest_of(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def fault_of(role: str, text: str, seen: set) -> str:
    """The row's first fault; ``seen`` holds the digests of the rows before and takes this one's."""
    body = text.strip(SPACE)
    if not body:
        return "blank"
    d = digest_of(role, text)
    if d in seen:
        return "duplicate"
    seen.add(d)
    return "" if body[-1] in ENDS else "truncated"


class Piece:
    """Rows (turn, role, text) of one conversation in order, with their faults."""

    def __init__(self, rows: list[tuple], seen: set | None = None):
        self.rows = rows
        seen = set() if seen is None else seen
        self.faults = [fault_of(role, text, seen) for _, role, text in rows]
        self.steps = [(role[:1], fault) for (_, role, _), fault in zip(rows, self.faults)]

    def counts(self) -> dict:
        turns = [t for t, _, _ in self.rows if t is not None]
        initials = [i for i, _ in self.steps]
        return {"blank": self.faults.count("blank"), "duplicate": self.faults.count("duplicate"), "truncated": self.faults.count("truncated"),
                "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
                "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))}

    def edited(self, audit: str, state: int) -> list[tuple[str, str, str]]:
        """(edit, role, text) of the turns that an audit from ``state`` gives."""
        out, rows = [], iter(self.rows)
        for letter in audit:
            _, role, text = next(rows) if letter != "I" else (None, "", "")
            if letter == "D":
                continue
            if letter != "K":
                role = NAME[state]
            out.append((letter, role, text))
            state = FOLLOW[state][role[:1]]
        return out

    def solved(self) -> tuple[int, str]:
        audits = Audits()
        ways = solve(self.steps, 0, audits)
        cost, node = ways[best_end(ways, audits)]
        return cost, audits.text(node)

    def traced(self, state: int, end: int) -> str:
        audits = Audits()
        return audits.text(solve(self.steps, state, audits)[end][1])


def joined(counts: list[dict]) -> dict:
    """Counts of a conversation from those of its pieces in order."""
    out = {k: sum(c[k] for c in counts) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    initials = [c for c in counts if c["first"] is not None]
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(initials, initials[1:]))
    timed = [c for c in counts if c["low"] is not None]
    out["turns"] -= sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))  # a turn that goes over an edge
    out["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - out["turns"] if timed else 0
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, part int, n long, edit string, role string, text string"
EDGE = "edge boolean, conv_id long, part int, pos long, turn long, role string, text string, gone boolean"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by crc32(``conv_id:turn``) % 20; a dropped row stays as a mark (gone)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    hurt = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), hurt.alias("text"), (fault == 0).alias("gone"),
                       F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def plain_rows(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form that ``repair`` takes."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.lit(False).alias("gone"))


def _finished(conv, rows: list[tuple], turns: bool) -> list[tuple]:
    piece = Piece(rows)
    cost, audit = piece.solved()
    done = piece.edited(audit, 0)
    if turns:
        return [(conv, 0, n, *t) for n, t in enumerate(done)]
    counts = joined([piece.counts()])
    return [(conv, *[counts[c] for c in COUNTS], cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in done).encode()).hexdigest())]


def _repair(rows: DataFrame, turns: bool) -> DataFrame:
    spark = rows.sparkSession
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.col("row")]
    ranged = (rows.select("conv_id", "turn", "role", "text", "gone", F.monotonically_increasing_id().alias("row"))
              .repartitionByRange(planned_partitions(rows, PARTITION_BYTES), *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone"))
    result = TURNS if turns else RESULT
    own = [c.split()[0] for c in result.split(", ")]
    edge_names = [c.split()[0] for c in EDGE.split(", ")]
    extra = [c for c in result.split(", ") if c.split()[0] not in edge_names]
    names = edge_names + [c.split()[0] for c in extra]

    def first_pass(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, pos, first, key, held = TaskContext.get().partitionId(), 0, True, None, []
        kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in [*EDGE.split(", "), *extra]])

        def batch(edges, results):
            out = [dict(zip(edge_names, (True, conv, part, p, *r))) for p, (conv, *r) in edges] + [{"edge": False, **dict(zip(own, r))} for r in results]
            return pa.RecordBatch.from_pylist(out, schema)

        def ended():
            return _finished(key[0], [(t, r, x) for _, (_, t, r, x, gone) in held if not gone], turns)

        for b in slices(batches, "text"):
            edges, results = [], []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if key is not None and row[0] != key[0]:
                    if not first:
                        results += ended()
                    first, held = False, []
                key = (row[0],)
                # a partition's first conversation may have begun before it
                (edges if first else held).append((pos, row))
                pos += 1
            if edges or results:
                yield batch(edges, results)
        if held:  # its last one may go on after it
            yield batch(held, [])

    out = materialise(ranged.mapInArrow(first_pass, ", ".join([EDGE, *extra])).select(*names), "repair")
    inside = out.filter("not edge").select(*own)
    edges = out.filter("edge").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "part", "pos", "turn", "role", "text", "gone")
    return inside.unionByName(_over_edges(edges, turns, result))


def _rows_of(table) -> list[tuple]:
    """(turn, role, text) in order, without the rows that are gone."""
    table = table.sort_by("pos")
    return [(t, r, x) for t, r, x, gone in zip(*(table[c].to_pylist() for c in ("turn", "role", "text", "gone"))) if not gone]


def _over_edges(edges: DataFrame, turns: bool, result: str) -> DataFrame:
    """Conversations at the edges of range partitions: pieces, composed."""

    def listed(batches):
        import pyarrow as pa

        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([digest_of(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.binary())], names=["conv", "part", "digest"])

    digests = (edges.filter("not gone").select("conv", "part", "role", "text").mapInArrow(listed, "conv string, part int, digest binary")
               .groupBy("conv", "part", "digest").agg(F.lit(1).alias("one")).drop("one"))
    firsts = digests.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min("part").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # digests of a piece that an earlier piece has
    earlier = materialise(digests.join(firsts, (F.col("conv") == F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("part") > F.col("first"))).select("conv", "part", "digest"), "repair-seen")
    # one row is enough to say that a piece has none
    seen = earlier.unionByName(edges.select("conv", "part").distinct().withColumn("digest", F.lit(None).cast("binary")))

    def sums(key, piece, before):
        import pyarrow as pa

        p = Piece(_rows_of(piece), {d for d in before["digest"].to_pylist() if d is not None})
        costs, ranks = summed(p.steps)
        c = p.counts()
        return pa.table({"conv": [key[0].as_py()], "conv_id": piece["conv_id"][:1], "part": pa.array([key[1].as_py()], pa.int32()), "costs": pa.array([costs], pa.list_(pa.int64())), "ranks": pa.array([ranks], pa.list_(pa.int64())),
                         **{k: pa.array([c[k]], pa.string() if k in ("first", "last") else pa.int64()) for k in c}})

    counted = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
    groups = edges.groupBy("conv", "part")
    summary = materialise(groups.cogroup(seen.groupBy("conv", "part")).applyInArrow(sums, f"conv string, conv_id long, part int, costs array<long>, ranks array<long>, {counted}"), "repair-pieces")

    def compose(table):
        import pyarrow as pa

        pieces = sorted(table.to_pylist(), key=lambda r: r["part"])
        total, ways = composed([(p["costs"], p["ranks"]) for p in pieces])
        c = joined(pieces)
        return pa.table({"conv": [p["conv"] for p in pieces], "part": pa.array([p["part"] for p in pieces], pa.int32()),
                         "before": pa.array([w[0] for w in ways], pa.int64()), "after": pa.array([w[1] for w in ways], pa.int64()),
                         **{k: pa.array([c[k]] * len(pieces), pa.int64()) for k in COUNTS}, "cost": pa.array([total] * len(pieces), pa.int64())})

    # a conversation has at most one row a range partition here
    ways = summary.groupBy("conv").applyInArrow(compose, "conv string, part int, before long, after long, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost")))
    hints = seen.join(ways, ["conv", "part"])

    def trace(key, piece, hint):
        import pyarrow as pa

        p = Piece(_rows_of(piece), {d for d in hint["digest"].to_pylist() if d is not None})
        h = hint.slice(0, 1).to_pylist()[0]
        audit = p.traced(h["before"], h["after"])
        done = p.edited(audit, h["before"])
        part = key[1].as_py()
        if turns:
            return pa.table({"conv_id": pa.array([piece["conv_id"][0].as_py()] * len(done), pa.int64()), "part": pa.array([part] * len(done), pa.int32()), "n": pa.array(range(len(done)), pa.int64()),
                             **{k: pa.array([t[i] for t in done], pa.string()) for i, k in enumerate(("edit", "role", "text"))}})
        text = "\n".join(f"{r}:{t}" for _, r, t in done) if done else None
        return pa.table({"conv": [key[0].as_py()], "conv_id": piece["conv_id"][:1], "part": pa.array([part], pa.int32()), "audit": [audit], "repaired": pa.array([text], pa.string()),
                         **{k: pa.array([h[k]], pa.int64()) for k in (*COUNTS, "cost")}})

    kinds = TURNS if turns else "conv string, conv_id long, part int, audit string, repaired string, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost"))
    traced = groups.cogroup(hints.groupBy("conv", "part")).applyInArrow(trace, kinds)
    if turns:
        return traced

    def finish(batches):
        import pyarrow as pa

        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in result.split(", ")])
        held, sha, audit, some = None, None, [], False

        def row():
            return pa.RecordBatch.from_pylist([{k: held[k] for k in ("conv_id", *COUNTS, "cost")} | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)

        for b in slices(batches, "repaired"):
            for r in b.to_pylist():
                if held is None or r["conv"] != held["conv"]:
                    if held is not None:
                        yield row()
                    sha, audit, some = hashlib.sha256(), [], False
                held = {k: v for k, v in r.items() if k not in ("repaired", "audit")}
                audit.append(r["audit"])
                if r["repaired"] is not None:
                    sha.update((("\n" if some else "") + r["repaired"]).encode())
                    some = True
        if held is not None:
            yield row()

    # the pieces of a conversation pass in order, as SHA-256 needs them; one piece in memory
    return traced.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(finish, result)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return _repair(rows, turns=False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations turn by turn: conv_id, part and n (their order), edit, role, text."""
    return _repair(rows, turns=True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql() -> str:
    """DuckDB: the programme as a recursive table; a way is its cost in 8 digits and its audit, so LEAST picks the right one."""
    def way(c: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(substr({c}, 1, 8) AS INTEGER) + {cost} AS VARCHAR), 8, '0') || substr({c}, 9) || '{letter}')"

    def least(*xs: str) -> str:
        return f"least({', '.join(xs)})"

    relaxed2 = least("s2", way("s0", "3", "I"), way("s1", "3", "I"), way("s3", "3", "I"))
    keep = lambda c, initial: f"CASE WHEN ok AND initial = '{initial}' THEN {way(c, 'more', 'K')} END"
    rerole = lambda c: f"CASE WHEN ok THEN {way(c, '(3 + more)', 'R')} END"
    delete = lambda c: way(c, "4", "D")
    step0 = delete("s0")
    step1 = least(delete("s1"), keep("s0", "s"))
    step2 = least(delete("s2"), *[f(c) for c in ("s0", "s1", "s3") for f in (lambda c: keep(c, "u"), rerole)])
    step3 = least(delete("s3"), keep("s2", "a"), rerole("s2"))
    relax = lambda inner: f"SELECT * REPLACE ({least('s3', way('s2', '3', 'I'))} AS s3) FROM (SELECT * REPLACE ({relaxed2} AS s2) FROM ({inner}))"
    return f"""
WITH RECURSIVE crc_table AS (SELECT list(list_reduce(list_concat([i], [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
o AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
f AS MATERIALIZED (SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS conv, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda h: ascii(h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM o, crc_table),
h AS (SELECT conv, conv_id, rid, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, rid, copy) AS i FROM h),
g AS (SELECT *, substr(role, 1, 1) AS initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM n),
r AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind FROM g),
c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated,
      count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS m FROM r GROUP BY conv),
dp AS (
  SELECT conv, 0 AS i, '00000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '00000003I' AS s2, '00000006II' AS s3 FROM c
  UNION ALL
  {relax(f"SELECT conv, i, {step0} AS s0, {step1} AS s1, {step2} AS s2, {step3} AS s3 FROM (SELECT dp.conv, r.i, s0, s1, s2, s3, initial, kind NOT IN ('blank', 'duplicate') AS ok, CASE WHEN kind = 'truncated' THEN 3 ELSE 0 END AS more FROM dp JOIN r ON r.conv = dp.conv AND r.i = dp.i + 1)")}
),
w AS (SELECT c.conv, least(s0, s3) AS way, substr(least(s0, s3), 9) AS audit FROM dp JOIN c ON dp.conv = c.conv AND dp.i = c.m),
e AS (SELECT conv, p, substr(audit, p, 1) AS letter, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p - 1), 'D', '')) AS k FROM (SELECT conv, audit, unnest(generate_series(1, length(audit))) AS p FROM w)),
x AS (SELECT e.conv, p, letter, k, r.role, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text, max(CASE WHEN k = 0 AND letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv) AS lead FROM e LEFT JOIN r ON r.conv = e.conv AND r.i = e.i WHERE letter <> 'D'),
y AS (SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS repaired FROM x GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(substr(way, 1, 8) AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM f) a LEFT JOIN c USING (conv) LEFT JOIN w USING (conv) LEFT JOIN y USING (conv)
"""


SQL = _sql()
