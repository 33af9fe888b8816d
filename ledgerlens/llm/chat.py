"""Chat formatting: transcripts parsed by a hidden Markov model, then rendered turn by turn.

Hidden states are (role, start of a turn or going on) for every line of a conversation. A line is observed as its speaker marker
(from the role column for a row's first line, or from a prefix such as ``Human:`` or ``**Assistant** -`` in the text)
and one line feature (blank, question, list or code, short, middling, long). Marker probabilities are fixed; how
roles follow one another, how long turns are and what their lines look like is counted over all conversations.

Viterbi finds the likeliest states, so lines with no marker, an unknown one or a wrong one get the role that fits around
them. A conversation of any length is cut where Spark's range partitions end: a piece is a max-plus matrix from entry
to exit state, the pieces at partition edges (at most two a partition) are composed in order, and each piece is then
traced back with the scores that come from both sides. Only observations (two bytes a line) are sorted and
scanned; texts are joined to their states by row afterwards and rendered.

Rendering: ``<|im_start|>role`` newline, the lines without their marker, ``<|im_end|>``; such strings in a text are escaped with a
backslash. A row whose text holds several turns gives several.

Defined results: null text is one blank line; null or unknown roles name nobody, but a row's first line still starts a turn; rows without conv_id are one
conversation; a null turn comes first; rows of one turn number are ordered by a hash; repeated rows count once in the
sequence and each give their turns; a line of any length is read in one go; an empty table gives no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise, slices

ROLES = ("system", "user", "assistant")
#: Names that speakers go by.
ALIASES = {
    "system": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "client": "user", "student": "user", "prompter": "user", "question": "user", "q": "user", "you": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "chatbot": "assistant", "agent": "assistant", "model": "assistant", "gpt": "assistant", "answer": "assistant", "a": "assistant", "support": "assistant",
}
NONE, UNKNOWN = 3, 4  # markers: 0 to 2 are the roles; UNKNOWN: a row starts, and no name says whose it is
FEATURES = ("blank", "question", "list", "short", "middle", "long")
#: A marker at a line's start; blanks are taken once and never given back, so a line is read in one go.
MARK = re.compile(r"\s*+(?:#++\s*+|[-*>]\s++)?(?:\*\*|\[|<\|?|\()?\s*+([A-Za-z]{1,12})(?:\s*+#?\d++)?(?:\s*+(?:\*\*|\]|\|?>|\)))?(?:\s*+\*\*)?(?:\s*+[:>]|(?<=[\]*)>])\s*+-)(?:\*\*)?\s*+")
LISTED = re.compile(r"\s*(?:[-*+>]\s|\d+[.)]\s|```|\t|    )")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: log probability of each marker at the start of a turn and within one; state 2 r starts role r, 2 r + 1 goes on.
STATES = 2 * len(ROLES)
_MARKER = np.log(np.array([[0.8 if m == s // 2 else 0.01 if m < 3 else 0.06 if m == NONE else 0.12 for m in range(5)] if s % 2 == 0 else [0.004, 0.004, 0.004, 0.987, 0.001] for s in range(STATES)]))


def line_feature(line: str) -> int:
    s = line.strip()
    if not s:
        return 0
    if s[-1] in "?？¿":
        return 1
    if LISTED.match(line):
        return 2
    return 3 if len(s) <= 60 else 4 if len(s) <= 200 else 5


def marker_of(line: str) -> tuple[int, int]:
    """The marker that a line starts with, and where its text begins."""
    m = MARK.match(line)
    role = ALIASES.get(m[1].lower()) if m else None
    return (ROLES.index(role), m.end()) if role else (NONE, 0)


def observe(role: str | None, text: str | None) -> bytes:
    """Two bytes by line of a row: marker and feature."""
    out = bytearray()
    named = None if role is None or not role.strip() else ALIASES.get(role.strip().lower())
    for i, line in enumerate((text or "").split("\n")):
        marker, at = marker_of(line)
        if not i and role is not None and role.strip():
            marker = ROLES.index(named) if named else marker
        if not i and marker == NONE:
            marker = UNKNOWN
        out += bytes((marker, line_feature(line[at:])))
    return bytes(out)


class Model:
    """Log probabilities: start, step [from][to], look [state][feature]."""

    def __init__(self, follow: np.ndarray, going_on: np.ndarray, look: np.ndarray):
        """Counts: role after role (row 3: first), lines that go on or end a turn by role, features by state."""
        f = follow + np.array([[1, 3, 1], [1, 1, 4], [1, 4, 1], [1, 2, 1]])
        f = f / f.sum(axis=1, keepdims=True)
        g = going_on + 1.0
        g = g / g.sum(axis=1, keepdims=True)
        step = np.full((STATES, STATES), -np.inf)
        for s in range(STATES):
            r = s // 2
            step[s, 2 * r + 1] = np.log(g[r, 0])
            step[s, 0::2] = np.log(g[r, 1] * f[r])
        self.step = step
        self.start = np.full(STATES, -np.inf)
        self.start[0::2] = np.log(f[3])
        look = look + 1.0
        self.look = np.log(look / look.sum(axis=1, keepdims=True))

    def scores(self, lines: np.ndarray) -> np.ndarray:
        """Log probability of each line (marker, feature) in each state."""
        return _MARKER[:, lines[:, 0]].T + self.look[:, lines[:, 1]].T

    def matrix(self, lines: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines (last row: from the start of a conversation) to each state at their end."""
        e = self.scores(lines)
        out = np.vstack([self.step, self.start]) + e[0]
        for x in e[1:]:
            out = (out[:, :, None] + self.step[None]).max(axis=1) + x
        return out

    def trace(self, lines: np.ndarray, before: np.ndarray | None, after: np.ndarray | None) -> np.ndarray:
        """The states of a piece, given scores of the state before it (none: it starts) and of what follows each state at its end."""
        e = self.scores(lines)
        back = np.zeros((len(lines), STATES), np.int8)
        score = self.start + e[0] if before is None else (before[:, None] + self.step).max(axis=0) + e[0]
        for t in range(1, len(lines)):
            way = score[:, None] + self.step
            back[t] = way.argmax(axis=0)
            score = way.max(axis=0) + e[t]
        at = int((score + (0 if after is None else after)).argmax())
        out = np.empty(len(lines), np.uint8)
        for t in range(len(lines) - 1, -1, -1):
            out[t] = at
            at = int(back[t, at])
        return out


def _lines(obs) -> np.ndarray:
    return np.frombuffer(b"".join(obs), np.uint8).reshape(-1, 2)


def _pieces(batches):
    """Runs of one conversation in sorted rows: (seg, conv_id, rows as lists by column)."""
    key, held = None, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if (row[0], row[1]) != key:
                if held is not None:
                    yield key, held
                key, held = (row[0], row[1]), []
            held.append(row)
    if held is not None:
        yield key, held


def _sorted(obs: DataFrame) -> DataFrame:
    return obs.repartition("seg").sortWithinPartitions("seg", "conv_id", "turn", "tie").select("seg", "conv_id", "turn", "tie", "obs")


def _entries(obs: DataFrame) -> dict:
    """For range partitions that begin amid a conversation: that conversation and the role that its lines so far leave.

    A row's first line always names a role or an unknown one, so the last row of a partition settles it."""
    def run(batches):
        import pyarrow as pa

        ends: dict = {}
        for (seg, conv), rows in _pieces(batches):
            role = None
            for marker, _ in _lines([rows[-1][4]]).tolist():
                role = marker if marker < 3 else None if marker == UNKNOWN else role
            first = ends[seg][0] if seg in ends else conv
            ends[seg] = (first, conv, role)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(list(ends), pa.int32()), *[pa.array([e[i] for e in ends.values()], pa.int64()) for i in range(3)]], names=["seg", "first", "last", "role"])

    # one row a range partition
    rows = sorted(_sorted(obs).mapInArrow(run, "seg int, first long, last long, role long").collect(), key=lambda r: r["seg"])
    return {z["seg"]: (z["first"], a["role"]) for a, z in zip(rows, rows[1:]) if a["last"] == z["first"]}


def counts(obs: DataFrame) -> np.ndarray:
    """What the model counts over all conversations, wherever range partitions cut them: from lines whose role a marker
    gives and the lines after them."""
    entries = obs.sparkSession.sparkContext.broadcast(_entries(obs))

    def run(batches):
        import pyarrow as pa

        follow, going_on, look = np.zeros((4, 3)), np.zeros((3, 2)), np.zeros((STATES, len(FEATURES)))
        known, begun = entries.value, set()
        for (seg, conv), rows in _pieces(batches):
            role, first = None, True
            if seg not in begun and seg in known:
                role, first = known[seg][1], False
            begun.add(seg)
            for marker, feature in _lines([r[4] for r in rows]).tolist():
                if marker < 3:
                    follow[3 if first else role if role is not None else marker, marker] += first or role is not None
                    if role is not None:
                        going_on[role, 1] += 1
                    role = marker
                    look[2 * role, feature] += 1
                elif marker == UNKNOWN:
                    role = None
                elif role is not None:
                    going_on[role, 0] += 1
                    look[2 * role + 1, feature] += 1
                first = False
        found = np.concatenate([follow.ravel(), going_on.ravel(), look.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], names=["slot", "n"])

    sums = {r["slot"]: r["n"] for r in _sorted(obs).mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    size = 12 + 6 + STATES * len(FEATURES)  # this many rows, whatever the data
    return np.array([sums.get(i, 0.0) for i in range(size)])


def fit(obs: DataFrame) -> Model:
    flat = counts(obs)
    return Model(flat[:12].reshape(4, 3), flat[12:18].reshape(3, 2), flat[18:].reshape(STATES, -1))


def _edges(obs: DataFrame, model: Model) -> dict:
    """Scores from both sides for the pieces of conversations that go over the edge of a range partition."""

    def run(batches):
        import pyarrow as pa

        last, first_of = None, None
        found = []
        for (seg, conv), rows in _pieces(batches):  # the first and the last conversation of each range partition
            if seg != first_of:
                if last is not None:
                    found.append(last)
                found.append((seg, conv, 0, rows))
                first_of, last = seg, None
            else:
                last = (seg, conv, 1, rows)
        if last is not None:
            found.append(last)
        for seg, conv, end, rows in found:
            m = model.matrix(_lines([r[4] for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([conv], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["seg", "conv_id", "m"])

    spanning = obs.groupBy("conv_id").agg(F.min("seg").alias("a"), F.max("seg").alias("z")).filter("a < z").select(F.col("conv_id").alias("c"), "a", "z")
    matrices = _sorted(obs).mapInArrow(run, "seg int, conv_id long, m array<double>")
    # at most two rows a range partition
    rows = matrices.join(spanning, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("seg").between(F.col("a"), F.col("z"))).select("conv_id", "seg", "m").collect()
    by_conv: dict = {}
    for r in sorted(rows, key=lambda r: r["seg"]):
        by_conv.setdefault(r["conv_id"], []).append((r["seg"], np.array(r["m"]).reshape(STATES + 1, STATES)))
    out: dict = {}
    for conv, pieces in by_conv.items():
        before, befores = None, []
        for _, m in pieces:
            befores.append(before)
            before = m[-1] if before is None else (before[:, None] + m[:-1]).max(axis=0)
        after, afters = None, []
        for _, m in reversed(pieces):
            afters.append(after)
            after = (m[:-1] + (0 if after is None else after)).max(axis=1)
        for (seg, _), x, y in zip(pieces, befores, reversed(afters)):
            out[(seg, conv)] = (x, y)
    return out


def _observed(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tie, obs (two bytes a line) of the distinct rows, range-sorted."""
    def watch(batches):
        import pyarrow as pa

        for b in slices(batches, "text"):
            seen = [observe(r, t) for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(seen, pa.binary())], names=["conv_id", "turn", "tie", "obs"])

    seen = (_rows(conversations).mapInArrow(watch, "conv_id long, turn long, tie long, obs binary")
            .groupBy("conv_id", "turn", "tie").agg(F.first("obs").alias("obs")))
    return seen.repartitionByRange("conv_id", "turn", "tie").sortWithinPartitions("conv_id", "turn", "tie")


def recover(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tie (a hash of role and text), states (one byte a line): one row per distinct row."""

    obs = materialise(_observed(conversations).withColumn("seg", F.spark_partition_id()), "observations")
    model = fit(obs)
    edges = obs.sparkSession.sparkContext.broadcast(_edges(obs, model))  # at most two entries a range partition

    def run(batches):
        import pyarrow as pa

        sides = edges.value
        for (seg, conv), rows in _pieces(batches):
            before, after = sides.get((seg, conv), (None, None))
            states = model.trace(_lines([r[4] for r in rows]), before, after)
            ends = np.cumsum([len(r[4]) // 2 for r in rows])
            parts = [states[a:z].tobytes() for a, z in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)] + [pa.array(parts, pa.binary())], names=["conv_id", "turn", "tie", "states"])

    return _sorted(obs).mapInArrow(run, "conv_id long, turn long, tie long, states binary")


def _rows(conversations: DataFrame) -> DataFrame:
    role, text = F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.xxhash64(F.coalesce(role, F.lit("\0")), text).alias("tie"), role.alias("role"), text.alias("text"))


def turns_of(role: str | None, text: str, states: bytes) -> list[tuple[str, str, int]]:
    """(role, text, lines) of the turns in one row. A row's first line always starts one."""
    out: list[tuple[str, list[str]]] = []
    for i, (line, s) in enumerate(zip(text.split("\n"), states)):
        marker, at = marker_of(line)
        if not i or s % 2 == 0:
            out.append((ROLES[s // 2], []))
        # only a marker that fits the recovered role is taken off
        out[-1][1].append(line[at:] if marker == s // 2 and s % 2 == 0 else line)
    return [(r, "\n".join(ls), len(ls)) for r, ls in out]


def render(role: str, text: str) -> str:
    return f"{OPEN}{role}\n{text.replace('<|im_', '<' + chr(92) + '|im_')}{CLOSE}\n"


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, part (number of the turn within its row), role (recovered), n_lines, rendered."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "text"):
            out = []
            for conv, turn, role, text, states in zip(*(c.to_pylist() for c in b.columns)):
                out += [(conv, turn, k, r, n, render(r, t)) for k, (r, t, n) in enumerate(turns_of(role, text, states))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "turn", "part", "role", "n_lines", "rendered"])

    rows = _rows(conversations)
    states = recover(conversations).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("tie").alias("h"), "states")
    both = rows.join(states, rows.conv_id.eqNullSafe(states.c) & rows.turn.eqNullSafe(states.t) & (rows.tie == states.h)).select("conv_id", "turn", "role", "text", "states")
    return both.mapInArrow(run, "conv_id long, turn long, part int, role string, n_lines long, rendered string")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "part", "role", "n_lines", F.length("rendered").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
