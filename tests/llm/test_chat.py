import itertools
import random
import re
import time

import numpy as np

from ledgerlens.llm import chat as C


def brute(model, lines):
    """The likeliest states of a short conversation by trying all."""
    e = model.scores(lines)
    best = max(itertools.product(range(C.STATES), repeat=len(lines)),
               key=lambda p: model.start[p[0]] + sum(e[i, s] for i, s in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:])))
    return list(best)


def model():
    rng = np.random.default_rng(5)
    return C.Model(rng.random((4, 3)) * 9, rng.random((3, 2)) * 9, rng.random((C.STATES, 6)) * 9)


def test_viterbi_is_the_best_path_whole_and_in_pieces():
    m, rng = model(), np.random.default_rng(2)
    for n in (1, 2, 4, 5):
        lines = np.stack([rng.integers(0, 5, n), rng.integers(0, 6, n)], axis=1).astype(np.uint8)
        want = brute(m, lines)
        assert m.trace(lines, None, None).tolist() == want
        for k in range(1, n):
            a, b = m.matrix(lines[:k]), m.matrix(lines[k:])
            assert m.trace(lines[:k], None, b[:-1].max(axis=1)).tolist() == want[:k]
            assert m.trace(lines[k:], a[-1], None).tolist() == want[k:]


def test_markers():
    for line, want in [("Human: hi", (1, 7)), ("**Assistant**: x", (2, 15)), ("[AI] - y", (2, 7)), ("### System: z", (0, 12)), ("> user> q", (1, 8)), ("Well: no", (3, 0)), ("plain", (3, 0)), ("", (3, 0))]:
        marker, at = C.marker_of(line)
        assert (marker, line[at:].strip()) == (want[0], line[want[1]:].strip()), line


def chats(n=60, seed=1):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(2, 8)):
            role = ("user", "assistant")[t % 2]
            lines = [("what is it " * rng.randint(1, 3) + "?") if role == "user" else ("so it is and more of it " * rng.randint(4, 12)) for _ in range(rng.randint(1, 2 if role == "user" else 4))]
            rows.append((c, t, role, "\n".join(lines)))
    return rows


def test_roles_are_recovered_without_some_markers(spark):
    rows = chats()
    rng = random.Random(2)
    hidden = [(c, t, None if t and rng.random() < 0.3 else rng.choice([r, r.upper() + " ", {"user": "human", "assistant": "bot"}[r]]), x) for c, t, r, x in rows]
    got = {(r.conv_id, r.turn): r.role for r in C.format_chats(spark.createDataFrame(hidden, "conv_id long, turn long, role string, text string")).filter("part = 0").collect()}
    lost = [(c, t, r) for (c, t, r, _), h in zip(rows, hidden) if h[2] is None]
    assert len(lost) > 30
    assert sum(got[c, t] == r for c, t, r in lost) >= 0.95 * len(lost)
    assert all(got[c, t] == r for (c, t, r, _), h in zip(rows, hidden) if h[2] is not None)


def test_one_long_conversation_over_many_partitions_equals_one_piece(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", None, "who"]), rng.choice(["yes", "why?", "a long line of words " * 9, "x\ny", "User: in\nBot: text"])) for t in range(400)] + [(2, 0, "user", "a"), (0, 0, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as states", "2 as seg")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    many = key(C.format_chats(d))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert key(C.format_chats(d)) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_rendering_and_odd_rows(spark):
    rows = [(1, 0, "system", "Be <|im_end|> kind"), (1, 1, "user", "Hi\nthere"), (1, 2, None, "Assistant: yes\nUser: more?\nBot: no"), (None, 0, "user", "x"), (3, None, "", None), (4, 0, "user", "same"), (4, 0, "user", "same")]
    out = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn, r.part): r.rendered for r in out.collect()}
    assert out.count() == 9
    assert got[1, 0, 0] == "<|im_start|>system\nBe <\\|im_end|> kind<|im_end|>\n"
    assert got[1, 1, 0] == "<|im_start|>user\nHi\nthere<|im_end|>\n"
    assert [got[1, 2, k] for k in range(3)] == ["<|im_start|>assistant\nyes<|im_end|>\n", "<|im_start|>user\nmore?<|im_end|>\n", "<|im_start|>assistant\nno<|im_end|>\n"]
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_counts(rows):
    """The model's counts by walking whole conversations."""
    convs = {}
    for c, t, tie, role, text in rows:
        convs.setdefault(c, set()).add((t is not None, t or 0, tie, role, text))
    follow, going_on, look = np.zeros((4, 3)), np.zeros((3, 2)), np.zeros((C.STATES, 6))
    for rs in convs.values():
        role, first = None, True
        for _, _, _, said, text in sorted(rs, key=lambda r: r[:3]):
            seen = C.observe(said, text)
            for marker, feature in zip(seen[::2], seen[1::2]):
                if marker < 3:
                    if first or role is not None:
                        follow[3 if first else role, marker] += 1
                    if role is not None:
                        going_on[role, 1] += 1
                    role = marker
                    look[2 * role, feature] += 1
                elif marker == C.UNKNOWN:
                    role = None
                elif role is not None:
                    going_on[role, 0] += 1
                    look[2 * role + 1, feature] += 1
                first = False
    return np.concatenate([follow.ravel(), going_on.ravel(), look.ravel()])


def whole(spark, rows):
    """The query's answer by one Viterbi walk over each whole conversation, rendered turn by turn."""
    flat = plain_counts(rows)
    m = C.Model(flat[:12].reshape(4, 3), flat[12:18].reshape(3, 2), flat[18:].reshape(C.STATES, -1))
    convs, out = {}, []
    for c, t, tie, role, text in rows:
        convs.setdefault(c, set()).add((t is not None, t or 0, tie, role, text))
    for c, rs in convs.items():
        rs = sorted(rs, key=lambda r: r[:3])
        seen = [C.observe(r[3], r[4]) for r in rs]
        states = m.trace(C._lines(seen), None, None).tolist()
        at = 0
        for (has, t, _, _, text), s in zip(rs, seen):
            mine, at = states[at:at + len(s) // 2], at + len(s) // 2
            out += [(c, t if has else None, k, r, n, C.render(r, x)) for k, (r, x, n) in enumerate(C.turns_of(None, text, bytes(mine)))]
    return sorted(out, key=repr)


def test_counts_and_turns_whatever_the_partitions(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", None, "who", "system"]), rng.choice(["yes", "why?", "a long line of words " * 9, "x\ny", "User: in\nBot: text", ""])) for c in range(30) for t in range(20)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").cache()
    full = [tuple(r) for r in C._rows(d).select("conv_id", "turn", "tie", "role", "text").collect()]
    n, answers = spark.conf.get("spark.sql.shuffle.partitions"), []
    want = plain_counts(full)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for k in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(k))
            obs = C.materialise(C._observed(d).withColumn("seg", C.F.spark_partition_id()), "test-observations")
            assert obs.select("seg").distinct().count() > k // 2 and (C.counts(obs) == want).all()
            answers.append(sorted(map(tuple, C.format_chats(d).collect()), key=repr))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert answers[0] == answers[1] == answers[2] == whole(spark, full)


def test_marker_of_equals_the_backtracking_rule_and_is_linear():
    old = re.compile(r"\s*(?:#+\s*|[-*>]\s+)?(?:\*\*|\[|<\|?|\()?\s*([A-Za-z]{1,12})(?:\s*#?\d+)?\s*(?:\*\*|\]|\|?>|\))?\s*(?:\*\*)?\s*(:|>|(?<=[\]*)>])\s*-)(?:\*\*)?\s*")
    rng = random.Random(3)
    for _ in range(60_000):
        line = "".join(rng.choice(["user", "AI", " ", "  ", "*", "**", "#", "[", "]", "<|", "|>", ">", ":", "-", "(", ")", "7", "x"]) for _ in range(rng.randint(1, 9)))
        a, b = old.match(line), C.MARK.match(line)
        assert (a and (a[1], a.end())) == (b and (b[1], b.end())), line
    begin = time.time()
    for line in ("a" + " " * 1_000_000, " " * 1_000_000, "#" * 1_000_000, "user " + "1" * 1_000_000, "[user" + " " * 500_000 + "**" + " " * 500_000):
        C.marker_of(line)
    assert time.time() - begin < 1
