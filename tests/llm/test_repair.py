import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerlens.llm import repair as R
from ledgerlens.llm.common import scratch

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit) by a table of whole strings: (initials so far) can only be one of four kinds."""
    kinds = [re.compile(p) for p in ("", "s", "s?(ua)*u", "s?(ua)+")]

    def kind(s):
        return next((k for k, p in enumerate(kinds) if p.fullmatch(s)), None)

    best = {0: (0, "", "")}  # kind -> cost, audit, initials

    def offer(table, cost, audit, initials):
        k = kind(initials)
        if k is not None and (k not in table or (cost, audit) < table[k][:2]):
            table[k] = (cost, audit, initials)
            return True

    def inserts(table):
        again = True
        while again:
            again = any([offer(table, c + 3, a + "I", s + x) for c, a, s in list(table.values()) for x in "ua"])

    inserts(best)
    for initial, fault in rows:
        new = {}
        for c, a, s in best.values():
            offer(new, c + 4, a + "D", s)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if len(initial) == 1:
                    offer(new, c + more, a + "K", s + initial)
                for x in "ua":
                    offer(new, c + more + 3, a + "R", s + x)
        inserts(new)
        best = new
    return min(best[k][:2] for k in (0, 3) if k in best)


def exhaustive(rows):
    """The same by trying everything (up to two inserts between rows)."""
    found = []
    gaps = [("",), *[("I",) * n for n in (1, 2)]]
    for between in itertools.product((0, 1, 2), repeat=len(rows) + 1):
        for letters in itertools.product("KRD", repeat=len(rows)):
            for new in itertools.product("ua", repeat=sum(between) + letters.count("R")):
                fill, cost, audit, initials = iter(new), 0, "", ""
                ok = True
                for n, row, letter in zip(between, [*rows, None], [*letters, None]):
                    audit, cost, initials = audit + "I" * n, cost + 3 * n, initials + "".join(next(fill) for _ in range(n))
                    if row is None:
                        break
                    initial, fault = row
                    audit += letter
                    if letter == "D":
                        cost += 4
                        continue
                    ok &= fault not in ("blank", "duplicate")
                    cost += 3 * (fault == "truncated") + 3 * (letter == "R")
                    initials += initial if letter == "K" else next(fill)
                if ok and re.fullmatch("(s?(ua)+)?", initials):
                    found.append((cost, audit))
    return min(found)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute(rows, hurt=True):
    convs = {r[0]: [] for r in rows}
    for r in damaged(rows) if hurt else [(c, t, *(" " if x is None else x for x in v)) for c, t, *v in rows]:
        convs[r[0]].append(r)
    out = []
    for conv, rs in convs.items():
        # a table with several texts of one turn and role has to be given in the operator's order
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        seen, steps = set(), []
        for _, _, role, text in rs:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            steps.append((role[:1], fault))
        faults = [f for _, f in steps]
        turns = [t for _, t, _, _ in rs if t is not None]
        cost, audit = cheapest(steps)
        said, it = [], iter(rs)
        lead = 0
        for letter in audit:
            _, _, role, text = next(it) if letter != "I" else (0, 0, "", "")
            if letter == "D":
                continue
            lead |= not said and letter == "K" and role[:1] == "s"
            said.append(f"{role if letter == 'K' else 'user' if (len(said) - lead) % 2 == 0 else 'assistant'}:{text}")
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(steps, steps[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([1, 1, 1, 2])
            rows.append((c if c else None, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ugly", "", None]),
                         rng.choice(["Yes.", "No!", "cut off", "", " \t", None, f"own {turn}.", f"É {turn}?\n"])))
    rng.shuffle(rows)
    return rows


def test_programme_against_trying_everything():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("suatsx"), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 3))]
        audits = R.Audits()
        ways = R.solve(rows, 0, audits)
        cost, node = ways[R.best_end(ways, audits)]
        assert (cost, audits.text(node)) == cheapest(rows) == exhaustive(rows)


def test_pieces_compose_to_the_whole():
    rng = random.Random(7)
    for _ in range(400):
        rows = [(rng.choice("suat"), rng.choice(["", "", "truncated", "blank"])) for _ in range(rng.randint(0, 24))]
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 5)))
        pieces = [rows[a:z] for a, z in zip([0, *cuts], [*cuts, len(rows)])]
        total, ways = R.composed([R.summed(p) for p in pieces])
        audit = ""
        for p, (before, after) in zip(pieces, ways):
            audits = R.Audits()
            audit += audits.text(R.solve(p, before, audits)[after][1])
        assert (total, audit) == cheapest(rows)


@pytest.mark.parametrize("modulus", [R.MODULUS, 2, 1])
def test_prefixes_compare_as_strings_even_when_hashes_collide(modulus):
    rng = random.Random(8)
    audits, text = R.Audits(modulus), {0: ""}
    for _ in range(300):
        base = rng.choice(list(text))
        letter = rng.choice("DIK")
        text[audits.add(base, letter)] = text[base] + letter
    for _ in range(3000):
        a, b = rng.choice(list(text)), rng.choice(list(text))
        assert audits.less(a, b) == (text[a] < text[b])
        d = rng.randint(0, len(text[a]))
        assert text[audits.ancestor(a, d)] == text[a][:d]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_brute_force(spark):
    rows = rows_of(1, 60, 12) + [(99, None, "user", "Hi."), (98, 1, "user", "x " * 200_000 + "."), (98, 2, "assistant", "Long.")]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as edge", "'z' as audit", "0 as row")
    assert got(R.repair(R.damage(d))) == brute(rows)
    assert got(R.repair(R.plain_rows(d))) == brute(rows, hurt=False)
    assert R.repair(R.damage(d.limit(0))).count() == 0


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(R, "PARTITION_BYTES", 3000)
    rng = random.Random(3)
    hot = [(1007, 3 * k, rng.choice(["user", "assistant"]), rng.choice([f"t{rng.randint(0, 300)}.", "cut", "Same.", ""])) for k in range(900)]
    rows = hot + rows_of(2, 30, 6) + [(500, 1, "user", "Again.")] * 200 + [(501, None, "user", "None.")] * 50
    d = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert got(R.repair(R.damage(d))) == want
    turns = {}
    for r in sorted(R.repaired_turns(R.damage(d)).collect(), key=lambda r: (r.part, r.n)):
        turns.setdefault(r.conv_id, []).append(r)
    for conv, *_, audit, sha in want:
        said = turns.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in said).encode()).hexdigest() == sha
        assert "".join(r.edit for r in said) == audit.replace("D", "")


def test_query(spark):
    rows = rows_of(5, 80, 3)  # some lose all their rows
    path = scratch(spark, "test-conversations")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/conversations.parquet")
    out = got(R.op13_conversation_repair(spark, path))
    assert out == brute(rows)
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in out)
