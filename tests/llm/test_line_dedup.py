import hashlib
import random

from ledgerlens.llm import line_dedup as L

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=20, min_docs=3):
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    keeper = {k: max((i for i in s if i is not None), default=None) for k, s in docs.items() if len(k) >= min_chars and len(s) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as line", "3 as kept", "4 as a")
    return sorted(map(tuple, L.line_dedup(d).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(kept, 256)").collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(2)
    common = ["A line that many documents share.", " a LINE that many documents share.\t", "Ünïcode ÉÀ line of the site", "ünïcode éà line of the site", "short", "x" * 20, "X" * 19 + "é", "  ", "nineteen characters"]
    rows = [(i, "\n".join(rng.choice([*common, f"own line number {rng.randint(0, 60)} here"]) for _ in range(rng.randint(1, 8)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, common[0]), (None, common[0] + "\n" + common[5]), (3, rows[3][1]), (3, common[0] + "\nother text of a repeated id")]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_a_line_in_all_documents_and_empty_table(spark):
    rows = [(i, f"the same licence line everywhere\nown {i}") for i in range(2000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(1, "x")]) == brute([(1, "x")])
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_many_lines_and_a_row_repeated_often(spark):
    shared = "\n".join(f"a shared line of some length {k % 40_000}" for k in range(120_000))
    rows = [(1, shared), (2, shared), (3, shared)] + [(4, "one and the same line of text\nx")] * 500 + [(5, "One and the same line of text"), (6, "one and the same line of text ")]
    assert got(spark, rows) == brute(rows)
