"""Dimension-value matching against a direct scan and difflib."""

import difflib
import re

import pytest

from ledgerlens.operators import match as M
from ledgerlens.roles import Roles

VALUES = [("Asia", "Chairs", "Acme \\E Co"), ("Europe", "Chairs & Tables", "Bob"), ("Asia Pacific", "Tables", "Émile"), ("asia", "Box", "a.b(c)")]
TEXTS = [("1", "sales in ASIA for chairs & tables?"), ("2", "asiatic chair"), ("3", "what of acme \\e co, bob and émile"), ("4", "a.b(c) axb(c)"), ("5", "europ vs tabels"), ("6", "ab"), ("7", None), ("8", "")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(TEXTS, "text_id string, text string"), spark.createDataFrame(VALUES, "region string, category string, customer string")


def brute():
    out = set()
    for tid, text in TEXTS:
        q = (text or "").lower()
        for dim, i in (("category", 1), ("region", 0), ("customer", 2)):
            for v in {r[i] for r in VALUES}:
                lv = v.lower().strip()
                if len(lv) >= 3 and lv in q:
                    exact = re.search(r"\b" + re.escape(lv) + r"\b", q) is not None
                    out.add((tid, dim, v, 1.0 if exact else 0.85))
    return out


def test_exact_and_partial(spark, tables):
    texts, df = tables
    roles = Roles(region="region", category="category", customer="customer")
    got = M.match_values(texts, df, roles, fuzzy=False, top=50)
    assert {(r.text_id, r.dimension, r.value, r.confidence) for r in got.collect()} == brute()


def test_fuzzy_follows_difflib(spark):
    values = sorted({f"Product{i:04d}" for i in range(1500)} | {"Electronics", "Furniture", "Stationery", "statoinary", "abcde", "abcd"})
    words = ["electronic", "furnitures", "stationary", "product0123", "abxcde", "bacde", "nothing"]
    df = spark.createDataFrame([(v,) for v in values], "category string")
    texts = spark.createDataFrame([(w, f"the {w}?") for w in words], "text_id string, text string")
    q = texts.selectExpr("text_id", "lower(text) as q")
    got = {r.text_id: r.value.lower() for r in M.fuzzy_hits(q, M.dimension_values(df, Roles(category="category"))).collect()}
    want = {w: m[0] for w in words if (m := difflib.get_close_matches(w, [v.lower() for v in values], n=1, cutoff=0.88))}
    assert got == want and len(want) >= 4
    # golden rows
    assert got["product0123"] == "product0123" and "nothing" not in got


def test_pairs_that_reach_difflib_are_few_and_hold_all_close_ones(spark):
    import random

    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(3, 14))).strip() for _ in range(700)})
    names = [n for n in names if len(n) >= 3]
    near = lambda n: "".join(c for c in n if rng.random() > 0.06) + rng.choice(["", "a"])
    words = sorted({w for n in names for w in (near(n), near(n)) if len(w) >= 3})
    pairs = {tuple(r) for r in M.fuzzy_pairs(spark.createDataFrame([(w,) for w in words], "w string"), spark.createDataFrame([(n,) for n in names], "lv string")).collect()}
    close = {(w, n) for w in words for n in names if difflib.SequenceMatcher(None, n, w).ratio() >= M.FUZZY_CUTOFF}
    assert close <= pairs and len(close) > 300
    assert len(pairs) < 0.02 * len(words) * len(names)   # five letters only; a shared bigram holds for nearly all


def test_a_text_sends_only_what_may_be_an_anchor(spark, tables):
    texts, df = tables
    values = M.dimension_values(df, Roles(region="region", category="category", customer="customer"))
    anchors = M.anchored(values).cache()
    pieces = M.text_pieces(texts.selectExpr("text_id", "lower(text) as q"), anchors)
    known = {r.gram for r in anchors.collect()}
    got = {(r.text_id, r.gram) for r in pieces.collect()}
    assert {(t, g) for t, x in TEXTS for g in known if g in (x or "").lower()} <= got and len(got) < 30


def test_query_on_the_given_tables_against_difflib(spark):
    from ledgerlens.plans import q_match, registry
    from tests.conftest import SMALL

    registry.load_all()
    texts = {r.text_id: r.text for r in q_match._texts(spark, SMALL).collect()}
    df, roles = q_match.prepared_fact(spark, SMALL)
    values = [tuple(r) for r in M.dimension_values(df, roles).select("dim_order", "dimension", "value", "lv").collect()]
    by_dim, best = {}, {}
    for _, dim, value, lv in values:
        by_dim.setdefault(dim, {}).setdefault(lv, []).append(value)
    want = set()
    for tid, text in texts.items():
        hits = {}
        for order, dim, value, lv in values:
            if lv in text.lower():
                exact = re.search(r"\b" + re.escape(lv) + r"\b", text.lower()) is not None
                hits[(dim, value)] = (1.0 if exact else 0.85, "exact" if exact else "partial", order)
        for w in {w for w in re.findall(r"[a-zA-Z0-9]+", text.lower()) if len(w) >= 3}:
            for dim, names in by_dim.items():
                if (w, dim) not in best:
                    best[w, dim] = difflib.get_close_matches(w, list(names), n=1, cutoff=0.88)
                for lv in best[w, dim]:
                    value = min(names[lv])
                    hits.setdefault((dim, value), (0.75, "fuzzy", next(o for o, d, *_ in values if d == dim)))
        ranked = sorted(hits.items(), key=lambda h: (-h[1][0], h[1][2], h[0][1]))[:5]
        want |= {(tid, dim, value, conf, kind, k) for k, ((dim, value), (conf, kind, _)) in enumerate(ranked, 1)}
    got = {(r.text_id, r.dimension, r.value, r.confidence, r.match_type, r["rank"]) for r in registry.QUERIES["dimension_value_match_fuzzy"](spark, SMALL).collect()}
    assert got == want and any(g[4] == "fuzzy" for g in got)


def test_texts_go_with_their_pieces(spark):
    from ledgerlens.operators import match as M

    df = spark.createDataFrame([("North", "Consumer"), ("South", None)], "region string, segment string")
    from ledgerlens.roles import Roles
    texts = spark.createDataFrame([("1", "the north and north of consumr consumr"), ("1", "south"), (None, "north")], "text_id string, text string")
    values = M.dimension_values(df, Roles(region="region", segment="segment"))
    assert M.text_pieces(texts.withColumnRenamed("text", "q"), M.anchored(values)).columns == ["text_id", "q", "gram"]
    got = {(r["text_id"], r["value"], r["match_type"]) for r in M.match_values(texts, df, Roles(region="region", segment="segment")).collect()}
    assert {("1", "North", "exact"), ("1", "South", "exact"), ("1", "Consumer", "fuzzy")} <= got and (None, "North", "exact") not in got
