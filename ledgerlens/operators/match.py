"""Dimension-value matching (C12): find dimension values mentioned in texts.

Exact / partial hits.  Every value is represented by one substring (up to 8
characters, the one fewest values share), its anchor.  A text that contains a
value contains its anchor, so texts and values meet in an equi-join on anchors,
and only the joined pairs are verified with ``contains`` and a word-boundary
pattern.  Before that join, all anchors are hashed into one bit array of fixed
size (an aggregate, broadcast as one row) together with the lengths they have: a
text looks its substrings of those lengths up in it and sends only the few that
may be anchors to the shuffle.

Fuzzy hits (words of 3+ characters) follow
``difflib.get_close_matches(word, values, n=1, cutoff=0.88)``.  A ratio of 0.88
over lengths la and lb means m = ceil(0.44 (la + lb)) matched characters or more, in
at most la + lb - 2 m + 1 blocks, so word and value share 3 m - (la + lb) - 1
bigrams at least (repeats counted).  With every side's bigrams ordered by rarity
among the values, two such sets share one within their first n - s + 1; only
these prefixes are joined (by both lengths and bigram).  Pairs then have to share
the least number, and only those reach the difflib ratio in a pandas UDF.  The
value is the first sequence and the word the second, as there: the ratio isn't
symmetric.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.roles import Roles
from ledgerlens.session import in_slice, materialise, slice_count

# --- fixed values --------------------------------------------------------
SEARCH_DIMENSIONS = ("category", "subcategory", "product", "region", "state", "city", "country", "customer", "segment")
MIN_VALUE_LENGTH = 3
FUZZY_CUTOFF = 0.88
CONF_EXACT, CONF_PARTIAL, CONF_FUZZY = 1.0, 0.85, 0.75
TOP_PER_TEXT = 5
GRAM = 8                        # longest substring that values are looked up by
TEXT_WEIGHT = 4                 # rows of a table that a text is worth when texts are cut into slices
FILTER_BITS = 1 << 23           # bits of the anchors' filter: one row of 1 MB whatever the data
# ------------------------------------------------------------------------


def dimension_values(df: DataFrame, roles: Roles, dims=SEARCH_DIMENSIONS) -> DataFrame:
    """(dim_order, dimension, column, value, lv) for distinct values with >= 3 characters."""
    parts = []
    for i, d in enumerate(dims):
        c = roles.present(d, df.columns)
        if c:
            parts.append(df.select(F.lit(i).alias("dim_order"), F.lit(d).alias("dimension"), F.lit(c).alias("column"),
                                   F.col(c).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct())
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.withColumn("lv", F.trim(F.lower("value"))).where(F.length("lv") >= MIN_VALUE_LENGTH)


def _grams(col: str, size) -> F.Column:
    """Distinct substrings of ``size`` characters (a literal or a column)."""
    s = F.col(col)
    k = F.lit(size) if isinstance(size, int) else size
    return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substr(s, i, k))))


def anchored(values: DataFrame) -> DataFrame:
    """``values`` with the one of each value's substrings that the fewest values share."""
    size = F.least(F.length("lv"), F.lit(GRAM))
    grams = values.select("dim_order", "dimension", "column", "value", "lv", size.alias("k")) \
                  .select("*", _grams("lv", F.col("k")).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("owners"))
    return grams.join(shared, "gram").groupBy("dim_order", "dimension", "column", "value", "lv") \
                .agg(F.min_by("gram", F.struct("owners", "gram")).alias("gram"))


def _bit(gram) -> F.Column:
    return F.pmod(F.xxhash64(gram), F.lit(FILTER_BITS))


def anchor_filter(anchors: DataFrame) -> DataFrame:
    """One row of fixed size: ``bits``, FILTER_BITS bits in 64-bit words with one set per anchor, and the anchors' lengths."""
    words = anchors.groupBy(F.shiftright(_bit(F.col("gram")), 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (_bit(F.col("gram")) % 64).cast("int"))).alias("word"))
    # the set words in order, the others as zeros between them
    gaps = Window.orderBy("at")   # at most FILTER_BITS / 64 rows
    filled = words.withColumn("zeros", F.col("at") - F.coalesce(F.lag("at").over(gaps), F.lit(-1)) - 1)
    runs = F.transform(F.array_sort(F.collect_list(F.struct("at", "zeros", "word"))), lambda r: F.concat(F.array_repeat(F.lit(0).cast("long"), r["zeros"].cast("int")), F.array(r["word"])))
    sizes = anchors.agg(F.collect_set(F.length("gram")).alias("sizes"))
    return filled.agg(F.flatten(runs).alias("bits")).crossJoin(sizes)


def text_pieces(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """text_id, q, gram: each text with its substrings that may be anchors."""
    both = texts.where((F.length("q") >= MIN_VALUE_LENGTH) & F.col("text_id").isNotNull()).crossJoin(F.broadcast(anchor_filter(anchors)))   # one row of fixed size

    def of_size(k):
        return F.transform(F.sequence(F.lit(1), F.length("q") - k + 1), lambda i: F.substr(F.col("q"), i, k))

    def known(gram):
        word = F.get("bits", F.shiftright(_bit(gram), 6).cast("int"))   # NULL beyond the last word that is set
        return F.getbit(word, (_bit(gram) % 64).cast("int")) == 1

    fitting = F.filter("sizes", lambda k: k <= F.length("q"))
    return both.select("text_id", "q", F.explode(F.array_distinct(F.flatten(F.transform(fitting, lambda k: F.filter(of_size(k), known))))).alias("gram"))


def exact_partial_hits(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Exact (word-boundary) and partial (substring) hits, one row per (text, value); ``anchors``: those of the values."""
    pairs = text_pieces(texts, anchors).join(anchors, "gram").drop("gram").where(F.contains("q", "lv"))
    quoted = F.concat(F.lit("(?U)\\b\\Q"), F.replace(F.col("lv"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\b"))
    exact = F.regexp_like("q", quoted)
    return pairs.select("text_id", "dim_order", "dimension", "column", "value",
                        F.when(exact, CONF_EXACT).otherwise(CONF_PARTIAL).alias("confidence"),
                        F.when(exact, "exact").otherwise("partial").alias("match_type")).distinct()


def _ratio_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    import difflib
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _numbered_bigrams(col: str) -> F.Column:
    """The bigrams of a text, a repeated one told apart by its number."""
    s = F.col(col)
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))
    count = lambda all_, g, i: F.size(F.filter(F.slice(all_, 1, i + 1), lambda x: x == g)).cast("string")
    return F.get(F.transform(F.array(pairs), lambda all_: F.transform(all_, lambda g, i: F.concat(g, count(all_, g, i)))), 0)


def _least_shared(la, lb) -> F.Column:
    """Bigrams that a ratio of FUZZY_CUTOFF implies between texts of these lengths."""
    both = la + lb
    return 3 * F.ceil(FUZZY_CUTOFF / 2 * both - 1e-9) - both - 1


def _prefixes(rows: DataFrame, text: str, own: str, other: str, rarity: DataFrame) -> DataFrame:
    """(own, other, bigram, text): for every length of the other side that the ratio allows, the bigrams of the prefix."""
    n = F.length(text)
    ranked = (rows.select(text, F.explode(_numbered_bigrams(text)).alias("bigram")).join(rarity, "bigram", "left")
              .groupBy(text).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("owners", F.lit(0)).alias("owners"), "bigram"))).alias("by_rarity")))
    short = F.ceil(n * (FUZZY_CUTOFF / (2 - FUZZY_CUTOFF)) - 1e-9).cast("int")
    far = F.floor(n * ((2 - FUZZY_CUTOFF) / FUZZY_CUTOFF) + 1e-9).cast("int")
    sized = ranked.select(text, "by_rarity", n.alias(own), F.explode(F.sequence(short, far)).alias(other))
    length = (F.col(own) - _least_shared(F.col(own), F.col(other))).cast("int")
    return sized.where(length > 0).select(text, own, other, F.explode(F.slice("by_rarity", F.lit(1), length)).alias("b")).select(text, own, other, "b.bigram")


def fuzzy_pairs(vocab: DataFrame, names: DataFrame) -> DataFrame:
    """(w, lv): words and value texts that share the bigrams which the cutoff implies; no pair at or above it is left out."""
    rarity = materialise(names.select("lv", F.explode(_numbered_bigrams("lv")).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("owners")), "bigrams")
    words = _prefixes(vocab, "w", "la", "lb", rarity)
    held = _prefixes(names, "lv", "lb", "la", rarity)
    pairs = words.join(held, ["la", "lb", "bigram"]).select("w", "lv").distinct()
    shared = F.size(F.array_intersect(_numbered_bigrams("w"), _numbered_bigrams("lv")))
    return pairs.where(shared >= _least_shared(F.length("w"), F.length("lv")))


def words_of(texts: DataFrame) -> DataFrame:
    """text_id, w: the texts' words of 3+ alphanumerics."""
    return texts.select("text_id", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"([a-zA-Z0-9]+)"), 1))).alias("w")) \
                .where(F.length("w") >= MIN_VALUE_LENGTH)


def fuzzy_words(texts: DataFrame, values: DataFrame) -> DataFrame:
    """The texts' words that are close to a value: the best value per word and dimension."""
    vocab = words_of(texts).select("w").distinct()          # score each distinct word once, then join back to texts
    pairs = fuzzy_pairs(vocab, values.select("lv").distinct())
    ratio = F.pandas_udf(_ratio_batch, "double")   # created here: module import must not need a session
    scored = pairs.withColumn("score", ratio(F.col("lv"), F.col("w"))).where(F.col("score") >= FUZZY_CUTOFF).join(values, "lv")
    # get_close_matches keeps the best candidate per word (score, then candidate text, highest first)
    w = Window.partitionBy("w", "dimension").orderBy(F.col("score").desc(), F.col("lv").desc(), F.col("value"))
    # written, so that its size is known: few words match, and the texts' words stay where they are
    return materialise(scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn"), "fuzzy-words")


def fuzzy_hits(texts: DataFrame, values: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Words of 3+ alphanumerics vs values, best value per word and dimension (``best``: those of all texts if at hand)."""
    best = fuzzy_words(texts, values) if best is None else best
    return words_of(texts).join(best, "w").select("text_id", "dim_order", "dimension", "column", "value", F.lit(CONF_FUZZY).alias("confidence"),
                       F.lit("fuzzy").alias("match_type"))


def match_values(texts: DataFrame, df: DataFrame, roles: Roles, fuzzy: bool = True, top: int = TOP_PER_TEXT, slices: int | None = None) -> DataFrame:
    """Best ``top`` (column, value) matches per text: confidence, then dimension order, then value.

    Anchors and the words' values are made once for all texts.  Many texts are then matched in slices (``slices``, or by their
    number), each written before the next begins: what a text's pieces and hits take on disk is that of one slice."""
    q = texts.select(F.col("text_id").cast("string"), F.lower(F.col("text")).alias("q"))
    vals = dimension_values(df, roles)
    anchors = materialise(anchored(vals), "anchors")
    best = fuzzy_words(q, vals) if fuzzy else None
    n = slice_count(q, weight=TEXT_WEIGHT) if slices is None else slices
    found = [_best_matches(q.where(in_slice(F.col("text_id"), i, n)), vals, anchors, best, top) for i in range(n)]
    return found[0] if n == 1 else materialise(found, "matches")


def _best_matches(q: DataFrame, values: DataFrame, anchors: DataFrame, best: DataFrame | None, top: int) -> DataFrame:
    hits = exact_partial_hits(q, anchors)
    if best is not None:
        hits = hits.unionByName(fuzzy_hits(q, values, best))
    w1 = Window.partitionBy("text_id", "column", "value").orderBy(F.col("confidence").desc())
    dedup = hits.withColumn("_k", F.row_number().over(w1)).where(F.col("_k") == 1).drop("_k")
    w2 = Window.partitionBy("text_id").orderBy(F.col("confidence").desc(), F.col("dim_order"), F.col("value"))
    return dedup.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= top).drop("dim_order")
