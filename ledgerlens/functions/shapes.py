"""Shapes of text values: what can be a number or a date is decided per shape, not per value.

A value's shape has 9 for every digit and ``a`` for every letter that no number holds, long stretches shortened; text
without digits and text of many words have one shape each.  The shapes of all columns are counted in one aggregate.
Whether a text is a number follows from its shape alone, so number shares are exact without looking at values again;
whether it is a date needs the value, but only in columns where enough shapes allow one, and only by the rules that
those shapes ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import DAY_NAME_YEAR, ISO_SHAPE, NAME_DAY_YEAR, NAME_YEAR, NUMERIC_SHAPE, plain_words
from ledgerlens.functions.scalars import safe_numeric

# --- fixed values --------------------------------------------------------
NUMBER_LETTERS = "RsINUSDeE"            # letters of money tokens and exponents
DIGIT_RUN, LETTER_RUN = 9, 12           # longer stretches are cut to this (a month name has at most 9 letters)
WORDLESS, WORDY = "a", "a a a"          # shapes of text without digits, and of text with more than two words
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# ------------------------------------------------------------------------

_OTHER_LETTER = rf"(?U)[\p{{L}}&&[^{NUMBER_LETTERS}]]"   # no number holds it
_ISO_START = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}"


def shape_of(c: Column) -> Column:
    """The shape of a text (NULL for NULL).  Letters stay only where all of a text's letters may belong to a number."""
    digits = F.regexp_replace(F.translate(c, "012345678", "9" * 9), "9{%d,}" % DIGIT_RUN, "9" * DIGIT_RUN)
    spoken = F.regexp_replace(F.regexp_replace(digits, r"(?U)\p{L}", "a"), "a{%d,}" % LETTER_RUN, "a" * LETTER_RUN)
    wordy = c.rlike(r"(?U)(\p{L}+[^\p{L}]+){2}\p{L}") & ~c.rlike(_ISO_START)
    return (F.when(~c.rlike("[0-9]"), F.lit(WORDLESS))
            .when(c.rlike(_OTHER_LETTER), F.when(wordy, F.lit(WORDY)).otherwise(spoken)).otherwise(digits))


def _masked(at: list[int]):
    """Per batch and column the texts with 9 for every digit, equal ones counted; a text and its mask have one shape."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        nines = np.arange(256, dtype=np.uint8)
        nines[ord("0"):ord("9")] = ord("9")
        for b in batches:
            parts = []
            for i, c in zip(at, b.columns):
                valid, ends, data = c.buffers()
                if data is not None:
                    c = pa.Array.from_buffers(c.type, len(c), [valid, ends, pa.py_buffer(nines[np.frombuffer(data, np.uint8)])], offset=c.offset)
                found = c.value_counts()
                parts.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), found.field("values"), found.field("counts")], ["position", "value", "n"]))
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return run


def shape_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """position, shape, n: the shapes of the text columns (NULL is one), counted in one aggregate.  Numbers and dates have
    few masks, so the shape is worked out for few texts of a batch; all columns share its one expression (one
    each made code too long to be compiled)."""
    at = [i for i, (c, t) in enumerate(df.dtypes) if t == "string" and (cols is None or c in cols)]
    if not at:
        return df.sparkSession.createDataFrame([], "position int, shape string, n long")
    masks = df.select(*[F.col(f"`{df.columns[i]}`").alias(f"c{i}") for i in at]).mapInArrow(_masked(at), "position int, value string, n long")
    return masks.select("position", shape_of(F.col("value")).alias("shape"), "n").groupBy("position", "shape").agg(F.sum("n").alias("n"))


def date_rule(shape: Column) -> Column:
    """The parsing rule that a shape may ask for: iso, compact, numeric, named, or NULL when it can't be a date."""
    s = F.trim(shape)
    words = plain_words(s)
    named = words.rlike(DAY_NAME_YEAR) | words.rlike(NAME_DAY_YEAR) | words.rlike(NAME_YEAR)
    return F.when(s.rlike(ISO_SHAPE), "iso").when(s == "9" * 8, "compact").when(s.rlike(NUMERIC_SHAPE), "numeric").when(named, "named")


def summary(shapes: DataFrame) -> dict[int, dict]:
    """Per column position: rows, values, numbers, plain (all values are plain numbers), loose (numbers with thousands
    commas only), dates (values whose shape allows one) and rules.  A few numbers a column reach the driver."""
    t = shapes.withColumn("rule", date_rule(F.col("shape")))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    loose = F.regexp_replace(F.trim("shape"), ",", "").try_cast("double").isNotNull()
    rows = t.groupBy("position").agg(
        F.sum("n").alias("rows"), n(F.col("shape").isNotNull()).alias("values"), n(safe_numeric(F.col("shape")).isNotNull()).alias("numbers"),
        F.min(F.when(F.col("shape").isNotNull(), F.col("shape").rlike(PLAIN_NUMBER))).alias("plain"), n(loose).alias("loose"),
        n(F.col("rule").isNotNull()).alias("dates"), F.collect_set("rule").alias("rules")).collect()
    return {r["position"]: r.asDict() for r in rows}
