"""Line dedup (native).

Lines are exploded with their position, normalised to a key and hashed to 128 bits; Spark counts the distinct documents
of each hash; lines whose key is in at least ``min_docs`` documents go everywhere but in the largest doc_id that holds the
key; the rest is put together again by position.

The keys of a document are made distinct before the shuffle, and distinct documents are counted on (key, document) first
and on the key second, so a line that all documents share is spread by document. The keys to drop come back with
the heaviest ones broadcast (a bounded top-k) and the others by a shuffled join.

Defined results: a null or empty text is one empty line; documents are told apart by doc_id (a null id counts as one
document, and never as the largest unless there is no other); rows that repeat a doc_id are handled one by one and each
give a row; equal keys within a document count once and go or stay together; a text of any number of lines is rebuilt in one
walk over its dropped positions. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ASCII_SPACE, LOWER, UPPER, join_unique, materialise, text_of

MIN_CHARS, MIN_DOCS = 20, 3


def key_of(line):
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    key = F.btrim(line, F.lit(ASCII_SPACE))
    # lower() folds other letters too, so it is only right (and faster) for ASCII
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, pos, a, b of every line whose key has at least ``min_chars`` code points; (a, b) is the key's hash."""
    lines = _documents(docs).select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_key", "pos", key_of(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def repeated_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """a, b, keeper (the doc_id whose lines stay), n_docs of the keys found in at least ``min_docs`` documents."""
    per_doc = hashes.groupBy("a", "b", "doc_id").agg(F.count("*").alias("n"))
    return (per_doc.groupBy("a", "b").agg(F.max("doc_id").alias("keeper"), F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"))
            .filter(F.col("n_docs") >= min_docs))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, kept (the text that stays)."""
    hashes = materialise(line_hashes(docs, min_chars), "lines")
    repeated = materialise(repeated_lines(hashes, min_docs), "repeated")
    drops = (join_unique(hashes, repeated, ["a", "b"], "n_lines", "inner").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
             .groupBy(_doc_key("doc_id").alias("doc_key"), "text_key").agg(F.sort_array(F.collect_set("pos")).alias("drop"), F.count("*").alias("weight")))
    own = _documents(docs).withColumn("doc_key", _doc_key("doc_id"))
    # a row that is repeated very often meets its positions by broadcast
    both = join_unique(own, materialise(drops, "drops"), ["doc_key", "text_key"], "weight")
    found = both.select("doc_id", _bind(F.struct(F.split("text", "\n").alias("lines"), F.col("drop"), F.col("text")), _kept).alias("out"))
    return found.select("doc_id", F.col("out.n_lines").cast("long").alias("n_lines"), F.col("out.n_dropped").cast("long").alias("n_dropped"), F.col("out.kept").alias("kept"))


def _doc_key(doc_id: str):
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def _bind(value, use):
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _kept(row):
    """n_lines, n_dropped and the text that stays: the stretches of lines between the dropped positions, in one walk."""
    lines, drop = row["lines"], row["drop"]

    def between(edges):
        stretches = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.slice(lines, F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1))
        return F.array_join(F.flatten(stretches), "\n")

    edges = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    return F.struct(F.size(lines).alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).alias("n_dropped"),
                    F.when(drop.isNull(), row["text"]).otherwise(_bind(edges, between)).alias("kept"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, rid, unnest(generate_series(1, len(lines))) AS pos, unnest(lines) AS line FROM d),
k AS MATERIALIZED (SELECT doc_id, rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 3),
x AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM x GROUP BY rid, doc_id
"""
