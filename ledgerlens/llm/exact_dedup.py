"""Exact dedup with a persistent digest index (native).

A document's digest is the SHA-256 of its text with every run of ASCII white space replaced by one space. The index is
a Parquet table bucketed and sorted by digest; a batch is reduced to its distinct digests, held against the index by a
sort-merge anti-join (the index side isn't shuffled), and what is new is appended.

The number of buckets is settled when an index is made, by what it is to hold, and kept beside it. A batch has an id: digests that the
index has under that id count as new, so a batch that is run again after it broke off (before or after its append) keeps the
same rows and appends nothing twice.

Defined results: a null text counts as empty; an empty batch gives no rows and appends nothing; of rows with equal
texts the smallest doc_id stays (null ids count as largest); of repeated rows with the same doc_id and text exactly one
stays; a text of any length is hashed whole where it is scanned. Only ``doc_id`` and ``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import join_unique, keep_rows, materialise, scratch, text_of

#: Runs that differ from one plain space; a lone space needs no replacement.
SPACE_RUN = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*| [\\x20\\x09-\\x0D]+"


def digest_of(text) -> F.Column:
    """SHA-256 (32 bytes) of the text with white space folded."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE_RUN, " "), 256))


#: Digests (some 50 bytes each) that a bucket is planned for, and the fewest buckets.
BUCKET_ROWS, FEWEST = 2_000_000, 64
#: Copies of one row that are emitted from one array.
RUN = 10_000


class DigestIndex:
    """Digests seen so far, at ``path``: columns digest, keep_id, batch, in sorted buckets.

    ``buckets`` (or ``expected``, the digests it is to hold) settles the number of buckets when the index is made. An index
    that is there keeps its own; another number given is refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, expected: int = 0):
        self.spark, self.path = spark, path.rstrip("/")
        kept = self._kept()
        if kept is None:
            kept = buckets or max(FEWEST, -(-expected // BUCKET_ROWS))
            spark.createDataFrame([(kept,)], "buckets int").coalesce(1).write.parquet(self._meta)
        if buckets is not None and buckets != kept:
            raise ValueError(f"the index at {self.path} has {kept} buckets, not {buckets}")
        self.buckets = kept
        self.name = "digest_index_" + hashlib.md5(f"{self.path}|{kept}".encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {kept} BUCKETS LOCATION '{self.path}'")

    @property
    def _meta(self) -> str:
        return f"{self.path}.buckets"

    def _kept(self) -> int | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._meta}/_SUCCESS")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.parquet(self._meta).first()["buckets"]

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def dedup(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """One row per document of the batch: doc_id, digest, keep_id, group_size (in the batch), kept; appends to the index.

        ``batch``: the batch's id, the same when it is run again."""
        pairs = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"))
                            .groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digests")
        groups = materialise(pairs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("copies").alias("group_size")), "groups")
        # dealt like the index's buckets, so the joins below shuffle neither side
        dealt = groups.repartition(self.buckets, "digest")
        batch = batch or uuid.uuid4().hex
        new = (dealt.join(self.table().hint("merge"), "digest", "left_anti")
               .select("digest", F.col("first_id").alias("keep_id"), F.lit(batch).alias("batch")))
        (new.repartition(self.buckets, "digest").write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)
        known = dealt.join(self.table().hint("merge"), "digest").select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("is_new"))
        rows = join_unique(pairs, materialise(known, "known"), ["digest"], "group_size", "inner")
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN)))
        return (rows.withColumn("run", runs)
                .withColumn("copy", F.explode(F.sequence(F.col("run") * RUN + 1, F.least((F.col("run") + 1) * RUN, F.col("copies")))))
                .select("doc_id", "digest", "keep_id", "group_size",
                        (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept")))

    def new_documents(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """The rows of ``docs`` that stay, with all their columns."""
        found = materialise(self.dedup(docs, batch), "kept")
        kept = found.filter("kept").select("doc_id", "digest")
        ties = not found.groupBy("digest", "doc_id").count().filter("count > 1").isEmpty()
        return keep_rows(docs, {"doc_id": F.col("doc_id").cast("long"), "digest": digest_of(text_of())}, kept, ties)


def _index(docs: DataFrame, path: str | None, buckets: int | None) -> DigestIndex:
    spark = docs.sparkSession
    return DigestIndex(spark, path or scratch(spark, "digest-index"), buckets, expected=docs.count())


def exact_dedup(docs: DataFrame, path: str | None = None, buckets: int | None = None, batch: str | None = None) -> DataFrame:
    """``DigestIndex.dedup`` against the index at ``path`` (default: a new, empty one in the shared folder)."""
    return _index(docs, path, buckets).dedup(docs, batch)


def drop_exact_copies(docs: DataFrame, path: str | None = None, buckets: int | None = None, batch: str | None = None) -> DataFrame:
    return _index(docs, path, buckets).new_documents(docs, batch)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h),
n AS (SELECT *, row_number() OVER (PARTITION BY h, doc_id) AS copy FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND copy = 1) AS kept, h AS text_sha256
FROM n JOIN g USING (h)
"""
