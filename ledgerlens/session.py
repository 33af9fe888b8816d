"""Session helpers: a local session for tests/bench and a shared scratch folder.

On a cluster the session is created by the platform; we only *read*
``spark.checkpoint.dir`` there.  A machine-local folder is used only when the
setting is absent and the master is local (tests, the bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a large table that are worked on at a time, and the most parts that it is cut into.
SLICE_ROWS, MOST_SLICES = 1_000_000, 12


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide scratch folder (``spark.checkpoint.dir``).

    Read from the session; set a local one only when none is configured.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    # make RDD/Dataset checkpoint() write to the same place
    if not (hasattr(sc, "getCheckpointDir") and sc.getCheckpointDir()):
        sc.setCheckpointDir(path)
    return str(path).rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes an execution's shuffle files as soon as it ends: what it made has been written by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_slices(slices: Sequence[DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Write frames one after another as one table; the shuffle files of one are gone before the next begins.  ``_SUCCESS``
    comes with the last, so a write that broke off is not taken for a whole table."""
    for i, df in enumerate(slices):
        writer = df.write.mode("append" if i else mode).format(fmt).options(**({"compression": "zstd"} if fmt == "parquet" else {}), **options)
        with shuffles_removed(df.sparkSession):
            writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(i == len(slices) - 1).lower()).save(path)


def slice_count(df: DataFrame, weight: int = 1) -> int:
    """Into how many slices a table is cut; a small one stays whole.  ``weight``: the rows that one row is worth."""
    with shuffles_removed(df.sparkSession):
        return max(1, min(MOST_SLICES, -(-df.count() * weight // SLICE_ROWS)))


def in_slice(key: Column, i: int, n: int) -> Column:
    """Do the rows of this key belong to slice ``i`` of ``n``?  All rows of a key (NULL as well) are in one slice."""
    return F.lit(True) if n == 1 else F.pmod(F.xxhash64(key), F.lit(n)) == i


def materialise(df: DataFrame | Sequence[DataFrame], name: str) -> DataFrame:
    """Write ``df`` (or slices of a table, one by one) as Parquet into the shared folder and read it back: computed once, lineage
    cut, safe from lost executors, and without the shuffle files that it took."""
    slices = [df] if isinstance(df, DataFrame) else list(df)
    spark = slices[0].sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    write_slices(slices, path, mode="errorifexists")
    return spark.read.schema(slices[0].schema).parquet(path)


def file_signature(spark: SparkSession, path: str) -> str:
    """Names, sizes and modification times of the files at ``path``: changes when the data does.  Lists, reads nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p) if not f.isDirectory())
    return f"{path}|{files}"
