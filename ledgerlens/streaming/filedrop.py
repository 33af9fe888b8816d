"""Run a batch function on every new batch of files in a folder (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_on_new_files(spark: SparkSession, source_dir: str, schema: str, fn: Callable[[DataFrame], DataFrame],
                     sink_dir: str, checkpoint_dir: str, fmt: str = "csv", available_now: bool = True):
    """Read new ``fmt`` files from ``source_dir`` (header CSV by default), apply ``fn`` to each
    micro-batch and write the result as parquet to ``sink_dir``, one folder per batch id.  ``checkpoint_dir`` must be
    shared storage on a cluster; it records which files were processed."""
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    stream = reader.format(fmt).load(source_dir)

    def handle(batch: DataFrame, epoch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{sink_dir}/batch_id={epoch_id}")   # a retried batch replaces itself

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
