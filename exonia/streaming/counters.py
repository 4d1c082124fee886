"""Statistics of files as they arrive: counts add up, so each micro-batch is counted and merged into a table of totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merged_counts(stream: DataFrame, count: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes the counts of each micro-batch to folder/batch=ID.

    count makes a batch's counts, a table with `n`. A batch that is run again after a failure overwrites its own part, so
    that nothing counts twice."""

    def one(batch: DataFrame, batch_id: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all batches so far added up; all columns but n and batch are the key."""
    parts = spark.read.parquet(folder)
    keys = [c for c in parts.columns if c not in ("n", "batch")]
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"))


def late_exon_counts(models: DataFrame, delay: str = "7 days", window: str = "1 day") -> DataFrame:
    """(window, organism, n) of a stream of gene models by load time, with a watermark for late ones."""
    at = models.withColumn("_at", F.col("loaded_at").cast("timestamp")).withWatermark("_at", delay)
    return at.groupBy(F.window("_at", window), "organism").agg(F.count("*").alias("n"))
