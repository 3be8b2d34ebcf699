"""The append-only journal as a stream: each source id is observed once, whatever arrives again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observe(spark: SparkSession, source: str, schema: str, key: str, target: str, checkpoint: str, files_per_trigger: int = 8) -> None:
    """Append new rows of Parquet files below ``source`` to ``target``, one for each ``key``.

    Duplicates within and across batches are dropped by the stream's own state; what is
    available is processed in bounded batches, and the checkpoint makes a restart go on where it stopped.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    once = rows.dropDuplicates([key]).withColumn("digest", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    run = once.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    run.awaitTermination()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and day with a watermark, for a streaming or a batch frame."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def growth(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """How much each group grew between two snapshots."""
    a, b = (x.groupBy(by).agg(F.count("*").alias(n)) for x, n in ((before, "n_before"), (after, "n_after")))
    return b.join(a, by, "full").select(by, (F.coalesce("n_after", F.lit(0)) - F.coalesce("n_before", F.lit(0))).alias("growth"))
