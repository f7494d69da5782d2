"""Documents that arrive as files, taken in by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyproof.operators.lines import text_lines


def ingest_lines(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> None:
    """Lines of all documents that have arrived under `source`, written under
    `target` once each: batches go to folders named by their number, so a batch
    that is repeated overwrites its own output. `source` is a folder or a glob."""

    def write(batch: DataFrame, number: int) -> None:
        text_lines(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Events by type in windows of `minutes`; works on streams (with a watermark)
    and on tables alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_windows(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> None:
    """Final windows to `target`, in append mode."""
    counts = windowed_counts(spark.readStream.schema(schema).parquet(source))
    out = counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    out.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
