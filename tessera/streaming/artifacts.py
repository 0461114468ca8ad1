"""Streaming: artifacts ingested as they arrive, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import artifacts as A


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of artifacts (artifact, text) that are put into a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return raw.filter(F.col("length") <= A.MAX_BYTES).select(F.col("path").alias("artifact"), F.decode("content", "utf-8").alias("text"))


def ingest(texts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Coverage lines of a stream of artifacts, appended to a Parquet table by artifact; each batch replaces its artifacts only."""

    def put(batch: DataFrame, epoch: int) -> None:
        rows = A.coverage_rows(batch)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("artifact").parquet(table)

    return texts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows; rows later than ``late`` are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: events that follow one another within ``gap``."""
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
