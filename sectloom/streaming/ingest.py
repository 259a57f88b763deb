"""Streams: versioned ingest of chunks, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectloom.operators.lifecycle import newest


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], version: str, tie: str):
    """Reads new parquet files of ``source`` as a stream and appends each batch's newest rows to ``target``, in a
    folder of its batch; readers take the newest version of a key. A batch that runs again overwrites
    its own folder, so nothing is written twice. Returns the finished query."""

    def write(batch: DataFrame, n: int) -> None:
        newest(batch, keys, version, tie).write.mode("overwrite").parquet(f"{target}/batch={n}")

    q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by kind in event-time windows; rows later than the watermark are dropped in a stream, never in a table."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return e.groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str) -> DataFrame:
    """Sessions of each user: runs of events with gaps shorter than ``gap``."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
