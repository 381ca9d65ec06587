"""Streams of attempts: windowed accounting with late data, and idempotent checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.store import latest


def windowed_accounting(attempts: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, kind, attempts, value`` per window of ``ts``; batch tables and streams alike.

    On a stream, rows later than ``late`` after the newest are dropped by the watermark.
    """
    events = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("attempts"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "kind", "attempts", "value")


def checkpoint_stream(stream: DataFrame, path: str, keys: list[str], seq: str, checkpoint: str):
    """Append each micro-batch, latest row of each key, below its batch id: a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, keys, seq).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_checkpoints(spark: SparkSession, path: str, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key over all batches that ``checkpoint_stream`` wrote."""
    return latest(spark.read.parquet(path).drop("batch"), keys, seq)


def distinct_attempts(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each attempt once: repeats within ``late`` of the first are dropped, and state older than that is forgotten."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def accounting(attempts: DataFrame, key: str, ts: str, value: str, kind: str = "tumbling", width: str = "1 day", step: str | None = None, late: str = "1 hour") -> DataFrame:
    """``key, start, end, attempts, value`` per tumbling, sliding (every ``step``) or session window (closed after ``width`` without a row)."""
    frame = {"tumbling": lambda: F.window(ts, width), "sliding": lambda: F.window(ts, width, step), "session": lambda: F.session_window(ts, width)}[kind]()
    grouped = attempts.withWatermark(ts, late).groupBy(key, frame.alias("w")).agg(F.count("*").alias("attempts"), F.sum(value).alias("value"))
    return grouped.select(key, "w.start", "w.end", "attempts", "value")
