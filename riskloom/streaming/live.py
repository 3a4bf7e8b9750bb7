"""An extension: the history aggregates over a stream of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.ranks import risk_name, risk_rank


def live_hotspots(items: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, file, n_flagged, max_risk of streamed findings (timestamp, file, risk).

    State is kept per window and file until the watermark passes, so it does not
    grow with the stream. Findings later than `late` are left out.
    """
    marked = items.withWatermark("timestamp", late)
    grouped = marked.groupBy(F.window("timestamp", window), "file").agg(F.count("*").alias("n_flagged"), F.min(risk_rank(F.col("risk"), 2)).alias("_r"))
    return grouped.select(F.col("window.start").alias("window_start"), "file", "n_flagged", risk_name(F.col("_r")).alias("max_risk"))


def live_trend(items: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, risk, n of streamed findings."""
    grouped = items.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "risk").count()
    return grouped.select(F.col("window.start").alias("window_start"), "risk", F.col("count").alias("n"))


def maintain(files: DataFrame, update, checkpoint: str):
    """Start a query that calls update(batch of changed files, batch number) once per micro-batch."""
    return files.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).start()
