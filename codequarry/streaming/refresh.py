"""Refreshing from a stream of scan rows, and the ledger by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.operators.changes import ChangeTracker, run_readings

SCANS = "scan_id long, run_id long, path string, hash string, size_bytes long, mtime_nanos long, scanned_at timestamp"


def track_changes(spark: SparkSession, folder: str, tracker: ChangeTracker, checkpoint: str, complete: bool = False) -> StreamingQuery:
    """Feed new Parquet files of scan rows below ``folder`` to a ChangeTracker, one version of the state per micro-batch.

    Spark repeats a batch after a failure with the same number; the tracker knows it by its token, so nothing is applied twice.
    The scope is the first segment of the path.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.where("path IS NOT NULL").withColumn("run_id", F.lit(number).cast("long"))
        readings = run_readings(rows).select(F.split("path", "/")[0].alias("scope"), F.col("path").alias("key"), "hash")
        scopes = readings.select("scope").distinct().select("scope", F.lit(complete).alias("complete"), F.lit(number).cast("long").alias("tag"))
        tracker.apply(readings, scopes, f"batch-{number}")

    stream = spark.readStream.schema(SCANS).parquet(folder)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def savings_by_window(ledger: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, command, operations, saved) per tumbling window of ``created_at``; works on a stream, rows later than ``late`` are dropped there."""
    saved = F.greatest(F.col("alternative_tokens") - F.col("output_tokens"), F.lit(0))
    rows = ledger.withWatermark("created_at", late) if ledger.isStreaming else ledger
    grouped = rows.groupBy(F.window("created_at", window).alias("w"), "command").agg(F.count("*").alias("operations"), F.sum(saved).alias("saved"))
    return grouped.select(F.col("w.start").alias("start"), "command", "operations", "saved")
