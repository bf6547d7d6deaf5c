"""Streaming counterpart of the event-log operators (an extension): event files as they arrive, each edge once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, ts, sender, receiver) from JSON lines as files arrive."""
    return spark.readStream.schema("run_id string, ts timestamp, sender string, receiver string").json(folder)


def distinct_edges(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each (run_id, sender, receiver) once; state older than the watermark is dropped, so late repeats beyond it may come again."""
    return events.filter("sender <> '' and receiver <> ''").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["run_id", "sender", "receiver"])


def children_per_window(events: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Spawn relations of each sender in tumbling windows, about as many different receivers as were seen."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "run_id", "sender").agg(F.count(F.lit(1)).alias("relations"), F.approx_count_distinct("receiver").alias("receivers"))
