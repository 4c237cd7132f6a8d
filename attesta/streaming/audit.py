"""Audit log streams: an append-only sink and windowed rates per client."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends every event once; the checkpoint makes retries idempotent."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def request_rates(events: DataFrame, limit: int, late: str = "1 hour") -> DataFrame:
    """Requests per client and quarter of an hour with the limit's verdict; events later than ``late`` are dropped."""
    w = F.window("ts", "15 minutes")
    counts = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("limited"))
