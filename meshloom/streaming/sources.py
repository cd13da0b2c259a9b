"""An addition beyond the batch queries: heat sources per cell from a stream of events, with watermark and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_sources(events: DataFrame, cells: int, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, cell_id, q, n) of a stream of events(event_id, ts, value); later events than ``late`` are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), F.pmod("event_id", F.lit(cells)).alias("cell_id")).agg(F.sum("value").alias("q"), F.count("*").alias("n"))
