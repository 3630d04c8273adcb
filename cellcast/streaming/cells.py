"""Weekly cells and prediction history over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellcast.functions import calendar, scalar
from cellcast.operators.history import append_history


def streaming_weekly_cells(incidents: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Cells of an incident stream.  A week is final when the watermark has passed its end.

    ``occurred_at`` must be a timestamp; windows are weeks that start on Monday.
    """
    group = scalar.crime_group(F.col("primary_type"))
    placed = incidents.withWatermark("occurred_at", lateness).withColumns({"day_of_week": calendar.day_of_week(F.col("occurred_at")), "hour": F.hour("occurred_at"), "_group": group})
    week = F.window("occurred_at", "7 days", "7 days", "4 days")  # the epoch was a Thursday
    cells = placed.groupBy(week, "district", "community_area", "day_of_week", "hour").agg(F.count("*").alias("total_count"), F.count_if(F.col("_group") != "other").alias("relevant_count"), F.count_if(F.col("_group") == "other").alias("other_count"))
    return cells.select(F.to_date("window.start").alias("week_start"), "district", "community_area", "day_of_week", "hour", "total_count", "relevant_count", "other_count")


def stream_history(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of prediction records to the history table."""
    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_history(batch, path)).start()
