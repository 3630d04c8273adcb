"""Dense grid of cells with next week's label, and what is measured over it.

The grid holds every observed zone in every observed week for all 168 hours of the week.  Weeks
and hours are exploded from arrays (the weeks of the data are a calendar, so their array is small
whatever the number of incidents); counters come by one join on the full cell key, which is also
the partitioning of every window over cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions.calendar import add_weeks, week_index
from cellcast.operators import cells as cell_ops
from cellcast.schemas import CELL_KEYS, COUNTERS


def dense_cells(cells: DataFrame) -> DataFrame:
    """All zones x weeks x weekdays x hours with zero counters where nothing happened."""
    slots = every_week(cells, cells.select("district", "community_area").distinct())
    slots = slots.select("*", F.explode(F.sequence(F.lit(0), F.lit(167))).alias("slot"))
    slots = slots.withColumns({"day_of_week": slot_day(F.col("slot")), "hour": slot_hour(F.col("slot"))})
    counted = slots.join(cells.select("week_start", *CELL_KEYS, *COUNTERS), ["week_start", *CELL_KEYS], "left")
    counters = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTERS]
    return counted.select("week_start", *CELL_KEYS, *counters, week_index(F.col("week_start")).alias("week_no"), "last_week")


def slot_day(slot):
    return F.floor(slot / 24).cast("int")


def slot_hour(slot):
    return (slot % 24).cast("int")


def every_week(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` in every observed week, with ``week_start`` and the ``last_week`` of all.

    The weeks of the data are a calendar: one row with an array, whatever the number of cells.
    """
    weeks = cells.select("week_start").distinct().agg(F.sort_array(F.collect_list("week_start")).alias("weeks"))
    placed = keys.join(F.broadcast(weeks))
    return placed.select(*keys.columns, F.explode("weeks").alias("week_start"), F.array_max("weeks").alias("last_week"))


def cell_window(first: int, last: int):
    return Window.partitionBy(*CELL_KEYS).orderBy("week_no").rangeBetween(first, last)


def labelled(dense: DataFrame) -> DataFrame:
    """Adds ``target_week_start``, ``next_week_relevant_count`` and ``label``; a gap week counts 0."""
    following = F.coalesce(F.sum("relevant_count").over(cell_window(1, 1)), F.lit(0).cast("long"))
    out = dense.withColumns({"target_week_start": add_weeks(F.col("week_start"), 1), "next_week_relevant_count": following})
    return out.withColumn("label", (F.col("next_week_relevant_count") > 0).cast("double"))


def candidates(grid: DataFrame, target_before: str | None = None) -> DataFrame:
    """Base weeks only: all but the last observed, with a target before the cutoff.

    A blank or unreadable cutoff keeps all.  The grid says itself which week is the last.
    """
    from cellcast.functions.parsing import parse_week

    rows = grid.where("week_start < last_week").drop("last_week")
    if not (target_before or "").strip():
        return rows
    cutoff = parse_week(F.lit(target_before.strip()))
    return rows.where(cutoff.isNull() | (F.col("target_week_start") < cutoff))


def label_census(rows: DataFrame) -> DataFrame:
    """Candidate, positive and negative cells."""
    return rows.agg(F.count("*").alias("candidate_cells"), F.count_if(F.col("label") == 1).alias("positive_cells"), F.count_if(F.col("label") == 0).alias("negative_cells"))
