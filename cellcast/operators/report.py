"""Benchmark tables: speedup, efficiency and resource use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions.parsing import percent_to_double
from cellcast.functions.scalar import safe_ratio


def speedup(runs: DataFrame) -> DataFrame:
    """``workers wall_seconds`` with T1 / Tp and T1 / (p * Tp); T1 is the run with fewest workers.

    Runs are few (one for each number of workers), so one window sees them all.
    """
    base = F.first("wall_seconds").over(Window.orderBy("workers").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fast = safe_ratio(base.cast("double"), F.col("wall_seconds").cast("double"))
    return runs.withColumn("speedup", fast).withColumn("efficiency", safe_ratio(F.col("speedup"), F.col("workers").cast("double")))


def resource_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """Mean and largest CPU share, and largest memory; unreadable samples are ignored."""
    cpu, ram = percent_to_double(F.col("cpu_percent")), percent_to_double(F.col("ram_mb"))
    return samples.groupBy(*keys).agg(F.avg(cpu).alias("cpu_avg_percent"), F.max(cpu).alias("cpu_max_percent"), F.max(ram).alias("ram_peak_mb"))


def cpu_series(samples: DataFrame) -> DataFrame:
    """Each container's CPU shares in order of time."""
    points = samples.select("name", "timestamp", percent_to_double(F.col("cpu_percent")).alias("cpu"))
    return points.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "cpu"))), lambda p: p["cpu"]).alias("cpu_series"))
