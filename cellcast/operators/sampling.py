"""Negative down-sampling and the temporal splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.scalar import cell_hash
from cellcast.operators.grid import label_census
from cellcast.schemas import CELL_KEYS


def negative_modulus(positives: int, negatives: int, ratio: int) -> int:
    """Every how many-th negative is kept by its hash; 1 keeps all."""
    wanted = positives * ratio
    if ratio <= 0 or wanted <= 0 or wanted >= negatives:
        return 1
    return max(1, math.ceil(negatives / wanted))


def sample_negatives(rows: DataFrame, ratio: int) -> DataFrame:
    """All positives, and negatives thinned to about ``ratio`` for each positive."""
    if ratio <= 0:
        return rows
    census = label_census(rows).first()
    modulus = negative_modulus(census["positive_cells"], census["negative_cells"], ratio)
    return rows if modulus == 1 else rows.where((F.col("label") == 1) | (cell_hash(F.col("week_start"), *[F.col(k) for k in CELL_KEYS]) % modulus == 0))


def split_by_year(rows: DataFrame, train_until: int) -> DataFrame:
    """``split`` by the year of the target week, so that no label leaks from a later year."""
    return rows.withColumn("split", F.when(F.year("target_week_start") <= train_until, "train").otherwise("test"))


def fallback_cut(weeks: list, fraction: float = 0.8):
    """First target week of the test part when the weeks are divided by number."""
    at = min(max(int(len(weeks) * fraction), 1), len(weeks) - 1)
    return weeks[at]


def temporal_split(rows: DataFrame, train_until: int) -> DataFrame:
    """Split by year; if that leaves too little to train or nothing to test, by number of weeks.

    Only row counts and the distinct target weeks (a calendar) reach the driver.
    """
    halves = split_by_year(rows, train_until)
    counts = {r["split"]: r["n"] for r in halves.groupBy("split").agg(F.count("*").alias("n")).collect()}
    train, test = counts.get("train", 0), counts.get("test", 0)
    total = train + test
    if total <= 10 or (train >= int(0.2 * total) and test):
        return halves
    weeks = [r[0] for r in rows.select("target_week_start").distinct().orderBy("target_week_start").collect()]
    return rows.withColumn("split", F.when(F.col("target_week_start") < F.lit(fallback_cut(weeks)), "train").otherwise("test"))
