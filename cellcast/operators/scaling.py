"""Train-only means and deviations, and standardised features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.scalar import standardize


def fit(train: DataFrame, names: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations in one aggregation; tiny deviations become 1."""
    row = train.agg(*[f(F.col(n)).alias(f"{k}_{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = [row[f"m_{i}"] or 0.0 for i in range(len(names))]
    stds = [row[f"s_{i}"] for i in range(len(names))]
    return means, [s if s is not None and s >= 1e-9 else 1.0 for s in stds]


def summary(train: DataFrame, names: list[str]) -> DataFrame:
    """``feature``, ``mean``, ``std`` as rows: one aggregation, then one row for each feature."""
    wide = train.agg(*[F.struct(F.lit(n).alias("feature"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("std")).alias(f"f{i}") for i, n in enumerate(names)])
    rows = wide.select(F.explode(F.array(*[F.col(f"f{i}") for i in range(len(names))])).alias("f")).select("f.*")
    return rows.withColumn("std", F.when(F.col("std") < 1e-9, 1.0).otherwise(F.col("std")))


def transform(rows: DataFrame, names: list[str], means: list[float], stds: list[float]) -> DataFrame:
    """The same columns with ``names`` standardised, in one projection."""
    scaled = {n: standardize(F.col(n), m, s).alias(n) for n, m, s in zip(names, means, stds)}
    return rows.select(*[scaled.get(c, F.col(c)) for c in rows.columns])
