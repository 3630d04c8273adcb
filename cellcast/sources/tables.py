"""Prepared observations, aggregates, models and other files of the engine."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cellcast.functions.parsing import number_or_zero
from cellcast.functions.scalar import round4
from cellcast.operators.ranking import ranked, sorted_cells
from cellcast.operators.scoring import Model
from cellcast.schemas import CELL_KEYS, OBSERVATION_META


class FeatureMismatch(ValueError):
    """Feature columns are not the expected ones in the expected order."""


def check_features(found: list[str], expected: list[str]) -> None:
    if len(found) != len(expected):
        raise FeatureMismatch(f"{len(found)} features, {len(expected)} expected")
    for i, (a, b) in enumerate(zip(found, expected)):
        if a != b:
            raise FeatureMismatch(f"feature {i + 1} is {a}, expected {b}")


def write_cells_csv(cells: DataFrame, path: str, single_file: bool = False) -> None:
    """Aggregates in the order of their keys; a single file only for small results."""
    rows = sorted_cells(cells.withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd")))
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").option("header", True).csv(path)


def write_observations(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet by default, as its readers then scan only the columns they need; or gzipped CSV."""
    writer = rows.write.mode("overwrite")
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).option("compression", "gzip").csv(path)


def read_observations(spark: SparkSession, path: str, names: list[str], kind: str = "parquet") -> DataFrame:
    """Meta columns and features.  Unreadable integers are 0 and short CSV rows are skipped."""
    meta = OBSERVATION_META.fieldNames()
    if kind == "parquet":
        rows = spark.read.parquet(path)
        check_features([c for c in rows.columns if c not in meta], names)
        return rows.select(*meta, *names)
    found = spark.read.option("header", True).csv(path).columns
    check_features(found[len(meta) :], names)
    text = spark.read.option("header", True).csv(path).where(F.col(meta[-1]).isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in OBSERVATION_META}
    clean = lambda c: F.col(c).try_cast("date") if kinds[c] == "date" else number_or_zero(F.col(c), kinds[c])
    return text.select(*[clean(c).alias(c) for c in meta], *[F.col(f"`{n}`").cast("double").alias(n) for n in names])


def read_vectors(spark: SparkSession, path: str, names: list[str], max_rows: int = 0, kind: str = "parquet") -> DataFrame:
    """Only what training needs: ``features`` and ``label``."""
    from cellcast.operators.logreg import vectors

    rows = vectors(read_observations(spark, path, names, kind), names)
    return rows.limit(max_rows) if max_rows > 0 else rows


def observation_csv_schema(names: list[str]) -> StructType:
    return StructType([*OBSERVATION_META.fields, *[StructField(n, DoubleType()) for n in names]])


def write_evidence_csv(rows: DataFrame, path: str, names: list[str], max_rows: int) -> None:
    """The first rows for people to read: six decimals, the label under its long name."""
    meta = [c for c in OBSERVATION_META.fieldNames() if c != "label"]
    shown = rows.limit(max_rows) if max_rows > 0 else rows
    shown.select(*meta, F.col("label").cast("int").alias("target_occurred_next_week"), *[F.format_string("%.6f", F.col(n).cast("double")).alias(n) for n in names]).write.mode("overwrite").option("header", True).csv(path)


def ranked_predictions(scored: DataFrame, max_rows: int = 0) -> DataFrame:
    """Observations by falling score with their ranked level; the level counts all rows."""
    rows = ranked(scored, ["week_start", *CELL_KEYS]).orderBy("rank")
    rows = rows.limit(max_rows) if max_rows > 0 else rows
    return rows.select(
        "week_start", "target_week_start", *CELL_KEYS, round4(F.col("score")).alias("risk_score_estimated"), F.col("risk_level").alias("risk_level_ranked"),
        F.col("label").cast("int").alias("target"), "next_week_relevant_count", "current_minor_count", "current_total_incidents",
    )


def write_predictions_csv(scored: DataFrame, path: str, max_rows: int = 0) -> None:
    ranked_predictions(scored, max_rows).write.mode("overwrite").option("header", True).csv(path)


def save_json(value, path: str) -> None:
    """Indented by two, at any path that Spark can write."""
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


def load_json(path: str) -> dict:
    return json.loads(SparkSession.active().read.text(path, wholetext=True).first()[0])


def load_model(path: str) -> Model:
    raw = load_json(path)
    return Model(raw["feature_names"], raw["weights"], raw.get("means") or [], raw.get("stds") or [])


def save_model(path: str, model: Model, **more) -> None:
    save_json({"feature_names": model.feature_names, "weights": model.weights, "means": model.means, "stds": model.stds} | more, path)


def prepared_metadata(names: list[str], means: list[float], stds: list[float], census: dict, train: int, test: int) -> dict:
    """Sidecar of prepared observations."""
    return {"feature_names": names, "means": means, "stds": stds, "target_info": census, "train_observations": train, "test_observations": test}


def load_metadata(path: str, names: list[str] | None = None) -> dict:
    """A sidecar; with ``names``, its features must be these."""
    found = load_json(path)
    if names is not None:
        check_features(found["feature_names"], names)
    return found
