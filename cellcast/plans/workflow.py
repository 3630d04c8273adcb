"""From a raw file to cells, prepared observations, a model and ranked predictions."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.operators import cells as cell_ops
from cellcast.operators import features, grid, logreg, metrics, sampling, scaling, scoring
from cellcast.schemas import OBSERVATION_META
from cellcast.sources import incidents, tables


@dataclass
class Prepared:
    """Standardised observations with their split, and what was learnt from the training part."""

    rows: DataFrame
    names: list[str]
    means: list[float]
    stds: list[float]
    target_info: dict
    persisted: DataFrame | None = None

    def part(self, split: str) -> DataFrame:
        return self.rows.where(F.col("split") == split).drop("split")

    def sizes(self) -> dict[str, int]:
        found = {r["split"]: r["n"] for r in self.rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
        return {s: found.get(s, 0) for s in ("train", "test")}

    def metadata(self) -> dict:
        n = self.sizes()
        return tables.prepared_metadata(self.names, self.means, self.stds, self.target_info, n["train"], n["test"])

    def release(self) -> None:
        """Give the memory of the persisted observations back."""
        if self.persisted is not None:
            self.persisted.unpersist()


def ingest(spark: SparkSession, path: str, min_year: int = 0, max_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """Weekly cells of a raw file, and one row of statistics on what was read."""
    parsed = cell_ops.parse_incidents(incidents.read_csv(spark, path, max_rows))
    return cell_ops.weekly_cells(cell_ops.valid_incidents(parsed, min_year)), cell_ops.loader_stats(parsed, min_year)


def prepare(cells: DataFrame, train_until: int, negative_ratio: int = 0, target_before: str | None = None, names: list[str] | None = None) -> Prepared:
    """Labelled, sampled, split and standardised observations.

    The observations are persisted, as the census, the split and the statistics each read them;
    ``release`` ends that.
    """
    names = names or features.feature_names()
    every = features.observations(cells, target_before).persist(StorageLevel.MEMORY_AND_DISK)
    census = grid.label_census(every).first().asDict()
    kept = sampling.sample_negatives(every, negative_ratio)
    info = census | {"kept_negative_cells": census["negative_cells"] if kept is every else kept.where("label = 0").count(), "negative_ratio": negative_ratio, "target_before": target_before or ""}
    split = sampling.temporal_split(kept, train_until)
    means, stds = scaling.fit(split.where("split = 'train'"), names)
    rows = scaling.transform(split.select(*OBSERVATION_META.fieldNames(), "split", *names), names, means, stds)
    return Prepared(rows, names, means, stds, info, every)


def train(prepared: Prepared, epochs: int = 50, rate: float = 0.05, ridge: float = 0.0) -> tuple[scoring.Model, dict]:
    """A model, and its history and metrics on both parts."""
    started = time.time()
    fit = logreg.train(prepared.part("train"), prepared.names, epochs, rate, ridge, tables=features.code_tables(prepared.names, prepared.means, prepared.stds))
    model = scoring.Model(prepared.names, fit.weights, prepared.means, prepared.stds)
    report = {"history": fit.history, "learning_rate": rate, "lambda_l2": ridge, "epochs": epochs, "target_info": prepared.target_info, "elapsed_seconds": time.time() - started}
    for split in ("train", "test"):
        scored = scoring.score_observations(prepared.part(split), fit.weights, prepared.names).select("label", "score")
        report[f"{split}_metrics"] = metrics.evaluate(scored).first().asDict()
    return model, report


def run(spark: SparkSession, path: str, out: str, train_until: int, min_year: int = 0, negative_ratio: int = 0, target_before: str | None = None, epochs: int = 50, rate: float = 0.05, ridge: float = 0.0, top: int = 0) -> dict:
    """All steps, with their files below ``out``."""
    cells, stats = ingest(spark, path, min_year)
    tables.write_cells_csv(cells, f"{out}/cells")
    prepared = prepare(cells, train_until, negative_ratio, target_before)
    try:
        tables.write_observations(prepared.rows.drop("split"), f"{out}/observations")
        tables.save_json(prepared.metadata(), f"{out}/observations.json")
        model, report = train(prepared, epochs, rate, ridge)
        tables.save_model(f"{out}/model.json", model, **report)
        scored = scoring.score_observations(prepared.part("test"), model.weights, model.feature_names)
        tables.write_predictions_csv(scored, f"{out}/predictions", top)
    finally:
        prepared.release()
    return report | {"loader": stats.first().asDict()}
