"""Logistic regression by full-batch gradient descent.

The observations are packed once into cached blocks of ``BLOCK`` rows, so an epoch moves memory
instead of values.  Features that follow from a small code (one-hots from a number, calendar
features from an hour of the week and a month) need not be stored: a block holds the code, and the
features' part of the score is looked up in the table of the code's values, which gives the same
sums.  One job an epoch: the weights are broadcast, each partition multiplies its blocks in numpy
and returns one row of sums.  These are added up by some tasks first where there are many
partitions, so that the driver adds ``ROWS_TO_DRIVER`` rows at most.  A lost block is packed again
from its lineage.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and blocks of an Arrow batch.
BLOCK, BATCH = 16_384, 2
ROWS_TO_DRIVER = 64

SUMS = "gradient array<double>, loss double, count long"


@dataclass
class Fit:
    weights: list[float]
    history: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class CodeTable:
    """Features that are functions of a code: ``values`` has a row for each code from 0."""

    code: Column
    names: list[str]
    values: np.ndarray


def vectors(rows: DataFrame, names: list[str], label: str = "label", tables: list[CodeTable] | None = None) -> DataFrame:
    """``features``, ``label`` and, with tables, ``codes`` only, so that a scan reads nothing else."""
    made = [F.array(*[F.col(n).cast("double") for n in names]).cast("array<double>").alias("features"), F.col(label).cast("double").alias("label")]
    if tables:
        made.append(F.array(*[t.code.cast("int") for t in tables]).alias("codes"))
    return rows.select(*made)


def pack(width: int, n_codes: int):
    """Arrow map from vectors to blocks: a row-major matrix, the labels, and the codes table by table."""

    def bytes_of(x: np.ndarray) -> bytes:
        return np.ascontiguousarray(x).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            codes = np.zeros((n, 0), np.int32)
            if n_codes:
                codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(n, n_codes)
            cuts = range(0, n, BLOCK)
            columns = [[bytes_of(v[i : i + BLOCK]) for i in cuts] for v in (x, y)]
            columns.append([bytes_of(codes[i : i + BLOCK].T.astype(np.int16)) for i in cuts])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["x", "y", "codes"])

    return run


def gradient(weights, layout):
    """Sums of a partition.  ``layout``: positions of the dense features, and (positions, values) of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, (dense, tables) = weights.value, layout.value
        own = w[1:][dense]
        parts = [values @ w[1:][at] for at, values in tables]  # what each code adds to a score
        by_code = [np.zeros(len(values)) for _, values in tables]
        total, slope, loss, count = np.zeros(len(w)), np.zeros(len(dense)), 0.0, 0
        for batch in batches:
            for block, labels, codes in zip(*(batch.column(c) for c in ("x", "y", "codes"))):
                y = np.frombuffer(labels.as_buffer(), np.float64)
                x = np.frombuffer(block.as_buffer(), np.float64).reshape(len(y), len(dense))
                c = np.frombuffer(codes.as_buffer(), np.int16).reshape(len(tables), len(y))
                z = x @ own + w[0]
                for k, part in enumerate(parts):
                    z += part[c[k]]
                small = np.exp(-np.abs(z))
                p = np.where(z >= 0, 1 / (1 + small), small / (1 + small))
                error = p - y
                total[0] += error.sum()
                slope += error @ x
                for k, sums in enumerate(by_code):
                    sums += np.bincount(c[k], weights=error, minlength=len(sums))
                q = np.clip(p, 1e-15, 1 - 1e-15)
                loss -= float((y * np.log(q) + (1 - y) * np.log(1 - q)).sum())
                count += len(y)
        if count:
            total[1:][dense] = slope
            for (at, values), sums in zip(tables, by_code):
                total[1:][at] = sums @ values
            yield sums_row(total, loss, count)

    return run


def sums_row(total: np.ndarray, loss: float, count: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([loss]), pa.array([count])], names=["gradient", "loss", "count"])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sums from many."""
    total, loss, count = 0.0, 0.0, 0
    for batch in batches:
        if batch.num_rows:
            total = total + batch.column("gradient").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=0)
            loss, count = loss + sum(batch.column("loss").to_pylist()), count + sum(batch.column("count").to_pylist())
    if count:
        yield sums_row(total, loss, count)


def train(
    rows: DataFrame, names: list[str], epochs: int = 50, rate: float = 0.05, ridge: float = 0.0, label: str = "label", tables: list[CodeTable] | None = None
) -> Fit:
    """Weights (intercept first, not regularised) after a fixed number of epochs from zero.

    ``tables`` say which of ``names`` need not be read, as they follow from a code.  The history
    has the data loss before an epoch's update, at epoch 1, every fifth and the last.
    """
    epochs = epochs if epochs > 0 else 50
    rate = rate if rate > 0 else 0.05
    ridge = max(ridge, 0.0)
    tables = [t for t in tables or () if t.names]
    spark = rows.sparkSession
    place = {n: i for i, n in enumerate(names)}
    coded = [(np.array([place[n] for n in t.names]), np.asarray(t.values, float)) for t in tables]
    taken = {n for t in tables for n in t.names}
    dense = [n for n in names if n not in taken]
    layout = spark.sparkContext.broadcast((np.array([place[n] for n in dense], int), coded))
    data = vectors(rows, dense, label, tables).mapInArrow(pack(len(dense), len(tables)), "x binary, y binary, codes binary").persist(StorageLevel.MEMORY_AND_DISK)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    partitions = data.mapInArrow(_count_partition, "n long").count()
    spark.conf.set(limit, str(BATCH))
    weights = np.zeros(len(names) + 1)
    fit = Fit(weights.tolist())
    started = time.time()
    try:
        for epoch in range(1, epochs + 1):
            shared = spark.sparkContext.broadcast(weights)
            sums = data.mapInArrow(gradient(shared, layout), SUMS)
            if partitions > ROWS_TO_DRIVER:
                sums = sums.repartition(min(ROWS_TO_DRIVER, math.isqrt(partitions))).mapInArrow(add_up, SUMS)
            parts = sums.collect()
            shared.unpersist()
            count = sum(p["count"] for p in parts)
            if not count:
                break
            slope = np.sum([p["gradient"] for p in parts], axis=0) / count
            slope[1:] += ridge * weights[1:]
            weights = weights - rate * slope
            if epoch == 1 or epoch == epochs or epoch % 5 == 0:
                fit.history.append({"epoch": epoch, "log_loss": sum(p["loss"] for p in parts) / count, "elapsed_seconds": time.time() - started})
    finally:
        spark.conf.set(limit, before)
        data.unpersist()
        layout.unpersist()
    fit.weights = weights.tolist()
    return fit


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    yield pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])
