"""Fixed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column is called so (in any case of letters)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


#: Key of a cell beside its week.
CELL_KEYS = ["district", "community_area", "day_of_week", "hour"]
#: Counters of a cell, in the order of the aggregates file.
COUNTERS = ["total_count", "relevant_count", "violent_count", "property_count", "weapons_count", "severe_count", "other_count", "arrest_count", "domestic_count"]

INCIDENT = _struct(occurred_at=TimestampNTZType(), district=IntegerType(), community_area=IntegerType(), primary_type=StringType(), arrest=BooleanType(), domestic=BooleanType())
CELL = StructType(
    [StructField("week_start", DateType()), StructField("year", IntegerType()), StructField("month", IntegerType())]
    + [StructField(k, IntegerType()) for k in CELL_KEYS]
    + [StructField(c, LongType()) for c in COUNTERS]
)
#: Columns of a prepared observation before its features.
OBSERVATION_META = StructType(
    [StructField("week_start", DateType()), StructField("target_week_start", DateType()), StructField("year", IntegerType())]
    + [StructField(k, IntegerType()) for k in CELL_KEYS]
    + [StructField(c, LongType()) for c in ("current_relevant_count", "current_minor_count", "current_total_incidents", "next_week_relevant_count")]
    + [StructField("label", DoubleType())]
)
PREDICTION_INPUT = _struct(district=IntegerType(), community_area=IntegerType(), day_of_week=IntegerType(), hour=IntegerType(), week_start=StringType(), features=ArrayType(DoubleType()))
PREDICTION_RESULT = _struct(district=IntegerType(), community_area=IntegerType(), day_of_week=IntegerType(), hour=IntegerType(), risk_score=DoubleType(), risk_level=StringType(), node_id=StringType())
NODE = _struct(node_id=StringType(), address=StringType(), status=StringType())
#: The history keeps no feature vectors.
PREDICTION_RECORD = _struct(
    request_id=StringType(), query_type=StringType(),
    input=_struct(district=IntegerType(), community_area=IntegerType(), day_of_week=IntegerType(), hour=IntegerType(), week_start=StringType()),
    result=PREDICTION_RESULT, node=NODE, cached=BooleanType(), latency_ms=LongType(), created_at=TimestampType(),
)
CACHE_ENTRY = _struct(cache_key=StringType(), result=PREDICTION_RESULT, expires_at=TimestampType())
METRIC_FIELDS = ["accuracy", "precision", "recall", "f1", "auc", "gini", "log_loss", "samples", "positives", "negatives", "tp", "tn", "fp", "fn"]
