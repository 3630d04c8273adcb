"""Scoring of observations and of single prediction requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions import scalar
from cellcast.functions.parsing import parse_week
from cellcast.operators import features as feature_ops
from cellcast.operators.ranking import top, top_by_node
from cellcast.schemas import CELL_KEYS


@dataclass(frozen=True)
class Model:
    """A trained model: intercept first in ``weights``, one mean and deviation a feature."""

    feature_names: list[str]
    weights: list[float]
    means: list[float]
    stds: list[float]


def score_observations(rows: DataFrame, weights: list[float], names: list[str]) -> DataFrame:
    """Adds ``score`` to rows of standardised features."""
    return rows.withColumn("score", scalar.probability(weights, [F.col(n) for n in names]))


def online_vector(model: Model, serving: bool = True) -> Column:
    """Standardised features of a request: calendar and one-hots; all history counts as zero.

    ``serving`` keeps the narrower night flags that requests have always been scored with; False
    uses those of training.  A missing or unreadable week counts as January.
    """
    month = F.coalesce(F.month(parse_week(F.col("week_start"))), F.lit(1))
    known = feature_ops.place_features(F.col("district"), F.col("community_area"))
    known |= feature_ops.calendar_features(F.col("day_of_week"), F.col("hour"), month, serving)
    for prefix, column in (("district_onehot_", "district"), ("community_area_onehot_", "community_area")):
        for name in model.feature_names:
            number = name.removeprefix(prefix)
            if name.startswith(prefix) and number.isdigit():
                known[name] = F.coalesce(F.col(column) == int(number), F.lit(False)).cast("double")
    pad = lambda values, fill: [*values, *[fill] * (len(model.feature_names) - len(values))]
    return F.array(*[scalar.standardize(known.get(n, F.lit(0.0)), m, s) for n, m, s in zip(model.feature_names, pad(model.means, 0.0), pad(model.stds, 1.0))])


def predict(requests: DataFrame, model: Model, node_id: Column | str = "spark", serving: bool = True) -> DataFrame:
    """Requests with ``risk_score`` (four places), ``risk_level`` (of the unrounded score) and ``error_msg``.

    A request's own ``features`` are taken as standardised already.
    """
    f = F.col("features") if "features" in requests.columns else F.lit(None).cast("array<double>")
    error = scalar.input_error(F.col("district"), F.col("community_area"), F.col("day_of_week"), F.col("hour"), f, len(model.feature_names))
    vector = F.when(F.size(F.coalesce(f, F.array().cast("array<double>"))) > 0, f).otherwise(online_vector(model, serving))
    scored = requests.withColumns({"error_msg": error, "_score": scalar.probability_of_vector(model.weights, vector)})
    node = node_id if isinstance(node_id, Column) else F.lit(node_id)
    return scored.withColumns({
        "risk_score": F.when(F.col("error_msg").isNull(), scalar.round4(F.col("_score"))),
        "risk_level": F.when(F.col("error_msg").isNull(), scalar.risk_label(F.col("_score"))), "node_id": node,
    }).drop("_score")


class InvalidRequest(ValueError):
    """A batch holds a request that cannot be scored."""


def predict_batch(requests: DataFrame, model: Model, top_n: int = 0, **options) -> DataFrame:
    """Scores of a batch, best first; one bad request fails the whole batch."""
    scored = predict(requests, model, **options)
    bad = scored.where("error_msg is not null").select("error_msg").first()
    if bad:
        raise InvalidRequest(bad[0])
    return top(scored.drop("error_msg"), top_n, CELL_KEYS)


def active_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.coalesce("status", F.lit("")).isin("", "active"))


def assign_nodes(requests: DataFrame, node_ids: list[str], number: str = "candidate_no") -> DataFrame:
    """Deal numbered candidates round robin to nodes."""
    ids = F.array(*[F.lit(n) for n in node_ids])
    return requests.withColumn("node_id", F.get(ids, F.pmod(F.col(number), F.lit(len(node_ids))).cast("int")))


class RoundRobin:
    """Next active node; the cursor also moves over nodes that are skipped."""

    def __init__(self, nodes: list[tuple[str, str]]):
        self.nodes, self.cursor = nodes, 0

    def next(self) -> str:
        for _ in self.nodes:
            node, status = self.nodes[self.cursor % len(self.nodes)]
            self.cursor += 1
            if status in ("", "active"):
                return node
        raise LookupError("no active node")


def recommend(requests: DataFrame, model: Model, nodes: list[str], top_n: int = 0) -> DataFrame:
    """Global best of candidates scored by node: partial best of each, then one merge."""
    if not nodes:
        raise LookupError("no active node")
    scored = predict_batch(assign_nodes(requests, nodes), model, node_id=F.col("node_id"))
    partial = top_by_node(scored, top_n).drop("node_rank") if top_n > 0 else scored
    return top(partial, top_n, CELL_KEYS)
