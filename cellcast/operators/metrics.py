"""Confusion counts, ratios, rank-based AUC, Gini and log-loss of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions.scalar import log_loss, round4, safe_ratio

#: Scores are probabilities; ranks are summed bucket by bucket so that no task sorts all scores.
BUCKETS = 10_000


def confusion(scored: DataFrame, bounded: bool = True) -> DataFrame:
    """One row: counts at threshold 0.5, ratios and mean log-loss, rounded to four places.

    ``bounded`` keeps scores off 0 and 1 in the loss; without, one such score makes it infinite or NaN.
    """
    yes, hit = F.col("label") >= 0.5, F.col("score") >= 0.5
    counts = scored.agg(
        F.count("*").alias("samples"), F.count_if(yes).alias("positives"), F.count_if(yes & hit).alias("tp"), F.count_if(~yes & ~hit).alias("tn"),
        F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.avg(log_loss(F.col("label"), F.col("score"), bounded)).alias("loss"),
    )
    d = lambda c: F.col(c).cast("double")
    ratios = counts.withColumns({"p": safe_ratio(d("tp"), d("tp") + d("fp")), "r": safe_ratio(d("tp"), d("tp") + d("fn"))})
    return ratios.select(
        round4(safe_ratio(d("tp") + d("tn"), d("samples"))).alias("accuracy"), round4(F.col("p")).alias("precision"), round4(F.col("r")).alias("recall"),
        round4(safe_ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))).alias("f1"), round4(F.coalesce("loss", F.lit(0.0))).alias("log_loss"), "samples", "positives",
        (F.col("samples") - F.col("positives")).alias("negatives"), "tp", "tn", "fp", "fn",
    )


def auc(scored: DataFrame) -> DataFrame:
    """One row: unrounded ``auc`` (ties share their mean rank; 0 without both classes) and ``gini``."""
    yes = F.col("label") >= 0.5
    bucket = F.least(F.floor(F.col("score") * BUCKETS), F.lit(BUCKETS - 1).cast("long"))
    groups = scored.groupBy(bucket.alias("bucket"), "score").agg(F.count("*").alias("n"), F.count_if(yes).alias("pos"))
    order = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inside = groups.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    sums = inside.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"))
    # at most BUCKETS rows from here on
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = sums.withColumn("ranks", F.col("ranks") + F.col("pos") * F.coalesce(F.sum("n").over(earlier), F.lit(0))).agg(F.sum("ranks").alias("ranks"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    both = F.when((pos > 0) & (neg > 0), (F.col("ranks") - pos * (pos + 1) / 2) / F.when(pos * neg > 0, pos * neg).otherwise(1.0)).otherwise(0.0)
    return total.select(F.coalesce(both, F.lit(0.0)).alias("auc")).select("auc", (2 * F.col("auc") - 1).alias("gini"))


def evaluate(scored: DataFrame, bounded: bool = True) -> DataFrame:
    """All fourteen metrics in one row; ``bounded`` as in ``confusion``."""
    ranked = auc(scored).select(round4(F.col("auc")).alias("auc"), round4(F.col("gini")).alias("gini"))
    both = confusion(scored, bounded).join(ranked)
    return both.select("accuracy", "precision", "recall", "f1", "auc", "gini", "log_loss", "samples", "positives", "negatives", "tp", "tn", "fp", "fn")
