"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture, hence a mean repetition rate for its documents.
A document's number of copies is the Poisson law of that rate inverted at a uniform number made
from a hash of its id and the seed, so it is the same in every run and on every machine.  Copies
are exploded and dealt to partitions, and ordered within them, by a hash of id and copy: a global
shuffle without sampling, a skew or a sort of all rows.

Only DataFrame functions are used.  The rates of the sources (a distribution function of at most
``MEAN_PART`` mean each) are broadcast while there are at most ``BROADCAST_SOURCES``; beyond that
they are joined by a shuffle, whose skewed partitions adaptive execution splits.

Defined results: a null source is a source of its own; a null text is copied like any other; rows
that repeat an id get equal numbers of copies; a null id hashes like an empty one; an empty table
gives an empty table; a source without a target weight gets none of the mixture.  Texts of any
length are carried as they are, and so are columns of any name but the three that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.schemas import free_name

MEAN_PART = 16.0
TERMS = 96  # beyond these the tail of a law of mean 16 is under 1e-40
BROADCAST_SOURCES = 10_000
SEED = "mix-1"


def uniform(seed: str, *parts: Column) -> Column:
    """Uniform in [0, 1) with 52 bits, from MD5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of a Poisson law, as an array of running sums."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def more(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, more, lambda acc: acc["sums"])


def source_rates(docs: DataFrame, weights: DataFrame | None, smoothing: float, total: int | None, source: str) -> DataFrame:
    """``source``, ``rate`` (mean copies), ``parts`` and ``law``: one row for each source."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(smoothing)))
    else:
        own = weights.select(F.col("source").alias("named"), F.col("weight").cast("double").alias("weight")).groupBy("named").agg(F.sum("weight").alias("weight"))
        weighted = sizes.join(own, sizes["source"].eqNullSafe(own["named"]), "left").select("source", "rows", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    sums = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("rows").alias("all_rows"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_rows").cast("double")
    rated = weighted.join(F.broadcast(sums)).withColumn("rate", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * wanted / F.col("rows")).otherwise(F.lit(0.0)))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_PART).cast("int")))
    return rated.select("source", "rate", "parts", distribution(F.col("rate") / F.col("parts")).alias("law"))


def replicate(docs: DataFrame, weights: DataFrame | None = None, smoothing: float = 0.5, total: int | None = None, seed: str = SEED, source: str = "source") -> DataFrame:
    """``docs`` with each row as often as its count says, shuffled globally.

    The mixture has about ``total`` rows (default: as many as come in).  Without ``weights``
    (``source``, ``weight``) a source weighs its number of rows to the power ``smoothing``.
    Adds ``mix_rate``, ``mix_copy`` (from 1) and ``mix_key``, in place of columns so named.
    """
    docs = docs.drop("mix_rate", "mix_copy", "mix_key")
    of, parts, law, times = (free_name(x, docs.columns) for x in ("of", "parts", "law", "times"))
    rates = source_rates(docs, weights, smoothing, total, source)
    rates = rates.select(F.col("source").alias(of), F.col("rate").alias("mix_rate"), F.col("parts").alias(parts), F.col("law").alias(law))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = docs.join(rates, docs[source].eqNullSafe(F.col(of)))
    drawn = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: uniform(seed, docs["doc_id"], j))
    count = F.aggregate(drawn, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(law), lambda c: c <= u)))
    copies = joined.withColumn(times, count).where(F.col(times) > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col(times))))
    keyed = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mix_copy")))
    return keyed.select(*docs.columns, "mix_rate", "mix_copy", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")
