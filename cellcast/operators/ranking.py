"""Global and partial rankings, always with keys that break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.schemas import CELL_KEYS, free_name
from cellcast.sources.scratch import shared_folder

def level_of(position: Column) -> Column:
    return F.when(position <= 0.10, "Alto").when(position <= 0.30, "Medio").otherwise("Bajo")


def ranked(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """``rank`` from 1 by falling score then keys, and ``risk_level`` by share of all rows.

    Rows are dealt by ranges of score and keys, so that equal scores spread over tasks as well, and
    sorted in their range.  They are written once to the shared folder with their place in it; a
    rank is that place shifted by the rows of the ranges before, of which there are as many as
    partitions.
    """
    spark = scored.sparkSession
    place = free_name("place", scored.columns)
    order = [F.desc(score), *keys]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    path = shared_folder(spark, "ranked")
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    part = F.shiftright(place, 33)  # the upper bits are the range, the lower ones the place in it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"), F.sum("n").over(Window.partitionBy()).alias("total"))
    found = rows.join(F.broadcast(shifts), part == shifts["part"])
    rank = (F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + shifts["shift"] + 1).cast("long")
    own = [rows[c] for c in scored.columns if c not in ("rank", "risk_level")]
    return found.select(*own, rank.alias("rank"), level_of(rank / shifts["total"]).alias("risk_level"))


def top(scored: DataFrame, n: int, keys: list[str], score: str = "risk_score") -> DataFrame:
    """The n best rows (all, if n is not positive), as partial heaps and one merge."""
    order = scored.orderBy(F.desc(score), *keys)
    return order.limit(n) if n > 0 else order


def top_by_node(scored: DataFrame, n: int, keys: list[str] = CELL_KEYS, score: str = "risk_score", node: str = "node_id") -> DataFrame:
    """The n best rows of each node."""
    order = F.row_number().over(Window.partitionBy(node).orderBy(F.desc(score), *keys))
    rows = scored.withColumn("node_rank", order)
    return rows.where(F.col("node_rank") <= n) if n > 0 else rows


def sorted_cells(cells: DataFrame) -> DataFrame:
    return cells.orderBy("week_start", *CELL_KEYS)
