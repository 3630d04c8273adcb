"""Prediction history, result cache and usage counters, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.scalar import cache_key
from cellcast.schemas import CACHE_ENTRY, PREDICTION_RECORD

DEFAULT_LIMIT, MAX_LIMIT = 20, 100
TTL_SECONDS = 300


def history_limit(limit: int) -> int:
    """Limits outside 1 to 100 fall back to 20."""
    return limit if 1 <= limit <= MAX_LIMIT else DEFAULT_LIMIT


def append_history(records: DataFrame, path: str) -> None:
    """Append records; ``created_at`` defaults to now, feature vectors are not kept."""
    own = records.withColumn("created_at", F.coalesce(F.col("created_at"), F.current_timestamp()))
    own.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTION_RECORD]).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_RECORD).parquet(path)


def latest(history: DataFrame, limit: int = DEFAULT_LIMIT, key: str = "request_id") -> DataFrame:
    """Newest records first: partial heaps and one merge."""
    return history.orderBy(F.desc("created_at"), key).limit(history_limit(limit))


def request_key(rows: DataFrame) -> Column:
    features = F.col("features") if "features" in rows.columns else None
    return cache_key(F.col("district"), F.col("community_area"), F.col("day_of_week"), F.col("hour"), F.col("week_start"), features)


def cache_entries(results: DataFrame, now: Column | None = None, ttl: int = TTL_SECONDS) -> DataFrame:
    """Entries to append for scored requests."""
    seconds = ttl if ttl > 0 else TTL_SECONDS
    result = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CACHE_ENTRY["result"].dataType])
    return results.select(request_key(results).alias("cache_key"), result.alias("result"), ((now if now is not None else F.current_timestamp()) + F.expr(f"INTERVAL {seconds} SECONDS")).alias("expires_at"))


def probe_cache(requests: DataFrame, cache: DataFrame, now: Column | None = None) -> DataFrame:
    """Requests with ``cached`` and ``cached_result``; of live entries of a key the latest counts.

    The entries are reduced to one a key before the join, so a key never multiplies requests.
    """
    live = cache.where(F.col("expires_at") > (now if now is not None else F.current_timestamp()))
    newest = live.groupBy("cache_key").agg(F.max_by("result", "expires_at").alias("cached_result"))
    keyed = requests.withColumn("cache_key", request_key(requests))
    return keyed.join(newest, "cache_key", "left").withColumn("cached", F.col("cached_result").isNotNull())


def usage_metrics(history: DataFrame) -> DataFrame:
    """One row: requests by kind and cache hits."""
    kind = lambda k: F.count_if(F.col("query_type") == k)
    return history.agg(kind("predict").alias("requests_predict"), kind("recommendations_top").alias("requests_recommendations_top"), F.count_if("cached").alias("cache_hits"))


def store_status(history_path: str | None, cache_path: str | None) -> dict:
    """Which of the optional stores are set up."""
    return {"enabled": bool(history_path or cache_path), "history": bool(history_path), "cache": bool(cache_path)}
