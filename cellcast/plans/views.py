"""Incident views over the driver's tables: a short dense one and one with a long history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View I1: five weeks of events, many zones."""
    kind = (
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 10 == 0, "HOMICIDE").otherwise("ROBBERY"))
        .when(F.col("event_type") == "purchase", "BURGLARY").when(F.col("event_type") == "signup", "WEAPONS VIOLATION").when(F.col("event_type") == "view", "CRIMINAL DAMAGE").otherwise("THEFT")
    )
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp_ntz").alias("occurred_at"), (F.col("user_id") % 25 + 1).cast("int").alias("district"), (F.col("user_id") % 77 + 1).cast("int").alias("community_area"),
        kind.alias("primary_type"), (F.col("event_id") % 4 == 0).alias("arrest"), (F.col("event_id") % 5 == 0).alias("domestic"),
    )


I1_SQL = """i AS (
  SELECT ts AS occurred_at, CAST(user_id % 25 + 1 AS INTEGER) AS district, CAST(user_id % 77 + 1 AS INTEGER) AS community_area,
    CASE event_type WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'HOMICIDE' ELSE 'ROBBERY' END WHEN 'purchase' THEN 'BURGLARY'
      WHEN 'signup' THEN 'WEAPONS VIOLATION' WHEN 'view' THEN 'CRIMINAL DAMAGE' ELSE 'THEFT' END AS primary_type,
    event_id % 4 = 0 AS arrest, event_id % 5 = 0 AS domestic
  FROM events)"""


def order_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View I2: 84 weeks of orders, few zones."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "HOMICIDE").when(F.col("o_orderpriority") == "2-HIGH", "ROBBERY").when(F.col("o_orderpriority") == "3-MEDIUM", "WEAPONS VIOLATION").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "BURGLARY").otherwise("THEFT")
    return joined.select(
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("occurred_at"), (F.col("n_regionkey") + 1).cast("int").alias("district"),
        (F.col("o_custkey") % 2 + 1).cast("int").alias("community_area"), kind.alias("primary_type"), F.lit(False).alias("arrest"), F.lit(False).alias("domestic"),
    )


I2_SQL = """i AS (
  SELECT o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS occurred_at, CAST(n_regionkey + 1 AS INTEGER) AS district,
    CAST(o_custkey % 2 + 1 AS INTEGER) AS community_area,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'HOMICIDE' WHEN '2-HIGH' THEN 'ROBBERY' WHEN '3-MEDIUM' THEN 'WEAPONS VIOLATION'
      WHEN '4-NOT SPECIFIED' THEN 'BURGLARY' ELSE 'THEFT' END AS primary_type, FALSE AS arrest, FALSE AS domestic
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

GROUPED_SQL = """g AS (
  SELECT *, CASE WHEN primary_type IN ('HOMICIDE','CRIMINAL SEXUAL ASSAULT','SEX OFFENSE','KIDNAPPING','HUMAN TRAFFICKING') THEN 'severe'
      WHEN primary_type IN ('ROBBERY','ASSAULT','BATTERY','INTIMIDATION','STALKING') THEN 'violent'
      WHEN primary_type IN ('WEAPONS VIOLATION','CONCEALED CARRY LICENSE VIOLATION') THEN 'weapons'
      WHEN primary_type IN ('BURGLARY','MOTOR VEHICLE THEFT','ARSON') THEN 'property' ELSE 'other' END AS crime_group
  FROM i)"""

CELLS_SQL = """cells AS (
  SELECT CAST(date_trunc('week', occurred_at) AS DATE) AS week_start, district, community_area,
    CAST(dayofweek(occurred_at) AS INTEGER) AS day_of_week, CAST(hour(occurred_at) AS INTEGER) AS hour,
    count(*) AS total_count, count(*) FILTER (crime_group <> 'other') AS relevant_count, count(*) FILTER (crime_group = 'violent') AS violent_count,
    count(*) FILTER (crime_group = 'property') AS property_count, count(*) FILTER (crime_group = 'weapons') AS weapons_count,
    count(*) FILTER (crime_group = 'severe') AS severe_count, count(*) FILTER (crime_group = 'other') AS other_count,
    count(*) FILTER (arrest) AS arrest_count, count(*) FILTER (domestic) AS domestic_count
  FROM g GROUP BY ALL)"""


def cells_sql(view: str) -> str:
    return f"WITH {view}, {GROUPED_SQL}, {CELLS_SQL}"


GRID_SQL = """slots AS (
  SELECT w.week_start, z.district, z.community_area, CAST(s.slot // 24 AS INTEGER) AS day_of_week, CAST(s.slot % 24 AS INTEGER) AS hour
  FROM (SELECT DISTINCT district, community_area FROM cells) z, (SELECT DISTINCT week_start FROM cells) w, range(168) AS s(slot)
), dense AS (
  SELECT s.*, datediff('day', DATE '1970-01-05', s.week_start) // 7 AS week_no, coalesce(total_count, 0) AS total_count,
    coalesce(relevant_count, 0) AS relevant_count, coalesce(violent_count, 0) AS violent_count, coalesce(property_count, 0) AS property_count,
    coalesce(weapons_count, 0) AS weapons_count, coalesce(severe_count, 0) AS severe_count, coalesce(other_count, 0) AS other_count
  FROM slots s LEFT JOIN cells c USING (week_start, district, community_area, day_of_week, hour)
), labelled AS (
  SELECT *, CAST(week_start + 7 AS DATE) AS target_week_start,
    CAST(coalesce(sum(relevant_count) OVER (PARTITION BY district, community_area, day_of_week, hour ORDER BY week_no RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0) AS BIGINT) AS next_week_relevant_count
  FROM dense
), grid AS (
  SELECT *, CASE WHEN next_week_relevant_count > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM labelled WHERE week_start < (SELECT max(week_start) FROM cells))"""


def grid_sql(view: str) -> str:
    return f"{cells_sql(view)}, {GRID_SQL}"
