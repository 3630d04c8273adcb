"""Incidents to weekly cells, row outcomes, histograms and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions import calendar, parsing, scalar
from cellcast.schemas import CELL_KEYS, COUNTERS


def parse_incidents(raw: DataFrame) -> DataFrame:
    """Typed columns of raw text rows (``date district community_area primary_type arrest domestic``)."""
    return raw.select(
        parsing.parse_timestamp(F.col("date")).alias("occurred_at"), parsing.parse_positive_int(F.col("district")).alias("district"),
        parsing.parse_positive_int(F.col("community_area")).alias("community_area"), parsing.parse_type(F.col("primary_type")).alias("primary_type"),
        parsing.parse_flag(F.col("arrest")).alias("arrest"), parsing.parse_flag(F.col("domestic")).alias("domestic"),
    )


def with_outcome(parsed: DataFrame, min_year: int) -> DataFrame:
    """``outcome`` of every row: invalid (a field does not parse), filtered (too early) or valid."""
    sound = F.col("occurred_at").isNotNull() & F.col("district").isNotNull() & F.col("community_area").isNotNull()
    return parsed.withColumn("outcome", F.when(~sound, "invalid").when(F.year("occurred_at") < min_year, "filtered").otherwise("valid"))


def valid_incidents(parsed: DataFrame, min_year: int) -> DataFrame:
    return with_outcome(parsed, min_year).where("outcome = 'valid'").drop("outcome")


def outcome_counts(parsed: DataFrame, min_year: int) -> DataFrame:
    """One row: how many rows were read, and what became of them."""
    row = with_outcome(parsed, min_year)
    count = lambda c: F.count_if(F.col("outcome") == c)
    relevant = F.count_if((F.col("outcome") == "valid") & scalar.is_relevant(F.col("primary_type")))
    return row.agg(F.count("*").alias("total_rows"), count("valid").alias("valid_rows"), count("invalid").alias("invalid_rows"), count("filtered").alias("filtered_rows"), relevant.alias("relevant_rows"))


def year_histogram(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy(F.year("occurred_at").alias("year")).agg(F.count("*").alias("rows"))


def type_histogram(incidents: DataFrame) -> DataFrame:
    return incidents.where("primary_type <> ''").groupBy("primary_type").agg(F.count("*").alias("rows"))


def weekly_cells(incidents: DataFrame) -> DataFrame:
    """Counters of every (week, zone, weekday, hour) that has an incident.

    One shuffle, after partial aggregation; year and month follow from the week.
    """
    group = scalar.crime_group(F.col("primary_type"))
    placed = incidents.select(
        calendar.week_start(F.col("occurred_at")).alias("week_start"), "district", "community_area", calendar.day_of_week(F.col("occurred_at")).alias("day_of_week"),
        F.hour("occurred_at").alias("hour"), group.alias("crime_group"), "arrest", "domestic",
    )
    of = lambda g: F.count_if(F.col("crime_group") == g)
    cells = placed.groupBy("week_start", *CELL_KEYS).agg(
        F.count("*").alias("total_count"), F.count_if(F.col("crime_group") != "other").alias("relevant_count"), of("violent").alias("violent_count"),
        of("property").alias("property_count"), of("weapons").alias("weapons_count"), of("severe").alias("severe_count"), of("other").alias("other_count"),
        F.count_if("arrest").alias("arrest_count"), F.count_if("domestic").alias("domestic_count"),
    )
    return cells.select("week_start", F.year("week_start").alias("year"), F.month("week_start").alias("month"), *CELL_KEYS, *COUNTERS)


def rollup(cells: DataFrame, *keys: str) -> DataFrame:
    """Sums of all counters by week and ``keys``."""
    return cells.groupBy("week_start", *keys).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def zone_week_totals(cells: DataFrame) -> DataFrame:
    return rollup(cells, "district", "community_area")


def district_week_totals(cells: DataFrame) -> DataFrame:
    """From the zone totals, which are far fewer than cells."""
    return rollup(zone_week_totals(cells), "district")


def city_dow_hour_totals(cells: DataFrame) -> DataFrame:
    return rollup(cells, "day_of_week", "hour")


def zones(cells: DataFrame) -> DataFrame:
    """All zones, by district and area."""
    return cells.select("district", "community_area").distinct().orderBy("district", "community_area")


def weeks(cells: DataFrame) -> DataFrame:
    """All weeks, in order."""
    return cells.select("week_start").distinct().orderBy("week_start")


def loader_stats(parsed: DataFrame, min_year: int) -> DataFrame:
    """One row with the outcome counts, the number of cells and both histograms as maps."""
    sound = valid_incidents(parsed, min_year)
    as_map = lambda rows, key: rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "rows")))).alias(f"{key}s"))
    cells = weekly_cells(sound).agg(F.count("*").alias("aggregated_cells"))
    return outcome_counts(parsed, min_year).join(cells).join(as_map(year_histogram(sound), "year")).join(as_map(type_histogram(sound), "primary_type"))
