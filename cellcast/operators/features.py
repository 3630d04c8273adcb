"""The 161 features of an observation, from one ordered list of specifications.

All cell-level frames share one partitioning and order, so averages over 1 to 12 weeks cost one
exchange and one sort.  Context averages are made on rollups of the cells themselves, which are far
fewer than the rows of the dense grid; each key of a rollup is then filled to all weeks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions import calendar
from cellcast.functions.scalar import safe_ratio
from cellcast.functions.calendar import week_index
from cellcast.operators.grid import candidates, cell_window, dense_cells, every_week, labelled, slot_day, slot_hour
from cellcast.operators.logreg import CodeTable
from cellcast.schemas import CELL_KEYS

DISTRICTS, AREAS = 25, 77
#: Counters behind the short names of features, and the frames (in weeks) each is averaged over.
FRAMES = {"relevant": (1, 2, 4, 8, 12), "violent": (1, 4), "property": (1, 4), "weapons": (1, 12), "severe": (1, 12), "minor": (1, 2, 4, 12), "total": (1, 4, 12)}
COUNTER = {"minor": "other_count"} | {g: f"{g}_count" for g in ("relevant", "violent", "property", "weapons", "severe", "total")}
#: Contexts: keys of the rollup and what is averaged over which frames.
CONTEXTS = {
    "zone": (["district", "community_area"], {"relevant": (1, 4), "minor": (1, 4), "total": (1, 4)}),
    "district": (["district"], {"relevant": (1, 4), "total": (4,)}),
    "city_dow_hour": (["day_of_week", "hour"], {"relevant": (1, 4), "total": (4,)}),
}


def _avg(group: str, weeks: int, level: str = "cell") -> str:
    return f"_{level}_{group}_{weeks}"


def with_averages(dense: DataFrame) -> DataFrame:
    """Averages over the last n weeks, the base week included; missing weeks count as zero."""
    columns = {_avg(g, n): F.sum(COUNTER[g]).over(cell_window(1 - n, 0)) / n for g, frames in FRAMES.items() for n in frames}
    return dense.withColumns(columns)


def context_averages(cells: DataFrame, level: str) -> DataFrame:
    """The averages of a rollup: one row for each observed week and key of the level."""
    keys, groups = CONTEXTS[level]
    sums = cells.groupBy("week_start", *keys).agg(*[F.sum(COUNTER[g]).alias(COUNTER[g]) for g in groups])
    if "hour" in keys:  # every hour of the week, whether or not anything ever happened in it
        slots = cells.sparkSession.range(168).select(slot_day(F.col("id")).alias("day_of_week"), slot_hour(F.col("id")).alias("hour"))
    else:
        slots = cells.select(*keys).distinct()
    filled = every_week(cells, slots).drop("last_week").join(sums, ["week_start", *keys], "left")
    filled = filled.select(week_index(F.col("week_start")).alias("week_no"), *keys, *[F.coalesce(COUNTER[g], F.lit(0).cast("long")).alias(COUNTER[g]) for g in groups])
    over = lambda n: Window.partitionBy(*keys).orderBy("week_no").rangeBetween(1 - n, 0)
    averages = [(F.sum(COUNTER[g]).over(over(n)) / n).alias(_avg(g, n, level)) for g, frames in groups.items() for n in frames]
    return filled.select("week_no", *keys, *averages)


def calendar_features(day: Column, hour: Column, month: Column, serving: bool = False) -> dict[str, Column]:
    out = {}
    for name, value, period in (("hour", hour, 24), ("day", day, 7), ("month", month, 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = calendar.cycle(value, period)
    return out | calendar.calendar_flags(day, hour, serving)


def place_features(district: Column, area: Column) -> dict[str, Column]:
    return {"district_norm": district / F.lit(float(DISTRICTS)), "community_area_norm": area / F.lit(float(AREAS))}


def one_hot_features(district: Column, area: Column) -> dict[str, Column]:
    return calendar.one_hot(district, "district_onehot", DISTRICTS) | calendar.one_hot(area, "community_area_onehot", AREAS)


def code_tables(names: list[str], means: list[float], stds: list[float]) -> list[CodeTable]:
    """The standardised features that follow from a code of an observation, for training.

    Codes are the month and hour of the week, the district and the area; a district or area
    outside its range has code 0, whose one-hots are all zero.
    """
    place = {n: i for i, n in enumerate(names)}
    month, hour_of_week = np.divmod(np.arange(12 * 168), 168)
    day, hour = np.divmod(hour_of_week, 24)
    night, late = (hour >= 20) | (hour <= 5), (hour >= 18) | (hour <= 3)
    calendar_values = {
        "is_weekend": np.isin(day, (0, 6)), "is_night": night, "is_morning": (hour >= 6) & (hour <= 11), "is_afternoon": (hour >= 12) & (hour <= 17),
        "is_evening": hour >= 18, "is_friday_saturday_night": np.isin(day, (5, 6)) & late,
    }
    for name, value, period in (("hour", hour, 24), ("day", day, 7), ("month", month + 1, 12)):
        angle = value * (2 * np.pi) / period
        calendar_values |= {f"{name}_sin": np.sin(angle), f"{name}_cos": np.cos(angle)}
    week_code = (F.month("week_start") - 1) * 168 + F.col("day_of_week") * 24 + F.col("hour")
    found = [(week_code, calendar_values)]
    for column, size in (("district", DISTRICTS), ("community_area", AREAS)):
        code = F.when(F.col(column).between(1, size), F.col(column)).otherwise(0)
        found.append((code, {f"{column}_onehot_{i:02d}": np.arange(size + 1) == i for i in range(1, size + 1)}))
    out = []
    for code, values in found:
        own = [n for n in values if n in place]
        scaled = [(np.asarray(values[n], float) - (means[place[n]] or 0.0)) / (stds[place[n]] or 1.0) for n in own]
        out.append(CodeTable(code, own, np.column_stack(scaled) if own else np.zeros((1, 0))))
    return out


def history_features() -> dict[str, Column]:
    """Features made of averages, in their fixed order."""
    a = lambda g, n, level="cell": F.col(_avg(g, n, level))
    out: dict[str, Column] = {}
    suffix = lambda n: "last_week" if n == 1 else f"avg_{n}w"

    def logs(group: str, name: str | None = None, level: str = "cell", frames=None) -> None:
        for n in frames or FRAMES[group]:
            out[f"log_{name or group}_{suffix(n)}"] = F.log1p(a(group, n, level))

    logs("relevant")
    out["trend_relevant_2w_12w"] = a("relevant", 2) - a("relevant", 12)
    out["trend_relevant_4w_12w"] = a("relevant", 4) - a("relevant", 12)
    out["burst_relevant_last_vs_avg4"] = safe_ratio(a("relevant", 1), a("relevant", 4) + 0.01)
    out["any_relevant_last_week"] = (a("relevant", 1) > 0).cast("double")
    for group in ("violent", "property", "weapons", "severe", "minor"):
        logs(group)
    out["trend_minor_4w_12w"] = a("minor", 4) - a("minor", 12)
    out["burst_minor_last_vs_avg4"] = safe_ratio(a("minor", 1), a("minor", 4) + 0.01)
    out["any_minor_last_week"] = (a("minor", 1) > 0).cast("double")
    logs("total", "total_incidents")
    out["trend_total_4w_12w"] = a("total", 4) - a("total", 12)
    out["relevant_ratio_4w"] = safe_ratio(a("relevant", 4), a("total", 4))
    out["minor_ratio_4w"] = safe_ratio(a("minor", 4), a("total", 4))
    for level, (_, groups) in CONTEXTS.items():
        for group, frames in groups.items():
            logs(group, f"{level}_{group}", level, frames)
        out[f"{level}_relevant_ratio_4w"] = safe_ratio(a("relevant", 4, level), a("total", 4, level))
    return out


def feature_columns(serving: bool = False) -> dict[str, Column]:
    """All features by name, in order, over a grid that has its averages."""
    day, hour = F.col("day_of_week"), F.col("hour")
    return place_features(F.col("district"), F.col("community_area")) | calendar_features(day, hour, F.month("week_start"), serving) | one_hot_features(F.col("district"), F.col("community_area")) | history_features()


def feature_names() -> list[str]:
    """The names and their order, without a Spark session."""
    names = ["district_norm", "community_area_norm"]
    names += [f"{n}_{f}" for n in ("hour", "day", "month") for f in ("sin", "cos")]
    names += ["is_weekend", "is_night", "is_morning", "is_afternoon", "is_evening", "is_friday_saturday_night"]
    names += [f"district_onehot_{i:02d}" for i in range(1, DISTRICTS + 1)] + [f"community_area_onehot_{i:02d}" for i in range(1, AREAS + 1)]
    log = lambda g, frames: [f"log_{g}_{'last_week' if n == 1 else f'avg_{n}w'}" for n in frames]
    names += log("relevant", FRAMES["relevant"]) + ["trend_relevant_2w_12w", "trend_relevant_4w_12w", "burst_relevant_last_vs_avg4", "any_relevant_last_week"]
    for group in ("violent", "property", "weapons", "severe", "minor"):
        names += log(group, FRAMES[group])
    names += ["trend_minor_4w_12w", "burst_minor_last_vs_avg4", "any_minor_last_week"] + log("total_incidents", FRAMES["total"]) + ["trend_total_4w_12w", "relevant_ratio_4w", "minor_ratio_4w"]
    for level, (_, groups) in CONTEXTS.items():
        for group, frames in groups.items():
            names += log(f"{level}_{group}", frames)
        names.append(f"{level}_relevant_ratio_4w")
    return names


def grid_with_context(cells: DataFrame, target_before: str | None = None) -> DataFrame:
    """Candidate rows with label, cell averages and context averages."""
    rows = candidates(labelled(with_averages(dense_cells(cells))), target_before)
    for level, (keys, _) in CONTEXTS.items():
        rows = rows.join(context_averages(cells, level), ["week_no", *keys])
    return rows


def observations(cells: DataFrame, target_before: str | None = None) -> DataFrame:
    """Meta columns, label and all raw features of every candidate cell, in one projection."""
    meta = [F.col("week_start"), F.col("target_week_start"), F.year("week_start").alias("year"), *[F.col(k) for k in CELL_KEYS], F.col("relevant_count").alias("current_relevant_count"), F.col("other_count").alias("current_minor_count"), F.col("total_count").alias("current_total_incidents"), F.col("next_week_relevant_count"), F.col("label")]
    return grid_with_context(cells, target_before).select(*meta, *[c.alias(n) for n, c in feature_columns().items()])
