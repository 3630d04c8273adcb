"""Weeks, days and hours of wall-clock timestamps, and the flags and cycles made from them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(stamp: Column) -> Column:
    """Monday of the timestamp's week."""
    return F.to_date(F.date_trunc("week", stamp))


def add_weeks(week: Column, n: int) -> Column:
    return F.date_add(week, 7 * n)


def week_index(week: Column) -> Column:
    """Weeks since Monday 1970-01-05, so that frames of weeks are ranges of integers."""
    return F.floor(F.datediff(week, F.lit("1970-01-05").cast("date")) / 7).cast("long")


def day_of_week(stamp: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(stamp) - 1


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value's place in its period."""
    angle = value.cast("double") * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def flag(condition: Column) -> Column:
    return condition.cast("double")


def calendar_flags(day: Column, hour: Column, serving: bool = False) -> dict[str, Column]:
    """Six 0/1 flags.  The serving variant keeps its narrower idea of night."""
    night = hour.between(0, 5) if serving else (hour >= 20) | (hour <= 5)
    late = hour >= 18 if serving else (hour >= 18) | (hour <= 3)
    return {
        "is_weekend": flag(day.isin(0, 6)),
        "is_night": flag(night),
        "is_morning": flag(hour.between(6, 11)),
        "is_afternoon": flag(hour.between(12, 17)),
        "is_evening": flag(hour.between(18, 23)),
        "is_friday_saturday_night": flag(day.isin(5, 6) & late),
    }


def one_hot(value: Column, name: str, size: int) -> dict[str, Column]:
    """0/1 columns ``name_01`` ...; all zero for values outside 1 to ``size``."""
    return {f"{name}_{i:02d}": flag(F.coalesce(value == i, F.lit(False))) for i in range(1, size + 1)}
