"""Scalar arithmetic of features, scores and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: Incident categories by group; all others are not relevant.
SEVERE = ("HOMICIDE", "CRIMINAL SEXUAL ASSAULT", "SEX OFFENSE", "KIDNAPPING", "HUMAN TRAFFICKING")
VIOLENT = ("ROBBERY", "ASSAULT", "BATTERY", "INTIMIDATION", "STALKING")
WEAPONS = ("WEAPONS VIOLATION", "CONCEALED CARRY LICENSE VIOLATION")
PROPERTY = ("BURGLARY", "MOTOR VEHICLE THEFT", "ARSON")


def crime_group(kind: Column) -> Column:
    kind = F.trim(F.upper(kind))
    return F.when(kind.isin(*SEVERE), "severe").when(kind.isin(*VIOLENT), "violent").when(kind.isin(*WEAPONS), "weapons").when(kind.isin(*PROPERTY), "property").otherwise("other")


def is_relevant(kind: Column) -> Column:
    return crime_group(kind) != "other"


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is as good as 0."""
    return F.when(F.abs(b) < 1e-12, 0.0).otherwise(a / F.when(F.abs(b) < 1e-12, 1.0).otherwise(b))


def round4(value: Column) -> Column:
    """Four decimals, halves away from zero; infinity and NaN stay what they are."""
    return F.when(F.abs(value) < float("inf"), F.signum(value) * F.floor(F.abs(value) * 10000 + 0.5) / 10000).otherwise(value)


def sigmoid(z: Column) -> Column:
    """Logistic function without overflow on either side."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def log_loss(label: Column, p: Column, bounded: bool = True) -> Column:
    """Loss of a score, kept off 0 and 1; without that bound, scores of 0 and 1 give infinity or NaN."""
    if bounded:
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    ln = F.ln if bounded else lambda x: F.when(x == 0, float("-inf")).otherwise(F.ln(x))  # Spark's ln(0) is null, which an average skips
    return -(label * ln(p) + (1 - label) * ln(1 - p))


def probability(weights: list[float], features: list[Column]) -> Column:
    """Logistic score; the first weight is the intercept, and features without a weight are ignored."""
    z = F.lit(float(weights[0]))
    for weight, feature in zip(weights[1:], features):
        z = z + F.lit(float(weight)) * feature
    return sigmoid(z)


def probability_of_vector(weights: list[float], features: Column) -> Column:
    """The same for an array column."""
    w = F.array(*[F.lit(float(x)) for x in weights[1:]])
    pairs = F.zip_with(F.slice(features, 1, len(weights) - 1), w, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return sigmoid(F.aggregate(pairs, F.lit(float(weights[0])), lambda a, x: a + x))


def risk_label(score: Column) -> Column:
    """Absolute level of an unrounded score."""
    return F.when(score >= 0.70, "Alto").when(score >= 0.40, "Medio").otherwise("Bajo")


def fnv1a(*parts: Column) -> Column:
    """32-bit FNV-1a over arrays of byte values."""
    return F.aggregate(F.concat(*parts), F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def cell_hash(week: Column, *keys: Column) -> Column:
    """Stable hash of a cell: the bytes of its week's text, then one byte for each key."""
    text = F.date_format(week, "yyyy-MM-dd")
    letters = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    return fnv1a(letters, F.array(*[k.cast("long").bitwiseAND(F.lit(255).cast("long")) for k in keys]))


def counter_of(group: str) -> str:
    """Counter column of a group's name."""
    return {"minor": "other_count", "other": "other_count", "total": "total_count"}.get(group, f"{group}_count" if group in ("relevant", "violent", "property", "weapons", "severe") else "relevant_count")


def pick(vector: Column, index: list[int]) -> Column:
    """Elements of an array at the given positions; positions outside it are left out."""
    return F.transform(F.filter(F.array(*[F.lit(i) for i in index]), lambda i: (i >= 0) & (i < F.size(vector))), lambda i: F.get(vector, i))


def standardize(value: Column, mean: float | None, std: float | None) -> Column:
    """(value - mean) / std; a missing mean counts as 0, a missing or zero std as 1."""
    return (value - F.lit(float(mean or 0.0))) / F.lit(float(std or 1.0))


def cache_key(district: Column, area: Column, day: Column, hour: Column, week: Column, features: Column | None = None) -> Column:
    key = F.concat(F.lit("risk:district="), district.cast("string"), F.lit(":community="), area.cast("string"), F.lit(":dow="), day.cast("string"), F.lit(":hour="), hour.cast("string"), F.lit(":week="), F.coalesce(week, F.lit("")))
    if features is None:
        return key
    return F.when(F.size(F.coalesce(features, F.array().cast("array<double>"))) > 0, F.concat(F.lit("risk:features:"), F.sha1(F.to_json(features).cast("binary")))).otherwise(key)


def input_error(district: Column, area: Column, day: Column, hour: Column, features: Column, expected: int) -> Column:
    """Why a prediction's input is not valid, or null.  A vector only needs the right length."""
    has = F.size(F.coalesce(features, F.array().cast("array<double>"))) > 0
    cells = F.when(~F.coalesce((district > 0) & (area > 0), F.lit(False)), "district and community_area must be positive").when(~F.coalesce(day.between(0, 6), F.lit(False)), "day_of_week must be between 0 and 6").when(~F.coalesce(hour.between(0, 23), F.lit(False)), "hour must be between 0 and 23")
    return F.when(has, F.when(F.size(features) != expected, F.concat(F.lit("features: "), F.size(features).cast("string"), F.lit(f" given, {expected} expected")))).otherwise(cells)
