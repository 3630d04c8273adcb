"""Tolerant parsing of raw text fields, as column expressions that never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted layouts of a date, as patterns with their parts.
_FRACTION = r"(?:[.,]\d+)?"
AMERICAN_12 = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) (\d{{1,2}}):(\d{{2}}):(\d{{2}}){_FRACTION} (AM|PM)$"
AMERICAN_24 = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) (\d{{1,2}}):(\d{{2}}):(\d{{2}}){_FRACTION}$"
ISO_SPACE = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}}) (\d{{1,2}}):(\d{{2}}):(\d{{2}}){_FRACTION}$"
ISO_MILLIS = r"^(\d{4})-(\d{2})-(\d{2})T(\d{1,2}):(\d{2}):(\d{2})[.,]\d{3}$"
ISO_OFFSET = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})T(\d{{1,2}}):(\d{{2}}):(\d{{2}}){_FRACTION}(?:Z|[+-]\d{{2}}:\d{{2}})$"
ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})$"

TRUE_WORDS = ("true", "t", "1", "yes", "y", "si", "sí")
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def parse_timestamp(column: Column) -> Column:
    """Wall-clock timestamp of the first layout that fits; null if none does.

    An offset is read but the local clock is kept.  Fractions of a second are accepted and cut.
    Twelve-hour clocks take 00 to 12 and an upper-case AM or PM.
    """
    text = F.trim(column)
    clock12 = _part(text, AMERICAN_12, 4)
    hour12 = F.when(clock12 <= 12, F.pmod(clock12, F.lit(12)) + F.when(F.regexp_extract(text, AMERICAN_12, 7) == "PM", 12).otherwise(0))

    def made(pattern: str, year: int, month: int, day: int, hour: Column) -> Column:
        minute, second = _part(text, pattern, 5), _part(text, pattern, 6)
        stamp = F.try_make_timestamp_ntz(_part(text, pattern, year), _part(text, pattern, month), _part(text, pattern, day), hour, minute, second)
        return F.when(second < 60, stamp)  # a leap second would be carried over

    out = F.when(text.rlike(AMERICAN_12), made(AMERICAN_12, 3, 1, 2, hour12)).when(text.rlike(AMERICAN_24), made(AMERICAN_24, 3, 1, 2, _part(text, AMERICAN_24, 4)))
    for pattern in (ISO_SPACE, ISO_MILLIS, ISO_OFFSET):
        out = out.when(text.rlike(pattern), made(pattern, 1, 2, 3, _part(text, pattern, 4)))
    zero = F.lit(0)
    return out.when(text.rlike(ISO_DATE), F.try_make_timestamp_ntz(*[_part(text, ISO_DATE, g) for g in (1, 2, 3)], zero, zero, zero))


def parse_positive_int(column: Column) -> Column:
    """Positive integer; text with a point is read as a decimal above 0 and truncated."""
    text = F.trim(column)
    decimal = F.when(text.rlike(_DECIMAL), text.try_cast("double"))
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return F.when(text.contains("."), F.when(decimal > 0, decimal.try_cast("bigint"))).otherwise(F.when(whole > 0, whole)).try_cast("int")


def parse_flag(column: Column) -> Column:
    """True for the words that mean yes, false for anything else."""
    return F.coalesce(F.lower(F.trim(column)).isin(*TRUE_WORDS), F.lit(False))


def parse_type(column: Column) -> Column:
    """Upper-case, trimmed category; a missing one is empty."""
    return F.coalesce(F.trim(F.upper(column)), F.lit(""))


def parse_week(column: Column) -> Column:
    """Date of a ``yyyy-MM-dd`` text, or null."""
    return F.when(column.rlike(ISO_DATE), column.try_cast("date"))


def percent_to_double(column: Column) -> Column:
    """Number with an optional percent sign; blanks, NA and other text are null."""
    text = F.trim(F.regexp_replace(F.trim(column), "%", ""))
    return F.when(text.rlike(_DECIMAL), text.try_cast("double"))


def memory_to_mb(column: Column) -> Column:
    """Megabytes of the first quantity of a text such as ``56.2MiB / 7.6GiB``."""
    first = F.trim(F.split_part(column, F.lit("/"), F.lit(1)))
    number = F.regexp_extract(first, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(first, r"([A-Za-z]+)$", 1))
    scale = F.when(unit == "gib", 1024.0).when(unit == "gb", 1000.0).when(unit.isin("mib", "mb"), 1.0).when(unit == "kib", 1 / 1024).when(unit == "kb", 1 / 1000)
    return number * scale


def number_or_zero(column: Column, kind: str = "double") -> Column:
    """Numeric coercion of a loosely typed field: anything that is not a number is 0."""
    return F.coalesce(column.try_cast("double").try_cast(kind), F.lit(0).cast(kind))
