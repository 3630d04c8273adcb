"""Raw incident files: tolerant CSV reading and header resolution."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Logical columns and the normalised headers that stand for them.
REQUIRED = {"date": "date", "district": "district", "community_area": "communityarea", "primary_type": "primarytype"}
OPTIONAL = {"arrest": "arrest", "domestic": "domestic", "year": "year"}


class MissingColumns(ValueError):
    """The header lacks required columns."""


def normalize_header(name: str) -> str:
    return re.sub(r"[ _\-.()]", "", name.strip().lower())


def resolve_headers(headers: list[str]) -> dict[str, int]:
    """Position of each logical column; of equal headers the last one counts."""
    at = {normalize_header(h.lstrip("﻿")): i for i, h in enumerate(headers)}
    missing = [k for k, v in REQUIRED.items() if v not in at]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return {k: at[v] for k, v in (REQUIRED | OPTIONAL).items() if v in at}


def select_raw(rows: DataFrame) -> DataFrame:
    """Any table with resolvable headers as the raw text columns the parser reads."""
    at = resolve_headers(rows.columns)
    renamed = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])  # headers may repeat
    return renamed.select(*[(F.col(f"c{at[k]}").cast("string") if k in at else F.lit(None).cast("string")).alias(k) for k in (*REQUIRED, *OPTIONAL)])


def read_csv(spark: SparkSession, path: str, max_rows: int = 0, quoted_breaks: bool = True) -> DataFrame:
    """Raw text columns of a CSV (compressed or not).

    Ragged rows are kept: short ones are padded with nulls, more fields than the header has are
    left out.  A row that cannot be split into fields at all comes back with null fields, so that
    it counts as a row that was read and as an invalid one.  Quotes that are not doubled are text.

    A quoted field may hold line breaks, which means that a file is read from its start by one
    task.  Where that is known not to happen, ``quoted_breaks=False`` lets tasks share a file;
    otherwise hand large inputs over as many files.  ``max_rows`` counts rows as they are read,
    also those that will turn out invalid.
    """
    options = {"header": False, "mode": "PERMISSIVE", "escape": '"', "ignoreLeadingWhiteSpace": True}
    options |= {"multiLine": quoted_breaks, "maxColumns": 100_000}  # an odd row must not stop the job
    first = spark.read.options(**options).csv(path).limit(1).first()
    if first is None:
        raise MissingColumns("empty file")
    names = [str(v) if v is not None else "" for v in first]
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    rows = spark.read.options(**options | {"header": True, "enforceSchema": True}).schema(schema).csv(path)
    at = resolve_headers(names)
    raw = rows.select(*[(F.col(f"c{at[k]}") if k in at else F.lit(None).cast("string")).alias(k) for k in (*REQUIRED, *OPTIONAL)])
    return raw.limit(max_rows) if max_rows > 0 else raw
