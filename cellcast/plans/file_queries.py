"""Queries that write files and read them back, beside the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions import parsing
from cellcast.operators import cells as cell_ops
from cellcast.operators import features, grid, history, ranking, sampling, scaling, scoring
from cellcast.plans import views
from cellcast.plans.catalog import (
    _KEY_SQL, _RECORDS_SQL, _SCALED_SQL, _SCORED_SQL, _SHORT_SQL, I1, KEYS, RAW_SQL, SHORT, TRAIN_UNTIL, WEIGHTS,
    day, observed, query, r6, raw_rows, records, s6, scored, sday, short,
)
from cellcast.schemas import CELL, CELL_KEYS, COUNTERS
from cellcast.sources import incidents, tables
from cellcast.sources.scratch import shared_folder

HEADERS = ["﻿Date ", "District", "COMMUNITY area", "Primary-Type", "Arrest", "Domestic", "Year"]


def _literal_rows(rows: list[tuple], names: str) -> str:
    """Literal rows as SQL; text in quotes, numbers as they are."""
    shown = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


# raw incident files


def raw_file(spark, d) -> str:
    """Gzipped CSV files with odd headers; some fields hold quotes, delimiters and line breaks."""
    rows = raw_rows(spark, d)
    kind = F.when(F.col("event_id") % 5 == 0, F.concat(F.col("primary_type"), F.lit(' "a",\nb'))).otherwise(F.col("primary_type"))
    shown = rows.select("date", "district", "community_area", kind, "arrest", "domestic", F.col("event_id").cast("string")).toDF(*HEADERS)
    path = shared_folder(spark, "raw-csv")
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    shown.write.options(header=True, escape='"', compression="gzip", **spaces).csv(path)
    return path


@query(f"""WITH {RAW_SQL} SELECT event_id, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS occurred_at, CAST(number AS VARCHAR) AS district,
  CASE WHEN event_id % 5 = 0 THEN CASE event_type WHEN 'error' THEN 'HOMICIDE ' ELSE kind END || ' "A",' || chr(10) || 'B' ELSE kind END AS primary_type,
  lower(trim(arrest)) IN ('true','t','1','yes','y','si','sí') AS arrest FROM parsed JOIN (SELECT event_id, event_type FROM events) USING (event_id)""")
def csv_incidents(spark, d):
    raw = incidents.read_csv(spark, raw_file(spark, d))
    own = F.col("year").cast("long").alias("event_id")
    stamp = F.date_format(parsing.parse_timestamp(F.col("date")), "yyyy-MM-dd HH:mm:ss").alias("occurred_at")
    return raw.select(
        own, stamp, parsing.parse_positive_int(F.col("district")).cast("string").alias("district"),
        parsing.parse_type(F.col("primary_type")).alias("primary_type"), parsing.parse_flag(F.col("arrest")).alias("arrest"),
    )


@query("SELECT least(150, count(*)) AS rows_read FROM events")
def csv_row_limit(spark, d):
    return incidents.read_csv(spark, raw_file(spark, d), max_rows=150).agg(F.count("*").alias("rows_read"))


@query("""SELECT count(*) AS total_rows, count(*) FILTER (event_id % 5 IN (2, 3)) AS valid_rows, count(*) FILTER (event_id % 5 IN (0, 1, 4)) AS invalid_rows,
  CAST(0 AS BIGINT) AS filtered_rows, count(*) FILTER (event_id % 5 = 3) AS relevant_rows FROM events""")
def malformed_rows(spark, d):
    """Rows that are no records, are too short, too long, or hold stray quotes."""
    k = F.col("event_id") % 5
    line = (
        F.when(k == 0, "?? no record").when(k == 1, "2026-01-05").when(k == 2, "2026-01-05,3,4,THE\"FT,too,many,fields,here,9")
        .when(k == 3, " 2026-01-05, 3, 4, homicide").otherwise("2026-01-05,,,ROBBERY")
    )
    path = shared_folder(spark, "malformed-csv")
    lines = views.table(spark, d, "events").select(line.alias("Date,District,Community Area,Primary Type"))
    lines.write.options(header=True, sep="\t", escapeQuotes=False, quote="\u0001", ignoreLeadingWhiteSpace=False).csv(path)
    return cell_ops.outcome_counts(cell_ops.parse_incidents(incidents.read_csv(spark, path, quoted_breaks=False)), 2022)


@query(f"WITH {RAW_SQL} SELECT event_id, kind AS primary_type FROM parsed")
def parse_types(spark, d):
    return raw_rows(spark, d).select("event_id", parsing.parse_type(F.col("primary_type")).alias("primary_type"))


# aggregates


_CELL_LIST = f"{sday('week_start')}, CAST(year(week_start) AS INTEGER) AS year, CAST(month(week_start) AS INTEGER) AS month, {KEYS}, {', '.join(COUNTERS)}"


@query(f"{views.cells_sql(I1)} SELECT {_CELL_LIST} FROM cells")
def aggregates_csv(spark, d):
    path = shared_folder(spark, "aggregates")
    tables.write_cells_csv(short(spark, d), path)
    return spark.read.schema(CELL).option("header", True).csv(path).withColumn("week_start", day("week_start"))


@query(f"{views.cells_sql(I1)}, r AS (SELECT *, row_number() OVER (ORDER BY week_start, {KEYS}) AS position FROM cells) SELECT position, {sday('week_start')}, {KEYS}, total_count FROM r WHERE position <= 300")
def sorted_cells_head(spark, d):
    """The first rows of the aggregates file, with their place."""
    head = ranking.sorted_cells(short(spark, d)).limit(300).withColumn("at", F.monotonically_increasing_id())
    placed = head.withColumn("position", F.row_number().over(Window.orderBy("at")).cast("long"))
    return placed.select("position", day("week_start"), *CELL_KEYS, "total_count")


# prepared observations

_SUMMED = ", ".join(s6(f"sum({n})", n) for n in SHORT)
_BY_WEEK = f"SELECT {sday('target_week_start')}, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(next_week_relevant_count) AS BIGINT) AS next_week_relevant, {_SUMMED}"


def _by_week(rows: DataFrame) -> DataFrame:
    sums = [F.sum(n).alias(n) for n in SHORT]
    found = rows.groupBy("target_week_start").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), F.sum("next_week_relevant_count").alias("next_week_relevant"), *sums)
    return found.select(day("target_week_start"), "n", "positives", "next_week_relevant", *[r6(F.col(n)).alias(n) for n in SHORT])


@query(f"{_SHORT_SQL} {_BY_WEEK} FROM o GROUP BY target_week_start")
def observations_parquet(spark, d):
    """All 161 features through the Parquet form, read back with the order of features checked."""
    path = shared_folder(spark, "observations")
    tables.write_observations(observed(spark, d), path)
    return _by_week(tables.read_observations(spark, path, features.feature_names()))


@query(f"{_SHORT_SQL} {_BY_WEEK} FROM o GROUP BY target_week_start")
def observations_gzip_csv(spark, d):
    """The gzipped CSV form, with the features that are compared."""
    path = shared_folder(spark, "observations-csv")
    meta = tables.OBSERVATION_META.fieldNames()
    tables.write_observations(observed(spark, d).select(*meta, *SHORT), path, "csv")
    return _by_week(tables.read_observations(spark, path, SHORT, "csv"))


@query(f"{_SHORT_SQL} SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, {_SUMMED} FROM o")
def training_vectors(spark, d):
    """What training reads: an array of features and a label."""
    path = shared_folder(spark, "vectors")
    meta = tables.OBSERVATION_META.fieldNames()
    tables.write_observations(observed(spark, d).select(*meta, *SHORT), path)
    rows = tables.read_vectors(spark, path, SHORT)
    sums = [r6(F.sum(F.get("features", F.lit(i)))).alias(n) for i, n in enumerate(SHORT)]
    return rows.agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"), *sums)


_SCHEMA_CASES = [
    ("as expected", ""), ("first two swapped", "feature 1 is community_area_norm, expected district_norm"),
    ("last one missing", "160 features, 161 expected"), ("last one renamed", "feature 161 is other, expected city_dow_hour_relevant_ratio_4w"),
]


@query(_literal_rows(_SCHEMA_CASES, "\"case\", message"))
def feature_schema_check(spark, d):
    names = features.feature_names()
    found = []
    for (case, _), given in zip(_SCHEMA_CASES, (names, [names[1], names[0], *names[2:]], names[:-1], [*names[:-1], "other"])):
        try:
            tables.check_features(given, names)
            found.append((case, ""))
        except tables.FeatureMismatch as problem:
            found.append((case, str(problem)))
    return spark.createDataFrame(found, "case string, message string")


@query(_literal_rows([(i, n, WEIGHTS[i + 1], float(i), 1.0 + i) for i, n in enumerate(SHORT)], "position, feature, weight, mean, std"))
def model_json(spark, d):
    path = shared_folder(spark, "model") + ".json"
    tables.save_model(path, scoring.Model(SHORT, WEIGHTS, [float(i) for i in range(len(SHORT))], [1.0 + i for i in range(len(SHORT))]), epochs=80)
    model = tables.load_model(path)
    rows = zip(range(len(SHORT)), model.feature_names, model.weights[1:], model.means, model.stds)
    return spark.createDataFrame(list(rows), "position int, feature string, weight double, mean double, std double")


def _metadata_sql() -> str:
    sized = "m AS (SELECT count(*) AS candidate_cells, count(*) FILTER (label = 1) AS positive_cells, count(*) FILTER (label = 0) AS negative_cells, "
    sized += f"count(*) FILTER (year(target_week_start) <= {TRAIN_UNTIL}) AS train_observations, count(*) FILTER (year(target_week_start) > {TRAIN_UNTIL}) AS test_observations FROM o)"
    parts = [f"SELECT '{c}' AS field, {s6(f'CAST({c} AS DOUBLE)', 'value')} FROM m" for c in ("candidate_cells", "positive_cells", "negative_cells", "train_observations", "test_observations")]
    for n in SHORT:
        parts += [f"SELECT 'mean {n}', {s6(f'm_{n}', 'value')} FROM st", f"SELECT 'std {n}', {s6(f's_{n}', 'value')} FROM st"]
    return f"{_SCALED_SQL}, {sized} " + " UNION ALL ".join(parts)


@query(_metadata_sql())
def prepared_metadata(spark, d):
    """The sidecar of prepared observations, written as JSON and loaded with its features checked."""
    rows = sampling.split_by_year(observed(spark, d), TRAIN_UNTIL)
    means, stds = scaling.fit(rows.where("split = 'train'"), SHORT)
    sizes = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    path = shared_folder(spark, "metadata") + ".json"
    tables.save_json(tables.prepared_metadata(SHORT, means, stds, grid.label_census(rows).first().asDict(), sizes["train"], sizes["test"]), path)
    found = tables.load_metadata(path, SHORT)
    fields = found["target_info"] | {k: found[k] for k in ("train_observations", "test_observations")}
    fields |= {f"mean {n}": m for n, m in zip(SHORT, found["means"])} | {f"std {n}": s for n, s in zip(SHORT, found["stds"])}
    return spark.createDataFrame([(k, float(v)) for k, v in fields.items()], "field string, value double").select("field", r6(F.col("value")).alias("value"))


_SHOWN = ["district_norm", "log_relevant_avg_4w", "log_zone_relevant_avg_4w", "relevant_ratio_4w"]


@query(f"{_SHORT_SQL} SELECT {sday('week_start')}, {KEYS}, CAST(CAST(label AS INTEGER) AS VARCHAR) AS target_occurred_next_week, {', '.join(f'''printf('%.6f', {n}) AS {n}''' for n in _SHOWN)} FROM o")
def evidence_csv(spark, d):
    """The export for people to read: text with six decimals."""
    path = shared_folder(spark, "evidence")
    tables.write_evidence_csv(observed(spark, d), path, _SHOWN, 0)
    back = spark.read.option("header", True).csv(path)
    return back.select("week_start", *[F.col(k).cast("int").alias(k) for k in CELL_KEYS], "target_occurred_next_week", *_SHOWN)


@query(f"""{_SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, week_start, {KEYS}) AS rank, count(*) OVER () AS total FROM scored)
SELECT {sday('week_start')}, strftime(target_week_start, '%Y-%m-%d') AS target_week_start, {KEYS}, floor(score * 10000 + 0.5) / 10000 AS risk_score_estimated,
  CASE WHEN rank / total <= 0.10 THEN 'Alto' WHEN rank / total <= 0.30 THEN 'Medio' ELSE 'Bajo' END AS risk_level_ranked, CAST(label AS INTEGER) AS target,
  CAST(next_week_relevant_count AS BIGINT) AS next_week_relevant_count FROM r WHERE rank <= 400""")
def predictions_csv(spark, d):
    """The best ranked predictions as a file; the level counts all rows."""
    path = shared_folder(spark, "predictions")
    tables.write_predictions_csv(scored(spark, d), path, 400)
    back = spark.read.option("header", True).csv(path)
    whole = {c: "int" for c in (*CELL_KEYS, "target")} | {"risk_score_estimated": "double", "next_week_relevant_count": "long"}
    shown = ["week_start", "target_week_start", *CELL_KEYS, "risk_score_estimated", "risk_level_ranked", "target", "next_week_relevant_count"]
    return back.select(*[F.col(c).cast(whole.get(c, "string")).alias(c) for c in shown])


# history and cache as tables


@query(f"WITH {_RECORDS_SQL} SELECT request_id, query_type, {KEYS}, event_id % 100 / 100.0::DOUBLE AS risk_score, 'n' || (event_id % 3) AS node_id, cached, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM rec")
def history_write_read(spark, d):
    """Records appended in two batches; nested fields come back, vectors of features do not."""
    rows = records(spark, d)
    node = F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string"))
    made = rows.select(
        "request_id", "query_type", F.struct(*CELL_KEYS, "week_start").alias("input"),
        F.struct(*CELL_KEYS, (F.col("event_id") % 100 / 100).alias("risk_score"), F.lit("Bajo").alias("risk_level"), node.alias("node_id")).alias("result"),
        F.struct(node.alias("node_id"), F.lit("").alias("address"), F.lit("active").alias("status")).alias("node"), "cached", F.lit(3).alias("latency_ms"), "created_at", "event_id",
    )
    path = shared_folder(spark, "history")
    for part in (0, 1):
        history.append_history(made.where(F.col("event_id") % 2 == part).drop("event_id"), path)
    back = history.read_history(spark, path)
    keys = [F.col(f"input.{k}").alias(k) for k in CELL_KEYS]
    return back.select("request_id", "query_type", *keys, "result.risk_score", "node.node_id", "cached", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(f"WITH {_RECORDS_SQL} SELECT {_KEY_SQL} AS cache_key, event_id % 100 / 100.0::DOUBLE AS risk_score, strftime(created_at + INTERVAL 600 SECONDS, '%Y-%m-%d %H:%M:%S') AS expires_at FROM rec")
def cache_write_read(spark, d):
    """Cache entries with their time to live, as a table."""
    rows = records(spark, d).withColumns({"risk_score": F.col("event_id") % 100 / 100, "risk_level": F.lit("Bajo"), "node_id": F.lit("n0")})
    path = shared_folder(spark, "cache")
    history.cache_entries(rows, F.col("created_at").cast("timestamp"), 600).write.parquet(path)
    back = spark.read.schema(history.CACHE_ENTRY).parquet(path)
    return back.select("cache_key", "result.risk_score", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))
