"""Named queries over the driver's tables and the SQL they must equal.

Doubles are rounded to six places with 0.0 added, so that both engines print the same value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.functions import calendar, parsing, scalar
from cellcast.operators import cells as cell_ops
from cellcast.operators import features, grid, history, logreg, metrics, ranking, report, sampling, scaling, scoring
from cellcast.plans import views
from cellcast.schemas import CELL_KEYS, COUNTERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEYS = ", ".join(CELL_KEYS)
I1, I2 = views.I1_SQL, views.I2_SQL
CUTOFF, TRAIN_UNTIL = "2001-06-01", 2000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def s6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def sday(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d') AS {name}"


def short(spark, d) -> DataFrame:
    return cell_ops.weekly_cells(views.event_incidents(spark, d))


def long(spark, d) -> DataFrame:
    return cell_ops.weekly_cells(views.order_incidents(spark, d))


# ingest and cells

#: Raw text made from events, with planted bad rows, for the parsers.
def raw_rows(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    k = F.col("event_id") % 12
    ts = F.col("ts").cast("timestamp_ntz")
    f = lambda p: F.date_format(ts, p)
    date = (
        F.when(k == 0, f("MM/dd/yyyy hh:mm:ss a")).when(k == 1, f("M/d/yyyy h:mm:ss a")).when(k == 2, f("MM/dd/yyyy HH:mm:ss")).when(k == 3, f("M/d/yyyy H:mm:ss")).when(k == 4, f("yyyy-MM-dd HH:mm:ss"))
        .when(k == 5, f("yyyy-MM-dd'T'HH:mm:ss.SSS")).when(k == 6, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 7, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))).when(k == 8, f("yyyy-MM-dd"))
        .when(k == 9, F.lit("02/30/2026 10:00:00 AM")).when(k == 10, f("yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.lit("  "), f("yyyy-MM-dd HH:mm:ss")))
    )
    n = F.col("user_id") % 9
    number = F.when(n == 0, "1").when(n == 1, " 7 ").when(n == 2, "12.0").when(n == 3, "0.5").when(n == 4, "-3").when(n == 5, "").when(n == 6, "1e3").when(n == 7, "1.5e1").otherwise(F.col("user_id").cast("string"))
    words = F.array(*[F.lit(w) for w in ("true", "T", "1", "Yes", "y", "si", "sí", "no", "false", " TRUE ", "", "0")])
    kind = F.when(F.col("event_type") == "error", "Homicide ").when(F.col("event_type") == "purchase", " burglary").when(F.col("event_type") == "signup", "WEAPONS violation").otherwise(F.concat(F.lit(" "), F.lower("event_type")))
    return e.select("event_id", date.alias("date"), number.alias("district"), F.lit("5").alias("community_area"), kind.alias("primary_type"), F.get(words, k.cast("int")).alias("arrest"), F.lit("false").alias("domestic"))


RAW_SQL = """raw AS (
  SELECT event_id, CASE event_id % 12 WHEN 0 THEN strftime(ts, '%m/%d/%Y %I:%M:%S %p') WHEN 1 THEN strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p') WHEN 2 THEN strftime(ts, '%m/%d/%Y %H:%M:%S')
      WHEN 3 THEN strftime(ts, '%-m/%-d/%Y %-H:%M:%S') WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0')
      WHEN 6 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:00' WHEN 8 THEN strftime(ts, '%Y-%m-%d') WHEN 9 THEN '02/30/2026 10:00:00 AM'
      WHEN 10 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE '  ' || strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date,
    CASE user_id % 9 WHEN 0 THEN '1' WHEN 1 THEN ' 7 ' WHEN 2 THEN '12.0' WHEN 3 THEN '0.5' WHEN 4 THEN '-3' WHEN 5 THEN '' WHEN 6 THEN '1e3' WHEN 7 THEN '1.5e1' ELSE CAST(user_id AS VARCHAR) END AS district,
    CASE event_type WHEN 'error' THEN 'HOMICIDE' WHEN 'purchase' THEN 'BURGLARY' WHEN 'signup' THEN 'WEAPONS VIOLATION' ELSE upper(event_type) END AS kind, ['true','T','1','Yes','y','si','sí','no','false',' TRUE ','','0'][event_id % 12 + 1] AS arrest
  FROM events), parsed AS (
  SELECT *, CASE WHEN event_id % 12 IN (9, 10) THEN NULL WHEN event_id % 12 = 8 THEN try_strptime(date, '%Y-%m-%d')
      WHEN date LIKE '%/%M' THEN try_strptime(date, '%m/%d/%Y %I:%M:%S %p') WHEN date LIKE '%/%' THEN try_strptime(date, '%m/%d/%Y %H:%M:%S')
      ELSE try_strptime(replace(substr(trim(date), 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S') END AS stamp,
    CASE WHEN contains(district, '.') THEN CASE WHEN try_cast(trim(district) AS DOUBLE) > 0 THEN CAST(trunc(CAST(trim(district) AS DOUBLE)) AS INTEGER) END
      WHEN regexp_full_match(trim(district), '[+-]?[0-9]+') AND CAST(trim(district) AS BIGINT) > 0 THEN CAST(trim(district) AS INTEGER) END AS number
  FROM raw)"""


@query(f"WITH {RAW_SQL} SELECT event_id, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM parsed")
def parse_dates(spark, d):
    return raw_rows(spark, d).select("event_id", F.date_format(parsing.parse_timestamp(F.col("date")), "yyyy-MM-dd HH:mm:ss").alias("occurred_at"))


@query(f"WITH {RAW_SQL} SELECT event_id, CAST(number AS VARCHAR) AS number FROM parsed")
def parse_numbers(spark, d):
    return raw_rows(spark, d).select("event_id", parsing.parse_positive_int(F.col("district")).cast("string").alias("number"))


@query(f"WITH {RAW_SQL} SELECT event_id, lower(trim(arrest)) IN ('true','t','1','yes','y','si','sí') AS flag FROM parsed")
def parse_flags(spark, d):
    return raw_rows(spark, d).select("event_id", parsing.parse_flag(F.col("arrest")).alias("flag"))


@query(f"""WITH {RAW_SQL}, o AS (SELECT kind, CASE WHEN stamp IS NULL OR number IS NULL THEN 'invalid' WHEN year(stamp) < 2024 THEN 'filtered' ELSE 'valid' END AS outcome FROM parsed)
SELECT count(*) AS total_rows, count(*) FILTER (outcome = 'valid') AS valid_rows, count(*) FILTER (outcome = 'invalid') AS invalid_rows, count(*) FILTER (outcome = 'filtered') AS filtered_rows, count(*) FILTER (outcome = 'valid' AND kind IN ('HOMICIDE', 'BURGLARY', 'WEAPONS VIOLATION')) AS relevant_rows FROM o""")
def row_outcomes(spark, d):
    return cell_ops.outcome_counts(cell_ops.parse_incidents(raw_rows(spark, d)), 2024)


@query(f"WITH {I1}, {views.GROUPED_SQL} SELECT primary_type, crime_group, crime_group <> 'other' AS relevant, count(*) AS n FROM g GROUP BY ALL")
def classify_types(spark, d):
    rows = views.event_incidents(spark, d).groupBy("primary_type").agg(F.count("*").alias("n"))
    return rows.select("primary_type", scalar.crime_group(F.col("primary_type")).alias("crime_group"), scalar.is_relevant(F.col("primary_type")).alias("relevant"), "n")


@query(f"WITH {I2} SELECT CAST(year(occurred_at) AS INTEGER) AS year, count(*) AS \"rows\" FROM i GROUP BY ALL")
def year_histogram(spark, d):
    return cell_ops.year_histogram(views.order_incidents(spark, d))


@query(f"WITH {I2} SELECT primary_type, count(*) AS \"rows\" FROM i GROUP BY ALL")
def type_histogram(spark, d):
    return cell_ops.type_histogram(views.order_incidents(spark, d))


@query(f"{views.cells_sql(I1)} SELECT {sday('week_start')}, CAST(year(week_start) AS INTEGER) AS year, CAST(month(week_start) AS INTEGER) AS month, {KEYS}, {', '.join(COUNTERS)} FROM cells")
def weekly_cells(spark, d):
    return short(spark, d).withColumn("week_start", day("week_start"))


@query(f"{views.cells_sql(I1)} SELECT count(*) AS aggregated_cells FROM cells")
def cell_count(spark, d):
    return short(spark, d).agg(F.count("*").alias("aggregated_cells"))


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS)


@query(f"{views.cells_sql(I1)} SELECT {sday('week_start')}, district, community_area, {_SUMS} FROM cells GROUP BY week_start, district, community_area")
def zone_week_totals(spark, d):
    return cell_ops.zone_week_totals(short(spark, d)).withColumn("week_start", day("week_start"))


@query(f"{views.cells_sql(I1)} SELECT {sday('week_start')}, district, {_SUMS} FROM cells GROUP BY week_start, district")
def district_week_totals(spark, d):
    return cell_ops.district_week_totals(short(spark, d)).withColumn("week_start", day("week_start"))


@query(f"{views.cells_sql(I1)} SELECT {sday('week_start')}, day_of_week, hour, {_SUMS} FROM cells GROUP BY week_start, day_of_week, hour")
def city_dow_hour_totals(spark, d):
    return cell_ops.city_dow_hour_totals(short(spark, d)).withColumn("week_start", day("week_start"))


@query(
    f"{views.cells_sql(I1)}, z AS (SELECT DISTINCT district, community_area FROM cells), w AS (SELECT DISTINCT week_start FROM cells) "
    "SELECT 'zone' AS kind, district || '/' || community_area AS value, CAST(row_number() OVER (ORDER BY district, community_area) AS INTEGER) AS position FROM z "
    "UNION ALL SELECT 'week', strftime(week_start, '%Y-%m-%d'), CAST(row_number() OVER (ORDER BY week_start) AS INTEGER) FROM w"
)
def zones_weeks(spark, d):
    """Zones and weeks with the place at which the operators return them."""
    cells = short(spark, d)

    def placed(rows: DataFrame, kind: str, value: Column) -> DataFrame:
        own = rows.select(F.lit(kind).alias("kind"), value.alias("value")).withColumn("at", F.monotonically_increasing_id())
        return own.select("kind", "value", F.row_number().over(Window.orderBy("at")).alias("position"))

    zones = placed(cell_ops.zones(cells), "zone", F.concat_ws("/", "district", "community_area"))
    return zones.unionByName(placed(cell_ops.weeks(cells), "week", F.date_format("week_start", "yyyy-MM-dd")))


# grid, labels, features


@query(f"{views.grid_sql(I1)} SELECT {sday('week_start')}, {KEYS}, strftime(target_week_start, '%Y-%m-%d') AS target_week_start, relevant_count, other_count, total_count, next_week_relevant_count, label FROM grid")
def dense_grid_labels(spark, d):
    rows = grid.candidates(grid.labelled(grid.dense_cells(short(spark, d))))
    return rows.select(day("week_start"), *CELL_KEYS, day("target_week_start"), "relevant_count", "other_count", "total_count", "next_week_relevant_count", "label")


@query(f"{views.grid_sql(I2)} SELECT count(*) AS candidate_cells, count(*) FILTER (label = 1) AS positive_cells, count(*) FILTER (label = 0) AS negative_cells FROM grid WHERE target_week_start < DATE '{CUTOFF}'")
def label_census(spark, d):
    return grid.label_census(grid.candidates(grid.labelled(grid.dense_cells(long(spark, d))), CUTOFF))


def _frame(counter: str, n: int, over: str = KEYS) -> str:
    return f"sum({counter}) OVER (PARTITION BY {over} ORDER BY week_no RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW) / CAST({n} AS DOUBLE)"


_AVERAGES = [(g, n) for g, frames in features.FRAMES.items() for n in frames]
_LAGS_SQL = "lags AS (SELECT *, " + ", ".join(f"{_frame(features.COUNTER[g], n)} AS {g}_{n}" for g, n in _AVERAGES) + " FROM dense), base AS (SELECT * FROM lags WHERE week_start < (SELECT max(week_start) FROM cells))"


def averages(spark, d) -> DataFrame:
    return grid.candidates(grid.labelled(features.with_averages(grid.dense_cells(long(spark, d)))))


@query(f"{views.grid_sql(I2)}, {_LAGS_SQL} SELECT {sday('week_start')}, {KEYS}, {', '.join(s6(f'{g}_{n}', f'{g}_{n}') for g, n in _AVERAGES)} FROM base")
def lag_averages(spark, d):
    return averages(spark, d).select(day("week_start"), *CELL_KEYS, *[r6(F.col(f"_cell_{g}_{n}")).alias(f"{g}_{n}") for g, n in _AVERAGES])


@query(
    f"{views.grid_sql(I2)}, {_LAGS_SQL} SELECT {sday('week_start')}, {KEYS}, {s6('relevant_2 - relevant_12', 'trend_relevant_2w_12w')}, {s6('relevant_4 - relevant_12', 'trend_relevant_4w_12w')}, "
    f"{s6('relevant_1 / (relevant_4 + 0.01)', 'burst_relevant_last_vs_avg4')}, {s6('minor_4 - minor_12', 'trend_minor_4w_12w')}, {s6('minor_1 / (minor_4 + 0.01)', 'burst_minor_last_vs_avg4')}, "
    f"{s6('total_4 - total_12', 'trend_total_4w_12w')}, {s6('CASE WHEN total_4 < 1e-12 THEN 0.0 ELSE relevant_4 / total_4 END', 'relevant_ratio_4w')} FROM base"
)
def trend_burst(spark, d):
    made = features.history_features()
    names = ["trend_relevant_2w_12w", "trend_relevant_4w_12w", "burst_relevant_last_vs_avg4", "trend_minor_4w_12w", "burst_minor_last_vs_avg4", "trend_total_4w_12w", "relevant_ratio_4w"]
    return averages(spark, d).select(day("week_start"), *CELL_KEYS, *[r6(made[n]).alias(n) for n in names])


_CONTEXT_COLUMNS = [(level, g, n) for level, (_, groups) in features.CONTEXTS.items() for g, frames in groups.items() for n in frames]


def _context_sql() -> str:
    parts, joins = [], []
    for level, (keys, groups) in features.CONTEXTS.items():
        k = ", ".join(keys)
        sums = ", ".join(f"sum({features.COUNTER[g]}) AS {features.COUNTER[g]}" for g in groups)
        frames = ", ".join(f"{_frame(features.COUNTER[g], n, k)} AS {level}_{g}_{n}" for g, f in groups.items() for n in f)
        parts.append(f"{level}_sums AS (SELECT week_no, {k}, {sums} FROM dense GROUP BY week_no, {k}), {level}_context AS (SELECT week_no, {k}, {frames} FROM {level}_sums)")
        joins.append(f"JOIN {level}_context USING (week_no, {k})")
    return ", ".join(parts) + f", context AS (SELECT * FROM base {' '.join(joins)})"


@query(f"{views.grid_sql(I2)}, {_LAGS_SQL}, {_context_sql()} SELECT {sday('week_start')}, {KEYS}, {', '.join(s6(f'ln(1 + {lv}_{g}_{n})', f'{lv}_{g}_{n}') for lv, g, n in _CONTEXT_COLUMNS)} FROM context")
def context_features(spark, d):
    rows = features.grid_with_context(long(spark, d))
    return rows.select(day("week_start"), *CELL_KEYS, *[r6(F.log1p(F.col(f"_{lv}_{g}_{n}"))).alias(f"{lv}_{g}_{n}") for lv, g, n in _CONTEXT_COLUMNS])


_SLOTS_SQL = "SELECT CAST(s // 24 AS INTEGER) AS day_of_week, CAST(s % 24 AS INTEGER) AS hour, CAST(m AS INTEGER) AS month FROM range(168) AS a(s), range(1, 13) AS b(m)"


def _calendar_sql() -> str:
    out = [s6(f"{f}({c} * {2 * math.pi!r} / {p})", f"{n}_{f}") for n, c, p in (("hour", "hour", 24), ("day", "day_of_week", 7), ("month", "month", 12)) for f in ("sin", "cos")]
    for name, test in (("is_weekend", "day_of_week IN (0, 6)"), ("is_night", "hour >= 20 OR hour <= 5"), ("is_morning", "hour BETWEEN 6 AND 11"), ("is_afternoon", "hour BETWEEN 12 AND 17"), ("is_evening", "hour BETWEEN 18 AND 23"), ("is_friday_saturday_night", "day_of_week IN (5, 6) AND (hour >= 18 OR hour <= 3)")):
        out.append(f"CAST({test} AS DOUBLE) AS {name}")
    return ", ".join(out)


@query(f"SELECT day_of_week, hour, month, {_calendar_sql()} FROM ({_SLOTS_SQL})")
def calendar_features(spark, d):
    slots = spark.range(168 * 12).select((F.col("id") % 168).alias("s"), (F.floor(F.col("id") / 168) + 1).cast("int").alias("month"))
    slots = slots.select(F.floor(F.col("s") / 24).cast("int").alias("day_of_week"), (F.col("s") % 24).cast("int").alias("hour"), "month")
    made = features.calendar_features(F.col("day_of_week"), F.col("hour"), F.col("month"))
    return slots.select("day_of_week", "hour", "month", *[r6(c).alias(n) for n, c in made.items()])


@query(f"{views.cells_sql(I1)} SELECT DISTINCT district, community_area, {', '.join(f'CAST(district = {i} AS DOUBLE) AS district_onehot_{i:02d}' for i in range(1, 26))} FROM cells")
def onehot_district(spark, d):
    zones = cell_ops.zones(short(spark, d))
    return zones.select("district", "community_area", *[c.alias(n) for n, c in calendar.one_hot(F.col("district"), "district_onehot", 25).items()])


_HASH_SQL = "list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(strftime(week_start, '%Y-%m-%d'), ''), lambda c: CAST(ascii(c) AS BIGINT)), [CAST(district AS BIGINT) % 256, CAST(community_area AS BIGINT) % 256, CAST(day_of_week AS BIGINT) % 256, CAST(hour AS BIGINT) % 256]), lambda h, b: CAST((xor(h, b)::HUGEINT * 16777619) % 4294967296 AS BIGINT))"


@query(f"""{views.grid_sql(I2)}, census AS (SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM grid),
m AS (SELECT CASE WHEN pos * 2 <= 0 OR pos * 2 >= neg THEN 1 ELSE CAST(ceil(neg / (pos * 2.0)) AS BIGINT) END AS modulus FROM census),
h AS (SELECT *, {_HASH_SQL} AS cell_hash FROM grid)
SELECT {sday('week_start')}, {KEYS}, label, cell_hash FROM h, m WHERE label = 1 OR cell_hash % modulus = 0""")
def negative_sampling(spark, d):
    rows = sampling.sample_negatives(grid.candidates(grid.labelled(grid.dense_cells(long(spark, d)))), 2)
    return rows.select(day("week_start"), *CELL_KEYS, "label", scalar.cell_hash(F.col("week_start"), *[F.col(k) for k in CELL_KEYS]).alias("cell_hash"))


def _census(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "target_week_start").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives")).withColumn("target_week_start", day("target_week_start"))


_SPLIT_CENSUS = "SELECT split, strftime(target_week_start, '%Y-%m-%d') AS target_week_start, count(*) AS n, count(*) FILTER (label = 1) AS positives FROM s GROUP BY ALL"


@query(f"{views.grid_sql(I2)}, s AS (SELECT *, CASE WHEN year(target_week_start) <= {TRAIN_UNTIL} THEN 'train' ELSE 'test' END AS split FROM grid) {_SPLIT_CENSUS}")
def temporal_split(spark, d):
    return _census(sampling.temporal_split(grid.candidates(grid.labelled(grid.dense_cells(long(spark, d)))), TRAIN_UNTIL))


@query(f"""{views.grid_sql(I2)}, w AS (SELECT list(DISTINCT target_week_start ORDER BY target_week_start) AS weeks FROM grid),
c AS (SELECT weeks[least(greatest(CAST(floor(len(weeks) * 0.8) AS BIGINT), 1), len(weeks) - 1) + 1] AS cut FROM w),
s AS (SELECT grid.*, CASE WHEN target_week_start < cut THEN 'train' ELSE 'test' END AS split FROM grid, c) {_SPLIT_CENSUS}""")
def fallback_split(spark, d):
    return _census(sampling.temporal_split(grid.candidates(grid.labelled(grid.dense_cells(long(spark, d)))), 1990))


# every history feature in SQL, for the statistics and the scores
def _history_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    last = lambda n: "last_week" if n == 1 else f"avg_{n}w"
    ratio = lambda a, b: f"CASE WHEN abs({b}) < 1e-12 THEN 0.0 ELSE {a} / {b} END"
    for g, frames in features.FRAMES.items():
        for n in frames:
            out[f"log_{'total_incidents' if g == 'total' else g}_{last(n)}"] = f"ln(1 + {g}_{n})"
        if g in ("relevant", "minor"):
            if g == "relevant":
                out["trend_relevant_2w_12w"] = "relevant_2 - relevant_12"
            out[f"trend_{g}_4w_12w"] = f"{g}_4 - {g}_12"
            out[f"burst_{g}_last_vs_avg4"] = f"{g}_1 / ({g}_4 + 0.01)"
            out[f"any_{g}_last_week"] = f"CAST({g}_1 > 0 AS DOUBLE)"
    out |= {"trend_total_4w_12w": "total_4 - total_12", "relevant_ratio_4w": ratio("relevant_4", "total_4"), "minor_ratio_4w": ratio("minor_4", "total_4")}
    for lv, (_, groups) in features.CONTEXTS.items():
        for g, frames in groups.items():
            for n in frames:
                out[f"log_{lv}_{g}_{last(n)}"] = f"ln(1 + {lv}_{g}_{n})"
        out[f"{lv}_relevant_ratio_4w"] = ratio(f"{lv}_relevant_4", f"{lv}_total_4")
    return out


def _all_features_sql() -> dict[str, str]:
    out = {"district_norm": "district / 25.0::DOUBLE", "community_area_norm": "community_area / 77.0::DOUBLE"}
    for n, c, p in (("hour", "hour", 24), ("day", "day_of_week", 7), ("month", "month(week_start)", 12)):
        out |= {f"{n}_{f}": f"{f}({c} * {2 * math.pi!r} / {p})" for f in ("sin", "cos")}
    for name, test in (("is_weekend", "day_of_week IN (0, 6)"), ("is_night", "hour >= 20 OR hour <= 5"), ("is_morning", "hour BETWEEN 6 AND 11"), ("is_afternoon", "hour BETWEEN 12 AND 17"), ("is_evening", "hour BETWEEN 18 AND 23"), ("is_friday_saturday_night", "day_of_week IN (5, 6) AND (hour >= 18 OR hour <= 3)")):
        out[name] = f"CAST({test} AS DOUBLE)"
    out |= {f"district_onehot_{i:02d}": f"CAST(district = {i} AS DOUBLE)" for i in range(1, 26)}
    out |= {f"community_area_onehot_{i:02d}": f"CAST(community_area = {i} AS DOUBLE)" for i in range(1, 78)}
    return out | _history_sql()


_FEATURES_SQL = f"{views.grid_sql(I2)}, {_LAGS_SQL}, {_context_sql()}, f AS (SELECT week_start, CAST(week_start + 7 AS DATE) AS target_week_start, {KEYS}, {', '.join(f'{e} AS {n}' for n, e in _all_features_sql().items())} FROM context)"
_FEATURES_SQL += f", o AS (SELECT f.*, label, next_week_relevant_count FROM f JOIN grid USING (week_start, {KEYS}))"


def observed(spark, d) -> DataFrame:
    return features.observations(long(spark, d))


@query(f"{_FEATURES_SQL} SELECT {sday('week_start')}, {KEYS}, label, {', '.join(s6(n, n) for n in _history_sql())} FROM o")
def observation_features(spark, d):
    rows = observed(spark, d)
    return rows.select(day("week_start"), *CELL_KEYS, "label", *[r6(F.col(n)).alias(n) for n in _history_sql()])


_TRAIN = f"train AS (SELECT * FROM o WHERE year(target_week_start) <= {TRAIN_UNTIL})"


@query(f"{_FEATURES_SQL}, {_TRAIN} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, {s6(f'avg({n})', 'mean')}, {s6(f'CASE WHEN stddev_pop({n}) < 1e-9 THEN 1.0 ELSE stddev_pop({n}) END', 'std')} FROM train" for n in _all_features_sql()))
def standardize_stats(spark, d):
    train = sampling.split_by_year(observed(spark, d), TRAIN_UNTIL).where("split = 'train'")
    return scaling.summary(train, features.feature_names()).select("feature", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


#: A few features, for queries that compare standardised values, scores and gradients row by row.
SHORT = ["district_norm", "hour_sin", "is_weekend", "log_relevant_avg_4w", "log_zone_relevant_avg_4w", "relevant_ratio_4w"]
WEIGHTS = [-1.5, 0.3, -0.2, 0.1, 0.8, 0.4, -0.3]
#: Only what these features need, made once: the engine would run a shared part for each use of it.
_SHORT_SQL = f"""{views.grid_sql(I2)}, l AS (SELECT *, {_frame('relevant_count', 4)} AS relevant_4, {_frame('total_count', 4)} AS total_4 FROM labelled),
zs AS (SELECT week_no, district, community_area, sum(relevant_count) AS relevant_count FROM dense GROUP BY ALL),
zc AS (SELECT week_no, district, community_area, {_frame('relevant_count', 4, 'district, community_area')} AS zone_relevant_4 FROM zs),
o AS MATERIALIZED (SELECT week_start, target_week_start, {KEYS}, CASE WHEN next_week_relevant_count > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
  next_week_relevant_count, {', '.join(f'{_all_features_sql()[n]} AS {n}' for n in SHORT)}
  FROM l JOIN zc USING (week_no, district, community_area) WHERE week_start < (SELECT max(week_start) FROM cells))"""
_SCALED_SQL = f"{_SHORT_SQL}, {_TRAIN}, st AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) < 1e-9 THEN 1.0 ELSE stddev_pop({n}) END AS s_{n}" for n in SHORT) + f" FROM train), z AS (SELECT week_start, target_week_start, {KEYS}, label, next_week_relevant_count, " + ", ".join(f"({n} - m_{n}) / s_{n} AS {n}" for n in SHORT) + " FROM o, st)"


def scaled(spark, d) -> DataFrame:
    rows = sampling.split_by_year(observed(spark, d), TRAIN_UNTIL)
    means, stds = scaling.fit(rows.where("split = 'train'"), SHORT)
    kept = rows.select("week_start", "target_week_start", *CELL_KEYS, "label", "next_week_relevant_count", "current_minor_count", "current_total_incidents", "split", *SHORT)
    return scaling.transform(kept, SHORT, means, stds)


@query(f"{_SCALED_SQL} SELECT {sday('week_start')}, {KEYS}, {', '.join(s6(n, n) for n in SHORT)} FROM z")
def standardized_features(spark, d):
    return scaled(spark, d).select(day("week_start"), *CELL_KEYS, *[r6(F.col(n)).alias(n) for n in SHORT])


_SPLIT_STATS = f"{_FEATURES_SQL}, b AS (SELECT *, CASE WHEN year(target_week_start) <= {TRAIN_UNTIL} THEN 'train' ELSE 'test' END AS split FROM o)"
_SPLIT_STATS += ", p AS MATERIALIZED (SELECT split, " + ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in _all_features_sql()) + " FROM b GROUP BY split)"


def _standardised_moments(n: str) -> str:
    spread = f"CASE WHEN t.s_{n} < 1e-9 THEN 1.0 ELSE t.s_{n} END"
    return f"SELECT '{n}' AS feature, p.split, {s6(f'(p.m_{n} - t.m_{n}) / ({spread})', 'mean')}, {s6(f'CASE WHEN p.s_{n} / ({spread}) < 1e-9 THEN 1.0 ELSE p.s_{n} / ({spread}) END', 'std')} FROM p, p AS t WHERE t.split = 'train'"


@query(f"{_SPLIT_STATS} " + " UNION ALL ".join(map(_standardised_moments, _all_features_sql())))
def standardized_moments(spark, d):
    """Mean and deviation of all 161 standardised features in both parts."""
    names = features.feature_names()
    rows = sampling.split_by_year(observed(spark, d), TRAIN_UNTIL).select("split", *names)
    means, stds = scaling.fit(rows.where("split = 'train'"), names)
    scaled_rows = scaling.transform(rows, names, means, stds)
    parts = [scaling.summary(scaled_rows.where(F.col("split") == s), names).withColumn("split", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1]).select("feature", "split", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


# scores, metrics, ranking

_Z = f"{WEIGHTS[0]} + " + " + ".join(f"({w}) * {n}" for w, n in zip(WEIGHTS[1:], SHORT))
#: Scores are rounded before they are ranked, so that both engines see the same ties.
_SCORED_SQL = f"{_SCALED_SQL}, scored AS (SELECT *, round(1 / (1 + exp(-({_Z}))), 6) AS score FROM z)"


def scored(spark, d) -> DataFrame:
    return scoring.score_observations(scaled(spark, d), WEIGHTS, SHORT).withColumn("score", F.round("score", 6))


@query(f"{_SCORED_SQL} SELECT {sday('week_start')}, {KEYS}, label, score FROM scored")
def score_cells(spark, d):
    return scored(spark, d).select(day("week_start"), *CELL_KEYS, "label", "score")


@query(f"{_SCORED_SQL} SELECT CASE WHEN score >= 0.70 THEN 'Alto' WHEN score >= 0.40 THEN 'Medio' ELSE 'Bajo' END AS risk_level, count(*) AS n FROM scored GROUP BY ALL")
def risk_labels(spark, d):
    return scored(spark, d).groupBy(scalar.risk_label(F.col("score")).alias("risk_level")).agg(F.count("*").alias("n"))


@query(f"{_SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, week_start, {KEYS}) AS rank, count(*) OVER () AS total FROM scored) SELECT {sday('week_start')}, {KEYS}, score, rank, CASE WHEN rank / total <= 0.10 THEN 'Alto' WHEN rank / total <= 0.30 THEN 'Medio' ELSE 'Bajo' END AS risk_level FROM r")
def ranked_levels(spark, d):
    return ranking.ranked(scored(spark, d), ["week_start", *CELL_KEYS]).select(day("week_start"), *CELL_KEYS, "score", "rank", "risk_level")


_CANDIDATES_SQL = f"{_SCORED_SQL}, numbered AS (SELECT {KEYS}, score AS risk_score, CAST(((district * 2 + community_area) * 168 + day_of_week * 24 + hour) AS BIGINT) AS candidate_no FROM scored WHERE week_start = (SELECT max(week_start) FROM scored)), dealt AS (SELECT *, 'n' || (candidate_no % 3) AS node_id FROM numbered)"


def dealt(spark, d) -> DataFrame:
    rows = scored(spark, d)
    last = rows.agg(F.max("week_start").alias("last"))
    rows = rows.join(F.broadcast(last), F.col("week_start") == F.col("last")).select(*CELL_KEYS, F.col("score").alias("risk_score"))
    number = ((F.col("district") * 2 + F.col("community_area")) * 168 + F.col("day_of_week") * 24 + F.col("hour")).cast("long")
    return scoring.assign_nodes(rows.withColumn("candidate_no", number), ["n0", "n1", "n2"])


@query(f"{_CANDIDATES_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY node_id ORDER BY risk_score DESC, {KEYS}) AS INTEGER) AS node_rank FROM dealt) SELECT node_id, node_rank, {KEYS}, risk_score FROM r WHERE node_rank <= 5")
def node_topn(spark, d):
    return ranking.top_by_node(dealt(spark, d), 5).select("node_id", "node_rank", *CELL_KEYS, "risk_score")


@query(f"{_CANDIDATES_SQL} SELECT node_id, {KEYS}, risk_score FROM dealt ORDER BY risk_score DESC, {KEYS} LIMIT 10")
def global_topn(spark, d):
    partial = ranking.top_by_node(dealt(spark, d), 10)
    return ranking.top(partial, 10, CELL_KEYS).select("node_id", *CELL_KEYS, "risk_score")


_R4 = lambda e: f"sign({e}) * floor(abs({e}) * 10000 + 0.5) / 10000"
_COUNTS_SQL = f"{_SCORED_SQL}, c AS (SELECT count(*) AS samples, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM scored)"
_P, _R = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END", "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END"


@query(f"{_COUNTS_SQL}, q AS (SELECT *, {_P} AS p, {_R} AS r FROM c) SELECT {_R4('((tp + tn) / samples)')} AS accuracy, {_R4('p')} AS precision, {_R4('r')} AS recall, {_R4('(CASE WHEN p + r < 1e-12 THEN 0.0 ELSE 2 * p * r / (p + r) END)')} AS f1, samples, positives, samples - positives AS negatives, tp, tn, fp, fn FROM q")
def confusion_metrics(spark, d):
    return metrics.confusion(scored(spark, d)).drop("log_loss")


@query(f"{_SCORED_SQL}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM scored), a AS (SELECT (sum(mid) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS auc FROM r) SELECT {s6('auc', 'auc')}, {s6('2 * auc - 1', 'gini')} FROM a")
def auc_gini(spark, d):
    return metrics.auc(scored(spark, d)).select(r6(F.col("auc")).alias("auc"), r6(F.col("gini")).alias("gini"))


@query(f"{_SCORED_SQL} SELECT {s6('avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))))', 'log_loss')} FROM scored")
def log_loss(spark, d):
    return scored(spark, d).agg(r6(F.avg(scalar.log_loss(F.col("label"), F.col("score")))).alias("log_loss"))


@query(f"{_SCALED_SQL}, tr AS (SELECT * FROM z WHERE year(target_week_start) <= {TRAIN_UNTIL}) SELECT 0 AS position, {s6('-0.05 * avg(0.5 - label)', 'weight')} FROM tr " + " ".join(f"UNION ALL SELECT {i}, {s6(f'-0.05 * avg((0.5 - label) * {n})', 'weight')} FROM tr" for i, n in enumerate(SHORT, 1)))
def gd_first_epoch(spark, d):
    fit = logreg.train(scaled(spark, d).where("split = 'train'"), SHORT, epochs=1, rate=0.05)
    return spark.createDataFrame(list(enumerate(fit.weights)), "position int, weight double").select("position", r6(F.col("weight")).alias("weight"))


_GD_EPOCHS, _GD_RIDGE = 6, 0.01


def _descent_sql() -> str:
    """An epoch is a one-row step: the loss before it, and the weights after it."""
    k = range(len(SHORT) + 1)
    steps = [f"tr AS MATERIALIZED (SELECT * FROM z WHERE year(target_week_start) <= {TRAIN_UNTIL})", "w0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS w{i}" for i in k) + ")"]
    x = ["1.0", *SHORT]
    z = " + ".join(f"w{i} * {x[i]}" for i in k)
    for e in range(1, _GD_EPOCHS + 1):
        after = ", ".join(f"any_value(w{i}) - 0.05 * (avg((p - label) * {x[i]}) + {_GD_RIDGE if i else 0.0} * any_value(w{i})) AS w{i}" for i in k)
        loss = "avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS loss"
        steps.append(f"w{e} AS MATERIALIZED (SELECT {after}, {loss} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM tr, w{e - 1}))")
    rows = [f"SELECT 'weight' AS kind, {i} AS position, {s6(f'w{i}', 'value')} FROM w{_GD_EPOCHS}" for i in k]
    rows += [f"SELECT 'loss', {e}, {s6('loss', 'value')} FROM w{e}" for e in (1, 5, 6)]
    return ", ".join(steps) + " " + " UNION ALL ".join(rows)


@query(f"{_SCALED_SQL}, {_descent_sql()}")
def gd_epochs(spark, d):
    """Weights and loss history of some epochs, with the calendar and district features taken from codes."""
    rows = sampling.split_by_year(observed(spark, d), TRAIN_UNTIL).where("split = 'train'")
    means, stds = scaling.fit(rows, SHORT)
    scaled_rows = scaling.transform(rows.select("label", "week_start", *CELL_KEYS, *SHORT), SHORT, means, stds)
    fit = logreg.train(scaled_rows, SHORT, _GD_EPOCHS, 0.05, _GD_RIDGE, tables=features.code_tables(SHORT, means, stds))
    found = [("weight", i, w) for i, w in enumerate(fit.weights)] + [("loss", h["epoch"], h["log_loss"]) for h in fit.history]
    return spark.createDataFrame(found, "kind string, position int, value double").withColumn("value", r6(F.col("value")))


@query()
def gd_train(spark, d):
    """Eighty epochs over all 161 features; the history with rounded losses."""
    rows = sampling.split_by_year(observed(spark, d), TRAIN_UNTIL).where("split = 'train'")
    names = features.feature_names()
    means, stds = scaling.fit(rows, names)
    scaled_rows = scaling.transform(rows.select("label", "week_start", *CELL_KEYS, *names), names, means, stds)
    fit = logreg.train(scaled_rows, names, epochs=80, rate=0.05, ridge=0.0005, tables=features.code_tables(names, means, stds))
    return spark.createDataFrame([(h["epoch"], h["log_loss"]) for h in fit.history], "epoch int, log_loss double").select("epoch", r6(F.col("log_loss")).alias("log_loss"))


# history, cache, reports


def records(spark, d) -> DataFrame:
    """Requests and their results as an application might log them, made from events."""
    e = views.table(spark, d, "events")
    return e.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"), F.when(F.col("event_id") % 3 == 0, "recommendations_top").otherwise("predict").alias("query_type"), (F.col("event_id") % 5 == 0).alias("cached"),
        (F.col("user_id") % 25 + 1).cast("int").alias("district"), (F.col("user_id") % 77 + 1).cast("int").alias("community_area"), (F.col("event_id") % 7).cast("int").alias("day_of_week"), (F.col("event_id") % 24).cast("int").alias("hour"),
        F.lit("2026-06-01").alias("week_start"), F.col("ts").cast("timestamp_ntz").alias("created_at"), (F.round(F.abs(F.col("value")), 2)).alias("risk_score"), "event_id",
    )


_RECORDS_SQL = "rec AS (SELECT 'r' || event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'recommendations_top' ELSE 'predict' END AS query_type, event_id % 5 = 0 AS cached, CAST(user_id % 25 + 1 AS INTEGER) AS district, CAST(user_id % 77 + 1 AS INTEGER) AS community_area, CAST(event_id % 7 AS INTEGER) AS day_of_week, CAST(event_id % 24 AS INTEGER) AS hour, '2026-06-01' AS week_start, ts AS created_at, event_id FROM events)"
_KEY_SQL = "'risk:district=' || district || ':community=' || community_area || ':dow=' || day_of_week || ':hour=' || hour || ':week=' || week_start"


@query(f"WITH {_RECORDS_SQL} SELECT request_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM rec ORDER BY rec.created_at DESC, request_id LIMIT 20")
def history_latest(spark, d):
    return history.latest(records(spark, d), 500).select("request_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(f"WITH {_RECORDS_SQL} SELECT count(*) FILTER (query_type = 'predict') AS requests_predict, count(*) FILTER (query_type = 'recommendations_top') AS requests_recommendations_top, count(*) FILTER (cached) AS cache_hits FROM rec")
def usage_metrics(spark, d):
    return history.usage_metrics(records(spark, d))


@query(f"""WITH {_RECORDS_SQL}, entries AS (SELECT {_KEY_SQL} AS cache_key, event_id, created_at + INTERVAL 300 SECONDS AS expires_at FROM rec WHERE event_id % 4 = 0),
live AS (SELECT cache_key, arg_max(event_id, expires_at) AS stored FROM entries WHERE expires_at > TIMESTAMP '2024-01-10' GROUP BY ALL)
SELECT request_id, k.cache_key, stored IS NOT NULL AS cached FROM (SELECT *, {_KEY_SQL} AS cache_key FROM rec) k LEFT JOIN live USING (cache_key)""")
def cache_probe(spark, d):
    rows = records(spark, d)
    entries = rows.where("event_id % 4 = 0").select(history.request_key(rows).alias("cache_key"), F.struct("event_id").alias("result"), (F.col("created_at") + F.expr("INTERVAL 300 SECONDS")).alias("expires_at"))
    probed = history.probe_cache(rows, entries, F.expr("timestamp_ntz'2024-01-10 00:00:00'"))
    return probed.select("request_id", "cache_key", "cached")


_RUNS_SQL = "runs AS (SELECT CAST(l_linenumber AS INTEGER) AS workers, CAST(sum(l_quantity) AS DOUBLE) AS wall_seconds FROM lineitem GROUP BY ALL)"


@query(f"WITH {_RUNS_SQL}, b AS (SELECT *, first_value(wall_seconds) OVER (ORDER BY workers) AS base FROM runs) SELECT workers, {s6('wall_seconds', 'wall_seconds')}, {s6('base / wall_seconds', 'speedup')}, {s6('base / wall_seconds / workers', 'efficiency')} FROM b")
def speedup_table(spark, d):
    runs = views.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("workers")).agg(F.sum("l_quantity").alias("wall_seconds"))
    return report.speedup(runs).select("workers", r6(F.col("wall_seconds")).alias("wall_seconds"), r6(F.col("speedup")).alias("speedup"), r6(F.col("efficiency")).alias("efficiency"))


@query("WITH s AS (SELECT event_type AS name, CASE WHEN event_id % 7 = 0 THEN 'NA' ELSE CAST(event_id % 97 AS VARCHAR) || '%' END AS cpu, event_id % 500 AS ram FROM events) SELECT name, round(avg(try_cast(replace(cpu, '%', '') AS DOUBLE)), 6) + 0.0 AS cpu_avg_percent, max(try_cast(replace(cpu, '%', '') AS DOUBLE)) AS cpu_max_percent, max(CAST(ram AS DOUBLE)) AS ram_peak_mb FROM s GROUP BY name")
def resource_summary(spark, d):
    e = views.table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("name"), F.when(F.col("event_id") % 7 == 0, "NA").otherwise(F.concat((F.col("event_id") % 97).cast("string"), F.lit("%"))).alias("cpu_percent"), (F.col("event_id") % 500).cast("string").alias("ram_mb"))
    return report.resource_summary(rows, "name").withColumn("cpu_avg_percent", r6(F.col("cpu_avg_percent")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cellcast.plans import file_queries, serving_queries  # they register themselves  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
