"""Parsing, outcomes, classification and cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellcast.functions import parsing, scalar
from cellcast.operators import cells as C
from cellcast.sources import incidents as S

#: Two weeks and a year that is too early; one date, one district and one area cannot be read.
CSV = """Year,Community Area,Primary Type,Date,District,Domestic,Arrest
2024,8,BURGLARY,2024-03-12 23:15:00,4,true,1
2024,8,ARSON,03/12/2024 11:40:00 PM,4,false,no
2024,8,NARCOTICS,3/13/2024 0:05:00,4,false,yes
2024,9,STALKING,2024-03-18,4,false,false
2019,9,KIDNAPPING,2019-07-01 08:00:00,4,false,false
2024,9,ASSAULT,12.03.2024,4,false,false
2024,9,ASSAULT,2024-03-12 10:00:00,none,false,false
2024,-2,ASSAULT,2024-03-12 10:00:00,4,false,false
"""


@pytest.fixture
def parsed(spark, tmp_path):
    path = tmp_path / "incidents.csv"
    path.write_text(CSV)
    return C.parse_incidents(S.read_csv(spark, str(path)))


def test_outcomes_and_cells(parsed):
    row = C.outcome_counts(parsed, 2020).first()
    assert (row.total_rows, row.valid_rows, row.invalid_rows, row.filtered_rows, row.relevant_rows) == (8, 4, 3, 1, 3)
    cells = {(str(c.week_start), c.community_area, c.day_of_week, c.hour): c for c in C.weekly_cells(C.valid_incidents(parsed, 2020)).collect()}
    # both forms of a quarter to midnight fall in one cell; midnight is the next day's
    assert {k: (c.total_count, c.relevant_count, c.arrest_count, c.domestic_count) for k, c in cells.items()} == {
        ("2024-03-11", 8, 2, 23): (2, 2, 1, 1), ("2024-03-11", 8, 3, 0): (1, 0, 1, 0), ("2024-03-18", 9, 1, 0): (1, 1, 0, 0),
    }
    assert {(c.year, c.month) for c in cells.values()} == {(2024, 3)}
    stats = C.loader_stats(parsed, 2020).first()
    assert stats.aggregated_cells == 3 and stats.years == {2024: 4} and stats.primary_types == {"BURGLARY": 1, "ARSON": 1, "NARCOTICS": 1, "STALKING": 1}


def test_quoted_line_breaks_stay_in_their_field(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('Date,District,Community Area,Primary Type\n2024-03-12,4,8,"THEFT\nOVER ""500"""\n2024-03-13,4,8,ARSON\n\njunk\n')
    rows = S.read_csv(spark, str(path)).collect()
    assert [(r.date, r.district, r.primary_type) for r in rows] == [("2024-03-12", "4", 'THEFT\nOVER "500"'), ("2024-03-13", "4", "ARSON"), ("junk", None, None)]
    counts = C.outcome_counts(C.parse_incidents(S.read_csv(spark, str(path))), 2020).first()
    assert (counts.total_rows, counts.valid_rows, counts.invalid_rows) == (3, 2, 1)
    assert S.read_csv(spark, str(path), quoted_breaks=False).count() == 4  # for files that are known to have none


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text('community_area,CommunityArea, Date ,DISTRICT,primary-type\n9,3,2026-01-05,2,"A ""B"""\n9,4,2026-01-05\n9,5,2026-01-05,2,X,extra\n')
    rows = S.read_csv(spark, str(path)).collect()
    assert [r.community_area for r in rows] == ["3", "4", "5"]  # the last of equal headers counts
    assert rows[0].primary_type == 'A "B"' and rows[1].district is None and rows[2].primary_type == "X"
    assert S.read_csv(spark, str(path), max_rows=2).count() == 2


def test_missing_headers():
    with pytest.raises(S.MissingColumns, match="district, community_area"):
        S.resolve_headers(["Date", "Primary Type"])


@pytest.mark.parametrize(
    "text, expected",
    [
        ("01/02/2026 03:04:05 PM", "2026-01-02 15:04:05"),
        ("1/2/2026 3:04:05 AM", "2026-01-02 03:04:05"),
        ("01/02/2026 00:30:00 AM", "2026-01-02 00:30:00"),
        ("01/02/2026 12:30:00 AM", "2026-01-02 00:30:00"),
        ("01/02/2026 13:30:00 PM", None),
        ("01/02/2026 03:04:05 pm", None),
        ("01/02/2026 23:04:05", "2026-01-02 23:04:05"),
        ("1/2/2026 3:04:05", "2026-01-02 03:04:05"),
        (" 2026-01-02 22:00:00 ", "2026-01-02 22:00:00"),
        ("2026-01-02 22:00:00.123", "2026-01-02 22:00:00"),
        ("2026-01-01T22:00:00.000", "2026-01-01 22:00:00"),
        ("2026-01-01T22:00:00", None),
        ("2026-01-01T22:00:00-05:00", "2026-01-01 22:00:00"),
        ("2026-01-01T22:00:00Z", "2026-01-01 22:00:00"),
        ("2026-01-02", "2026-01-02 00:00:00"),
        ("02/30/2026 10:00:00 AM", None),
        ("", None),
        (None, None),
    ],
)
def test_dates(spark, text, expected):
    got = spark.createDataFrame([(text,)], "d string").select(parsing.parse_timestamp(F.col("d"))).first()[0]
    assert (got.strftime("%Y-%m-%d %H:%M:%S") if got else None) == expected


def test_numbers_and_flags(spark):
    texts = {"1": 1, " 7 ": 7, "12.0": 12, "0.5": 0, "-3": None, "": None, "1e3": None, "1.5e1": 15, "x": None, "0": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsing.parse_positive_int(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts
    words = {"true": True, "T": True, "1": True, "Yes": True, "y": True, "si": True, "sí": True, "no": False, "": False, None: False}
    rows = spark.createDataFrame([(t,) for t in words], "t string").select("t", parsing.parse_flag(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == words


def test_report_fields(spark):
    row = spark.createDataFrame([("12.5%", "NA", "56.2MiB / 7.6GiB", "2GiB / 4GiB", "512KiB")], "a string, b string, c string, d string, e string")
    got = row.select(parsing.percent_to_double(F.col("a")), parsing.percent_to_double(F.col("b")), *[parsing.memory_to_mb(F.col(c)) for c in "cde"]).first()
    assert tuple(got) == (12.5, None, 56.2, 2048.0, 0.5)


def test_classification(spark):
    kinds = {"THEFT": "other", "CRIMINAL DAMAGE": "other", "CRIMINAL TRESPASS": "other", "": "other", "ROBBERY": "violent", "BATTERY": "violent", "WEAPONS VIOLATION": "weapons", "BURGLARY": "property", "MOTOR VEHICLE THEFT": "property", "HOMICIDE": "severe"}
    rows = spark.createDataFrame([(k,) for k in kinds], "k string").select("k", scalar.crime_group(F.col("k")).alias("g")).collect()
    assert {r.k: r.g for r in rows} == kinds


def test_stream_of_cells(spark, tmp_path):
    from cellcast.streaming.cells import streaming_weekly_cells

    schema = "occurred_at timestamp, district int, community_area int, primary_type string"
    rows = [(dt.datetime(2026, 1, 5, 10), 1, 1, "ROBBERY"), (dt.datetime(2026, 1, 11, 10), 1, 1, "THEFT"), (dt.datetime(2026, 3, 2, 10), 1, 1, "THEFT")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = streaming_weekly_cells(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(str(r.week_start), r.day_of_week, r.total_count) for r in spark.table("weeks").collect()} == {("2026-01-05", 1, 1), ("2026-01-05", 0, 1), ("2026-03-02", 1, 1)}
