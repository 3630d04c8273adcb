"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from cellcast.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries over the whole grid that take long even here; the driver compares them.
SLOW = {
    "observation_features", "lag_averages", "context_features", "trend_burst", "standardized_moments", "observations_parquet", "observations_gzip_csv",
    "training_vectors", "prepared_metadata", "evidence_csv", "predictions_csv", "evaluate_scores", "gd_epochs", "score_cells", "standardized_features",
}


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in SLOW])
def test_query_equals_sql(spark, database, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    expected = database.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(expected)


def test_entry_without_optional_parts():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(
    "rows",
    [
        [(1.0, 0.3), (0.0, 0.2), (1.0, 0.7)],
        [(1.0, 0.0), (0.0, 0.2), (1.0, 0.7)],  # infinite
        [(1.0, 0.3), (0.0, 1.0), (1.0, 0.7)],
        [(1.0, 0.3), (0.0, 0.0), (1.0, 0.7)],  # NaN
        [(1.0, 1.0), (0.0, 0.2), (0.0, 0.7)],
        [(1.0, 0.0), (0.0, 0.0), (1.0, 0.7)],
    ],
)
def test_evaluation_of_scores_rounded_to_0_or_1(spark, monkeypatch, rows):
    """The SQL has no bound on scores in its loss; all but its scored rows is run here."""
    from cellcast.plans import serving_queries

    monkeypatch.setattr(serving_queries, "scored", lambda spark, d: spark.createDataFrame(rows, "label double, score double"))
    got = catalog.QUERIES["evaluate_scores"](spark, SF).first().asDict()
    sql = catalog.SQL["evaluate_scores"]
    assert sql.startswith(catalog._SCORED_SQL)
    values = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in rows)
    found = duckdb.sql(f"WITH scored AS (SELECT * FROM (VALUES {values}) AS v(label, score)){sql.removeprefix(catalog._SCORED_SQL)}")
    assert {k: repr(float(v)) for k, v in got.items()} == {k: repr(float(v)) for k, v in zip(found.columns, found.fetchall()[0])}
