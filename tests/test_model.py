"""Grid, features, splits, training, metrics, ranking, serving."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.functions import scalar
from cellcast.operators import features, grid, history, logreg, metrics, ranking, report, sampling, scaling, scoring
from cellcast.plans.service import RiskService
from cellcast.schemas import CELL
from cellcast.sources import tables


def cells(spark, weeks, zone=(1, 1), day=1, hour=10):
    rows = [(dt.date.fromisoformat(w), 2026, 1, *zone, day, hour, 1, 1, 1, 0, 0, 0, 0, 0, 0) for w in weeks]
    return spark.createDataFrame(rows, CELL)


WEEKS = ["2025-12-15", "2025-12-22", "2025-12-29", "2026-01-05"]


def test_split_follows_the_target_week(spark):
    rows = grid.candidates(grid.labelled(grid.dense_cells(cells(spark, WEEKS))))
    census = grid.label_census(rows).first()
    assert (census.candidate_cells, census.positive_cells) == (504, 3)
    split = sampling.temporal_split(rows, 2025)
    assert {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 336, "test": 168}
    assert split.where("split = 'train'").agg(F.max("target_week_start")).first()[0] < dt.date(2026, 1, 1)


def test_cutoff_is_strict_and_falls_back(spark):
    weeks = ["2026-05-18", "2026-05-25", "2026-06-01"]
    labelled = grid.labelled(grid.dense_cells(cells(spark, weeks)))
    rows = grid.candidates(labelled, "2026-06-01")
    assert [str(r[0]) for r in rows.select("target_week_start").distinct().collect()] == ["2026-05-25"]
    split = sampling.temporal_split(rows, 2025)
    assert split.where("split = 'train'").count() == 0 and split.where("split = 'test'").count() == 168
    means, stds = scaling.fit(split.where("split = 'train'"), ["relevant_count"])
    assert (means, stds) == ([0.0], [1.0])
    assert grid.candidates(labelled, " ").count() == grid.candidates(labelled, "junk").count() == 336


def test_gap_weeks_count_as_zero(spark):
    rows = features.with_averages(grid.labelled(grid.dense_cells(cells(spark, ["2026-01-05", "2026-01-19"]))))
    got = {str(r.week_start): (r["_cell_relevant_2"], r["_cell_relevant_4"], r.label) for r in rows.where("day_of_week = 1 and hour = 10").collect()}
    assert got == {"2026-01-05": (0.5, 0.25, 0.0), "2026-01-19": (0.5, 0.5, 0.0)}


def test_contexts_fill_weeks_without_incidents(spark):
    rows = features.grid_with_context(cells(spark, ["2026-01-05"], (1, 1)).unionByName(cells(spark, ["2026-01-19", "2026-01-26"], (2, 5), day=3)))
    got = {(str(r.week_start), r.district): (r["_zone_relevant_1"], r["_district_relevant_4"], r["_city_dow_hour_total_4"]) for r in rows.where("day_of_week = 3 and hour = 10").collect()}
    assert got == {("2026-01-05", 1): (1.0, 0.25, 0.0), ("2026-01-19", 1): (0.0, 0.25, 0.25), ("2026-01-05", 2): (0.0, 0.0, 0.0), ("2026-01-19", 2): (1.0, 0.25, 0.25)}


def test_one_week_has_no_candidates(spark):
    assert grid.candidates(grid.labelled(grid.dense_cells(cells(spark, ["2026-01-05"])))).count() == 0


def test_feature_order(spark):
    names = features.feature_names()
    assert len(names) == 161 == len(set(names)) and list(features.feature_columns()) == names
    assert names[14] == "district_onehot_01" and names[116] == "log_relevant_last_week" and names[160] == "city_dow_hour_relevant_ratio_4w"


def test_hash_and_rounding(spark):
    row = spark.createDataFrame([(dt.date(2025, 12, 29), 11, 23, 2, 18)], "w date, a int, b int, c int, d int")
    assert row.select(scalar.cell_hash(F.col("w"), *[F.col(c) for c in "abcd"])).first()[0] == 2562028118
    got = spark.createDataFrame([(0.00005, -0.00005, 1.0, 0.0)], "a double, b double, c double, d double")
    assert tuple(got.select(scalar.round4(F.col("a")), scalar.round4(F.col("b")), scalar.safe_ratio(F.col("c"), F.col("d"))).first()) == (0.0001, -0.0001, 0.0)


def test_negative_modulus():
    assert sampling.negative_modulus(10, 100, 0) == 1 and sampling.negative_modulus(10, 100, 2) == 5 and sampling.negative_modulus(10, 100, 3) == 4 and sampling.negative_modulus(60, 100, 2) == 1


def test_gradient_descent_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = (x @ [1, -2, 0.5, 0] + rng.normal(size=3000) > 0).astype(float)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, label double").repartition(5)
    fit = logreg.train(rows, list("abcd"), epochs=12, rate=0.1, ridge=0.01)
    w = np.zeros(5)
    for _ in range(12):
        p = 1 / (1 + np.exp(-(x @ w[1:] + w[0])))
        g = np.concatenate(([(p - y).mean()], x.T @ (p - y) / len(y)))
        g[1:] += 0.01 * w[1:]
        w -= 0.1 * g
    assert np.allclose(fit.weights, w, atol=1e-9)
    assert [h["epoch"] for h in fit.history] == [1, 5, 10, 12] and abs(fit.history[0]["log_loss"] - math.log(2)) < 1e-12


def test_codes_stand_for_features(spark, monkeypatch):
    rng = np.random.default_rng(5)
    zones = [(1, 1), (3, 77), (25, 4), (40, 90)]  # the last one lies outside every one-hot
    many = [(dt.date(2025, 11, 3) + dt.timedelta(weeks=int(w)), 2025, 11, *zones[z], int(d), int(h), 1, int(d > 3), 0, 0, 0, 0, 1, 0, 0) for w, z, d, h in rng.integers(0, (8, 4, 7, 24), (400, 4))]
    rows = features.observations(spark.createDataFrame(many, CELL)).where("hour % 5 = 0")
    names = features.feature_names()
    means, stds = scaling.fit(rows, names)
    scaled = scaling.transform(rows, names, means, stds).repartition(5)
    whole = logreg.train(scaled, names, epochs=4, ridge=0.01)
    monkeypatch.setattr(logreg, "ROWS_TO_DRIVER", 2)  # sums of partitions are added up by tasks first
    tables_ = features.code_tables(names, means, stds)
    coded = logreg.train(scaled, names, epochs=4, ridge=0.01, tables=tables_)
    assert sum(len(t.names) for t in tables_) == 12 + 25 + 77
    assert np.allclose(whole.weights, coded.weights, atol=1e-9) and np.allclose([h["log_loss"] for h in whole.history], [h["log_loss"] for h in coded.history])


def test_metrics(spark):
    rows = spark.createDataFrame([(0.9, 1.0), (0.8, 0.0), (0.8, 1.0), (0.3, 0.0), (0.1, 1.0)], "score double, label double")
    got = metrics.evaluate(rows).first()
    assert (got.tp, got.tn, got.fp, got.fn, got.samples) == (2, 1, 1, 1, 5)
    assert got.accuracy == 0.6 and got.auc == 0.5833 and got.gini == 0.1667
    one = metrics.auc(rows.where("label = 1")).first()
    assert (one.auc, one.gini) == (0.0, -1.0)


def test_ranked_levels(spark):
    rows = spark.createDataFrame([(i, (20 - i) / 20) for i in range(20)] + [(99, 0.5)], "k int, score double")
    got = ranking.ranked(rows, ["k"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 22))
    assert [r.risk_level for r in got[:7]] == ["Alto"] * 2 + ["Medio"] * 4 + ["Bajo"]
    assert [r.k for r in got if r.score == 0.5] == [10, 99]


def test_equal_scores_rank_by_their_keys(spark):
    rows = spark.createDataFrame([(i, 0.5, "x") for i in range(500)], "k int, score double, place string").repartition(6)
    got = ranking.ranked(rows, ["k"])
    assert [(r["rank"], r.k) for r in got.orderBy("rank").collect()] == [(i + 1, i) for i in range(500)]
    assert got.columns == ["k", "score", "place", "rank", "risk_level"]
    assert ranking.ranked(rows.limit(0), ["k"]).count() == 0


NAMES = ["is_weekend", "hour_sin", "district_norm", "community_area_onehot_07", "log_relevant_avg_4w", "district_onehot_05"]
MODEL = scoring.Model(NAMES, [0.2, -0.5, 0.4, 1.5, 0.7, 9.0, -0.3], [0.0, 0.0, 0.2], [1.0, 1.0, 0.5])
INPUT = "district int, community_area int, day_of_week int, hour int, week_start string, features array<double>"


def test_online_features_and_errors(spark):
    rows = spark.createDataFrame([(5, 7, 6, 6, None, None), (0, 1, 1, 1, None, None), (1, 1, 7, 1, None, None), (1, 1, 1, 24, None, None), (0, 0, 0, 0, None, [0.0] * 6), (1, 1, 1, 1, None, [1.0])], INPUT)
    vector = rows.limit(1).select(scoring.online_vector(MODEL)).first()[0]
    assert vector == pytest.approx([1.0, 1.0, 0.0, 1.0, 0.0, 1.0])  # Saturday, six o'clock, (5 / 25 - 0.2) / 0.5
    got = scoring.predict(rows, MODEL).collect()
    assert [bool(r.error_msg) for r in got] == [False, True, True, True, False, True]
    assert got[0].risk_score == round(1 / (1 + math.exp(-0.5)), 4) and got[4].risk_score == round(1 / (1 + math.exp(-0.2)), 4) and got[4].risk_level == "Medio"
    with pytest.raises(scoring.InvalidRequest):
        scoring.predict_batch(rows, MODEL)


def test_night_differs_between_training_and_serving(spark):
    row = spark.createDataFrame([(5, 22)], "d int, h int")
    flags = [row.select(*[c.alias(n) for n, c in features.calendar.calendar_flags(F.col("d"), F.col("h"), s).items()]).first() for s in (False, True)]
    assert (flags[0].is_night, flags[1].is_night) == (1.0, 0.0) and flags[1].is_friday_saturday_night == 1.0


def test_nodes(spark):
    nodes = spark.createDataFrame([("n1", "", "active"), ("n2", "", "inactive"), ("n3", "", "")], "node_id string, address string, status string")
    assert {r.node_id for r in scoring.active_nodes(nodes).collect()} == {"n1", "n3"}
    dealt = scoring.assign_nodes(spark.createDataFrame([(i,) for i in range(5)], "candidate_no int"), ["a", "b", "c"])
    assert sorted(r["n"] for r in dealt.groupBy("node_id").agg(F.count("*").alias("n")).collect()) == [1, 2, 2]
    turns = scoring.RoundRobin([("n1", "active"), ("n2", "inactive"), ("n3", "")])
    assert [turns.next() for _ in range(4)] == ["n1", "n3", "n1", "n3"]


def test_service_caches_and_logs(spark, tmp_path):
    service = RiskService(spark, MODEL, [("n1", "active"), ("n2", "")], history_path=str(tmp_path / "h"), cache_path=str(tmp_path / "c"))
    request = {"district": 5, "community_area": 70, "day_of_week": 0, "hour": 9, "week_start": "2025-02-03"}
    first, second = service.predict(request), service.predict(request)
    assert (first["cached"], second["cached"]) == (False, True) and first["risk_score"] == second["risk_score"]
    assert service.metrics()["cache_hits"] == 1 and service.history(500).count() == 2
    usage = history.usage_metrics(history.read_history(spark, str(tmp_path / "h"))).first()
    assert (usage.requests_predict, usage.cache_hits) == (2, 1)
    best = service.recommend([request, request | {"district": 7}, request | {"hour": 3}], 2).collect()
    assert len(best) == 2 and best[0].risk_score >= best[1].risk_score
    kept = history.read_history(spark, str(tmp_path / "h")).where("query_type = 'recommendations_top'")
    assert sorted(r.cached for r in kept.collect()) == [False, False, True] and service.metrics()["cache_hits"] == 2
    assert [(r.node_id, r.status) for r in service.nodes().collect()] == [("n1", "active"), ("n2", "active")]
    with pytest.raises(scoring.InvalidRequest):
        service.recommend([request, request | {"hour": 30}])


def test_service_does_without_broken_stores(spark):
    service = RiskService(spark, MODEL, history_path="no-such-store:/h", cache_path="no-such-store:/c")
    answer = service.predict({"district": 5, "community_area": 70, "day_of_week": 0, "hour": 9})
    assert not answer["cached"] and service.counters["cache_errors"] == 2 and service.counters["storage_errors"] == 1
    assert service.health()["stores"] == {"enabled": True, "history": True, "cache": True}


def test_history_limit():
    assert [history.history_limit(n) for n in (0, 1, 100, 101, -5)] == [20, 1, 100, 20, 20]


def test_files_round_trip(spark, tmp_path):
    rows = features.observations(cells(spark, WEEKS))
    names = features.feature_names()
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        tables.write_observations(rows.limit(50), path, kind)
        back = tables.read_observations(spark, path, names, kind)
        assert back.count() == 50 and back.columns == rows.columns
    with pytest.raises(tables.FeatureMismatch):
        tables.check_features(names[::-1], names)
    tables.save_model(str(tmp_path / "m.json"), MODEL)
    assert tables.load_model(str(tmp_path / "m.json")) == MODEL
    tables.write_cells_csv(cells(spark, WEEKS), str(tmp_path / "cells"), single_file=True)
    tables.write_evidence_csv(rows, str(tmp_path / "e"), names[:3], 5)
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 5


def test_reports(spark):
    runs = spark.createDataFrame([(1, 10.0), (2, 5.0), (4, 4.0)], "workers int, wall_seconds double")
    assert [(r.speedup, r.efficiency) for r in report.speedup(runs).orderBy("workers").collect()] == [(1.0, 1.0), (2.0, 1.0), (2.5, 0.625)]
    samples = spark.createDataFrame([("a", 2, "3%"), ("a", 1, "NA"), ("b", 1, "5%")], "name string, timestamp int, cpu_percent string")
    assert {r.name: r.cpu_series for r in report.cpu_series(samples).collect()} == {"a": [None, 3.0], "b": [5.0]}


def test_workflow_from_file_to_predictions(spark, tmp_path):
    from cellcast.plans import workflow

    lines = ["Date,Primary Type,District,Community Area,Arrest,Domestic"]
    for day in range(70):
        stamp = dt.datetime(2025, 11, 3) + dt.timedelta(days=day, hours=day % 24)
        for area in (1, 2):
            lines.append(f"{stamp:%m/%d/%Y %I:%M:%S %p},{('ROBBERY', 'THEFT', 'BURGLARY')[(day + area) % 3]},{area},{area},true,false")
    (tmp_path / "in.csv").write_text("\n".join(lines))
    report = workflow.run(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), train_until=2025, min_year=2020, negative_ratio=3, epochs=3)
    assert report["loader"]["valid_rows"] == 140 and report["history"][0]["log_loss"] == pytest.approx(math.log(2))
    info = report["target_info"]
    assert info["candidate_cells"] == 9 * 2 * 168 and info["kept_negative_cells"] < info["negative_cells"]
    assert report["train_metrics"]["samples"] + report["test_metrics"]["samples"] == info["positive_cells"] + info["kept_negative_cells"]
    assert len(tables.load_model(str(tmp_path / "out/model.json")).weights) == 162
    sidecar = tables.load_metadata(str(tmp_path / "out/observations.json"), features.feature_names())
    assert sidecar["train_observations"] == report["train_metrics"]["samples"] and sidecar["test_observations"] == report["test_metrics"]["samples"]
    with pytest.raises(tables.FeatureMismatch):
        tables.load_metadata(str(tmp_path / "out/observations.json"), features.feature_names()[1:])
    shown = spark.read.option("header", True).csv(str(tmp_path / "out/predictions"))
    assert shown.count() == report["test_metrics"]["samples"] and shown.columns[6] == "risk_score_estimated"


def test_history_of_a_stream(spark, tmp_path):
    from cellcast.schemas import PREDICTION_RECORD
    from cellcast.streaming.cells import stream_history

    record = ("r1", "predict", (1, 2, 3, 4, "2025-02-03"), (1, 2, 3, 4, 0.5, "Medio", "n1"), ("n1", "", "active"), False, 7, dt.datetime(2025, 2, 3))
    spark.createDataFrame([record], PREDICTION_RECORD).write.parquet(str(tmp_path / "in"))
    running = stream_history(spark.readStream.schema(PREDICTION_RECORD).parquet(str(tmp_path / "in")), str(tmp_path / "h"), str(tmp_path / "at"))
    running.processAllAvailable()
    running.stop()
    assert [(r.request_id, r.result.risk_level) for r in history.read_history(spark, str(tmp_path / "h")).collect()] == [("r1", "Medio")]


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch, tmp_path):
    from cellcast.sources import scratch

    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(scratch.NoSharedFolder):
        scratch.shared_folder(Session, "x")
    Session.sparkContext.master = "local[4]"
    assert scratch.shared_folder(Session, "x") != scratch.shared_folder(Session, "x")
