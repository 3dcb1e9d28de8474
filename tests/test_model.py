import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from demandcast.operators.metrics import score_metrics
from demandcast.plans.features import feature_frame, feature_names
from demandcast.plans.model import (best_iteration, feature_importances, fit_forecaster,
                                    gbt_settings, model_parameters, predict)
from demandcast.plans.search import draw_trials, random_search
from demandcast.session import checkpointed, shared_path
from demandcast.sources.sinks import RunLog, load_model, save_model


@pytest.fixture(scope="module")
def made_frames(spark):
    """Series with a trend and a weekday effect: a model must beat the mean."""
    rng = random.Random(5)
    rows = []
    for store in (1, 2):
        for item in (1, 2, 3):
            for i in range(400):
                day = dt.date(2016, 1, 1) + dt.timedelta(days=i)
                level = 20 + 10 * store + 5 * item + 0.05 * i + (15 if day.weekday() >= 5 else 0)
                rows.append((day, store, item, int(level + rng.gauss(0, 2))))
    panel = spark.createDataFrame(rows, "date date, store int, item int, sales int")
    ff = checkpointed(feature_frame(panel, alphas=(0.6, 0.85), trailing=True))
    return tuple(ff.filter(F.col("Dataset") == t) for t in ("Train", "Validation", "Test"))


def test_parameters_and_mapping():
    p = model_parameters()
    assert p["learning_rate"] == 0.1 and p["max_depth"] == 3 and p["num_leaves"] == 7
    s = gbt_settings(p, 30)
    assert s["lossType"] == "absolute" and s["maxDepth"] == 3 and s["subsamplingRate"] == 0.8
    assert s["minInstancesPerNode"] == 7
    s2 = gbt_settings(model_parameters({"max_depth": 19, "num_leaves": 19,
                                        "feature_fraction": 0.9}), 5)
    assert s2["maxDepth"] == 5 and s2["featureSubsetStrategy"] == "0.9"
    assert s["minInfoGain"] == p["min_split_gain"]
    deep = {k: v for k, v in p.items() if k != "num_leaves"}
    assert gbt_settings({**deep, "max_depth": 19}, 5)["maxDepth"] == 19
    with pytest.raises(ValueError):
        gbt_settings({**deep, "max_depth": 31}, 5)
    with pytest.raises(ValueError):
        gbt_settings({**p, "max_dept": 3}, 5)


def test_early_stop_cuts_the_longer_fit(spark, made_frames):
    train, valid, test = made_frames
    fit = fit_forecaster(train, valid, feature_names(), patience=3)
    # it stopped by patience, long before the default rounds
    assert fit.best_iteration + 3 <= len(fit.history) < 5000
    assert fit.history[fit.best_iteration - 1] == min(fit.history[:fit.best_iteration + 3])
    whole = fit_forecaster(train, None, feature_names(), max_iter=fit.best_iteration)
    key = ["store", "item", "date"]
    both = predict(fit, test).join(predict(whole, test).withColumnRenamed("prediction", "p2")
                                   .select(*key, "p2"), key)
    assert both.filter(F.abs(F.col("prediction") - F.col("p2")) > 1e-9).count() == 0
    assert fit.model.stages[2].getNumTrees == fit.best_iteration


def test_predict_checks_input_types(spark, made_frames):
    train, _, test = made_frames
    fit = fit_forecaster(train, None, feature_names(), max_iter=2)
    with pytest.raises(ValueError, match="store"):
        predict(fit, test.withColumn("store", F.col("store").cast("string")))
    with pytest.raises(ValueError, match="lacks"):
        predict(fit, test.drop("item"))


def test_best_iteration_patience():
    assert best_iteration([5, 4, 3, 3.5, 3.6, 3.7], patience=2) == 3
    assert best_iteration([5, 4, 3, 3.5, 2.0], patience=5) == 5
    assert best_iteration([1.0], patience=1) == 1


def test_model_beats_mean_and_is_repeatable(spark, made_frames):
    train, valid, test = made_frames
    features = feature_names()
    a = fit_forecaster(train, valid, features, max_iter=25, patience=10)
    b = fit_forecaster(train, valid, features, max_iter=25, patience=10)
    pa = predict(a, test)
    mean = train.agg(F.avg("sales")).first()[0]
    model_mae = score_metrics(pa).first()["mae"]
    mean_mae = score_metrics(test.withColumn("prediction", F.lit(mean))).first()["mae"]
    assert model_mae < 0.5 * mean_mae
    joined = pa.join(predict(b, test).withColumnRenamed("prediction", "p2"),
                     ["store", "item", "date"])
    assert joined.filter(F.abs(F.col("prediction") - F.col("p2")) > 1e-9).count() == 0
    assert a.valid_mape is not None and a.valid_rmse is not None
    imp = feature_importances(a, 10).collect()
    assert len(imp) == 10 and imp[0]["importance"] >= imp[-1]["importance"]


def test_save_load_same_predictions(spark, made_frames):
    train, valid, test = made_frames
    fit = fit_forecaster(train, None, feature_names(), max_iter=5)
    path = shared_path(spark, f"test-models/{RunLog.new_run_id()}")
    save_model(fit, path, input_example=train.select(*feature_names()))
    loaded = load_model(spark, path)
    a = predict(fit, test).select("store", "item", "date", "prediction")
    b = predict(loaded, test).select("store", "item", "date",
                                     F.col("prediction").alias("p2"))
    assert a.join(b, ["store", "item", "date"]).filter(
        F.col("prediction") != F.col("p2")).count() == 0


def test_random_search_logs_trials(spark, made_frames):
    train, valid, _ = made_frames
    assert draw_trials(3, seed=42) == draw_trials(3, seed=42)
    log = RunLog(spark, shared_path(spark, f"test-runlog/{RunLog.new_run_id()}"))
    trials, best = random_search(train, valid, feature_names(), n_trials=2, max_iter=4,
                                 patience=2, parallelism=2, run_log=log)
    rows = trials.collect()
    assert len(rows) == 2 and set(best) == {"learning_rate", "max_depth", "num_leaves",
                                            "bagging_fraction", "feature_fraction"}
    assert min(r["objective"] for r in rows) == pytest.approx(
        [r for r in rows if r["trial"] == min(rows, key=lambda r: (r["objective"], r["trial"]))["trial"]][0]["objective"])
    assert log.read().filter(F.col("kind") == "metric").count() == 2 * 4


def test_forecast_report_end_to_end(spark):
    from demandcast.plans.forecast import forecast_report
    rng = random.Random(9)
    rows = [(dt.date(2017, 1, 1) + dt.timedelta(days=i), s, 1,
             int(30 + 5 * s + (10 if (dt.date(2017, 1, 1) + dt.timedelta(days=i)).weekday() >= 5
                               else 0) + rng.gauss(0, 2)))
            for s in (1, 2, 3) for i in range(200)]
    panel = spark.createDataFrame(rows, "date date, store int, item int, sales int")
    log = RunLog(spark, shared_path(spark, f"test-report/{RunLog.new_run_id()}"))
    rep = forecast_report(panel, max_iter=8, patience=4, run_log=log)
    stores = [r["store"] for r in rep.store_metrics.collect()]
    assert stores == [1, 2, 3]
    assert rep.test_metrics.first()["n"] == rep.test_predictions.count()
    assert rep.store_means.first()["mean_mape"] is not None
    assert log.read().count() > 0


def test_forecast_report_with_search(spark, made_frames):
    from demandcast.plans.forecast import forecast_report
    train, _, _ = made_frames
    panel = train.select("date", "store", "item", "sales")
    rep = forecast_report(panel, max_iter=4, patience=2, search_trials=2, search_rounds=3)
    assert rep.trials.count() == 2
    assert rep.store_metrics.count() == 2  # the made series have stores 1 and 2


def test_tuned_store_metrics_searches_ten_trials_and_can_fail(spark, monkeypatch):
    import inspect

    from demandcast.plans import registry
    frame = spark.createDataFrame([(1, 10.0), (1, 12.0), (2, 30.0)], "store int, sales double")
    searched = inspect.signature(registry.random_search)
    trials = []

    def search(*args, **kwargs):
        bound = searched.bind(*args, **kwargs)
        bound.apply_defaults()
        trials.append(bound.arguments["n_trials"])
        return None, {}

    monkeypatch.setattr(registry, "_frames", lambda *_: (frame, frame, frame))
    monkeypatch.setattr(registry, "random_search", search)
    monkeypatch.setattr(registry, "retrain_best", lambda *a, **k: None)
    for off, beats in ((0.5, True), (1e6, False)):
        monkeypatch.setattr(registry, "predict", lambda fit, df, off=off: df.withColumn(
            "prediction", F.col("sales") + off))
        got = registry.q_tuned_store_metrics(spark, "").collect()
        assert {(r.store, r.n, r.scored) for r in got} == {(1, 2, beats), (2, 1, beats)}
    assert trials == [10, 10]
