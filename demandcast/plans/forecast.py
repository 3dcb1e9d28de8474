"""The reference's three entry points as one call: panel -> features -> model -> report.

``forecast_report`` splits and featurises the panel, writes the feature frame
to the shared checkpoint folder, fits (and optionally tunes) the model, and
returns the hold-out metrics overall and per store. Only metric rows, model
metadata and trial rows reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.operators.metrics import metric_means, score_metrics
from demandcast.operators.split import TEST, TRAIN, VALIDATION
from demandcast.plans.features import feature_frame, feature_names
from demandcast.plans.model import (PATIENCE, TRAIN_ROUNDS, TRIAL_ROUNDS, FitResult,
                                   feature_importances, fit_forecaster, predict)
from demandcast.plans.search import random_search, retrain_best
from demandcast.session import checkpointed
from demandcast.sources.sinks import RunLog


@dataclass
class ForecastReport:
    fit: FitResult
    features: DataFrame          # the checkpointed, labelled feature frame
    test_predictions: DataFrame  # Test rows with ``prediction``
    test_metrics: DataFrame      # one row: mse, rmse, mape, mae, n
    store_metrics: DataFrame     # one row per store, sorted
    store_means: DataFrame       # NaN-skipping means of the per-store metrics
    importances: DataFrame       # top 10 inputs
    trials: DataFrame | None = None


def forecast_report(panel: DataFrame, max_iter: int = TRAIN_ROUNDS, patience: int = PATIENCE,
                    search_trials: int = 0, search_rounds: int = TRIAL_ROUNDS,
                    run_log: RunLog | None = None, **feature_options) -> ForecastReport:
    """Split, featurise, fit (tune if ``search_trials``), score the Test rows."""
    ff = checkpointed(feature_frame(panel, **feature_options))
    train, valid, test = (ff.filter(F.col("Dataset") == t) for t in (TRAIN, VALIDATION, TEST))
    names = feature_names(weather=feature_options.get("weather") is not None)
    trials = None
    if search_trials:
        trials, best = random_search(train, valid, names, n_trials=search_trials,
                                     max_iter=search_rounds, patience=patience,
                                     run_log=run_log)
        fit = retrain_best(train, valid, names, best, max_iter=max_iter, patience=patience)
    else:
        fit = fit_forecaster(train, valid, names, max_iter=max_iter, patience=patience)
    scored = predict(fit, test)
    per_store = score_metrics(scored, by="store")
    if run_log is not None:
        rid = RunLog.new_run_id()
        run_log.log_all([
            (rid, "param", {**fit.params, "max_iter": max_iter,
                            "best_iteration": fit.best_iteration}),
            (rid, "metric", {"val_mape": fit.valid_mape, "val_rmse": fit.valid_rmse})])
    return ForecastReport(fit=fit, features=ff, test_predictions=scored,
                          test_metrics=score_metrics(scored), store_metrics=per_store,
                          store_means=metric_means(per_store),
                          importances=feature_importances(fit, 10), trials=trials)
