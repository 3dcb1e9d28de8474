"""M6, M7: hyperparameter search and the retrain with the winner.

The reference runs a sequential TPE search on the driver with LightGBM.
Here each trial is a distributed ``fit_forecaster`` on the same
checkpointed frames; trials are drawn from a seeded random sampler over the
reference's space and may run concurrently (``parallelism``), sharing the
cluster the way ``CrossValidator`` does.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame

from demandcast.plans.boosting import BoostedModel
from demandcast.plans.model import (PATIENCE, RETRAIN_ROUNDS, TRIAL_ROUNDS, FitResult,
                                   fit_forecaster)
from demandcast.sources.sinks import RunLog

# The reference's search space.
# uniform: (low, high); integer: inclusive (low, high)
SEARCH_SPACE = {
    "learning_rate": ("uniform", 0.1, 0.5),
    "max_depth": ("integer", 3, 19),
    "num_leaves": ("integer", 3, 19),
    "bagging_fraction": ("uniform", 0.8, 1.0),
    "feature_fraction": ("uniform", 0.8, 1.0),
}


def draw_trials(n: int, seed: int = 42, space=SEARCH_SPACE) -> list[dict]:
    """``n`` parameter sets from a seeded generator (same seed, same trials)."""
    rng = np.random.default_rng(seed)
    trials = []
    for _ in range(n):
        t = {}
        for name, (kind, lo, hi) in space.items():
            t[name] = (float(rng.uniform(lo, hi)) if kind == "uniform"
                       else int(rng.integers(lo, hi + 1)))
        trials.append(t)
    return trials


def random_search(train: DataFrame, valid: DataFrame, features, label: str = "sales",
                  n_trials: int = 10, seed: int = 42, max_iter: int = TRIAL_ROUNDS,
                  patience: int = PATIENCE, parallelism: int = 1,
                  run_log: RunLog | None = None, fit=fit_forecaster) -> tuple[DataFrame, dict]:
    """M6: one fit per trial; objective = validation MAPE (floor 1) + RMSE.

    ``fit`` is the trainer: :func:`~demandcast.plans.model.fit_forecaster` (Spark ML's
    trees) or :func:`~demandcast.plans.boosting.fit_boosted` (leaf-wise trees).
    Returns the trials as a DataFrame (one row per trial) and the best
    parameters. With ``run_log`` each trial's parameters and metrics are
    appended under its own run id.
    """
    trials = draw_trials(n_trials, seed)

    def run(i_params):
        i, params = i_params
        r = fit(train, valid, features, label, params, max_iter=max_iter, patience=patience, seed=seed)
        objective = r.valid_mape + r.valid_rmse
        return (i, params["learning_rate"], params["max_depth"], params["num_leaves"],
                params["bagging_fraction"], params["feature_fraction"],
                r.best_iteration, r.valid_mape, r.valid_rmse, objective)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(run, enumerate(trials)))
    if run_log is not None:  # written once, by this thread
        entries = []
        for row in rows:
            rid = RunLog.new_run_id()
            entries += [(rid, "param", {**trials[row[0]], "trial": row[0], "max_iter": max_iter}),
                        (rid, "metric", dict(zip(("best_iteration", "val_mape", "val_rmse",
                                                  "objective"), row[6:])))]
        run_log.log_all(entries)
    spark = train.sparkSession
    schema = ("trial int, learning_rate double, max_depth int, num_leaves int, "
              "bagging_fraction double, feature_fraction double, best_iteration int, "
              "val_mape double, val_rmse double, objective double")
    best = min(rows, key=lambda r: (r[-1], r[0]))
    return spark.createDataFrame(rows, schema), trials[best[0]]


def retrain_best(train: DataFrame, valid: DataFrame, features, best: dict,
                 label: str = "sales", max_iter: int = RETRAIN_ROUNDS,
                 patience: int = PATIENCE, seed: int = 42, fit=fit_forecaster) -> FitResult | BoostedModel:
    """M7: fit again with the winning parameters (score with *this* model, D13)."""
    return fit(train, valid, features, label, best, max_iter=max_iter, patience=patience, seed=seed)
