"""M1-M5, M8 (with D10-D12): one pooled boosted-tree regressor on Spark ML.

The reference collects the feature matrix to the driver and trains LightGBM
there. Here the frame stays distributed: ``GBTRegressor`` builds each tree
from histogram aggregates computed on the executors, and scoring is a
``transform``. The fitted object is one ``PipelineModel`` (missing-value
fill, assembler, trees, label rescaling) that saves and loads as a unit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandcast.operators.metrics import FIT_FLOOR, score_metrics
from demandcast.session import ensure_checkpoint_dir
from demandcast.sources.sinks import check_signature

# The reference's boosting parameters (LightGBM names).
REFERENCE_FIXED = {
    "objective": "regression_l1",
    "bagging_fraction": 0.8,
    "bagging_freq": 5,
    "lambda_l1": 3.097758978478437,
    "lambda_l2": 2.9482537987198496,
    "min_child_weight": 6.996211413900573,
    "min_split_gain": 0.037310344962162616,
}
# Used when no searched values are given.
REFERENCE_DEFAULTS = {"learning_rate": 0.1, "max_depth": 3, "num_leaves": 7}
# The deepest level-wise tree Spark can grow.
DEEPEST = 30
# Boosting parameters that Spark's trees have no counterpart for; accepted, without effect.
WITHOUT_COUNTERPART = ("bagging_freq", "lambda_l1", "lambda_l2")
# Rounds and patience of the three fits: training, retraining, a search trial.
TRAIN_ROUNDS, RETRAIN_ROUNDS, TRIAL_ROUNDS, PATIENCE = 5000, 3000, 2000, 50
# Filled into a missing feature; the x_missing flag carries the information.
MISSING_FILL = -1.0

LABEL_COL = "__label"
SCALED_PRED = "__scaled_prediction"
FEATURES_VEC = "__features"


def model_parameters(search_params: dict | None = None) -> dict:
    """M2: fixed values, then defaults or the searched values on top."""
    params = dict(REFERENCE_FIXED)
    params.update(search_params if search_params else REFERENCE_DEFAULTS)
    return params


def gbt_settings(params: dict, max_iter: int, seed: int = 42) -> dict:
    """Map LightGBM-style parameters to ``GBTRegressor``.

    ``num_leaves`` has no Spark counterpart (trees grow level-wise): it caps
    the depth at ceil(log2(num_leaves)). ``bagging_freq`` and the L1/L2 leaf
    penalties have none either and change nothing; other unknown names raise.
    """
    known = {*REFERENCE_FIXED, *REFERENCE_DEFAULTS, "lr", "feature_fraction"}
    if unknown := sorted(set(params) - known):
        raise ValueError(f"unknown boosting parameters: {unknown}")
    depth = int(params.get("max_depth", 3))
    leaves = params.get("num_leaves")
    if leaves:
        depth = min(depth, max(1, math.ceil(math.log2(int(leaves)))))
    if depth > DEEPEST:
        raise ValueError(f"trees of depth {depth} asked for; the deepest is {DEEPEST}")
    loss = "absolute" if params.get("objective", "regression_l1") in (
        "regression_l1", "l1", "mae", "absolute") else "squared"
    settings = {
        "lossType": loss,
        "stepSize": float(params.get("learning_rate", params.get("lr", 0.1))),
        "maxDepth": depth,
        "minInfoGain": float(params.get("min_split_gain", 0.0)),
        "subsamplingRate": float(params.get("bagging_fraction", 1.0)),
        "minInstancesPerNode": max(1, int(round(params.get("min_child_weight", 1)))),
        "maxIter": int(max_iter),
        "seed": int(seed),
        "checkpointInterval": 10,
    }
    if params.get("feature_fraction") is not None:
        settings["featureSubsetStrategy"] = str(float(params["feature_fraction"]))
    return settings


def missing_flag_columns(df: DataFrame, features) -> list[str]:
    """Features that may be null in ``df`` (windows at series edges, lookups)."""
    fields = {f.name: f for f in df.schema.fields}
    fixed = {"store", "item", "month", "day", "year", "week_of_year", "day_of_week",
             "is_weekend", "is_month_start", "is_month_end", "public_holiday"}
    return [c for c in features if fields[c].nullable and c not in fixed]


def _prep_statement(features, flagged) -> str:
    """Spark trees refuse NaN/null, so fill and add a 0/1 ``x_missing`` flag."""
    cols = [f"CAST(coalesce(CAST(`{c}` AS DOUBLE), {MISSING_FILL}) AS DOUBLE) AS `__f_{c}`"
            for c in features]
    cols += [f"CAST(`{c}` IS NULL AS DOUBLE) AS `__f_{c}_missing`" for c in flagged]
    return "SELECT *, " + ", ".join(cols) + " FROM __THIS__"


def assembler_inputs(features, flagged) -> list[str]:
    return [f"__f_{c}" for c in features] + [f"__f_{c}_missing" for c in flagged]


def input_names(model: PipelineModel) -> list[str]:
    """Model input names in vector order (``x`` and ``x_missing``)."""
    assembler = [s for s in model.stages if isinstance(s, VectorAssembler)][0]
    return [c[len("__f_"):] for c in assembler.getInputCols()]


@dataclass
class FitResult:
    model: PipelineModel
    features: list[str]
    label: str
    params: dict
    best_iteration: int
    valid_mape: float | None = None
    valid_rmse: float | None = None
    history: list[float] = field(default_factory=list)
    signature: StructType | None = None


def label_scale(train: DataFrame, label: str) -> float:
    """The label's mean absolute deviation (1 if constant), two aggregate jobs."""
    y = F.col(label).cast("double")
    mean = train.agg(F.avg(y)).first()[0]
    s = train.agg(F.avg(F.abs(y - F.lit(mean)))).first()[0]
    return float(s) if s and s > 0 else 1.0


def _pipeline(features, flagged, settings: dict, scale: float) -> Pipeline:
    return Pipeline(stages=[
        SQLTransformer(statement=_prep_statement(features, flagged)),
        VectorAssembler(inputCols=assembler_inputs(features, flagged),
                        outputCol=FEATURES_VEC, handleInvalid="error"),
        GBTRegressor(featuresCol=FEATURES_VEC, labelCol=LABEL_COL,
                     predictionCol=SCALED_PRED, **settings),
        SQLTransformer(statement=f"SELECT *, `{SCALED_PRED}` * {scale!r} AS prediction "
                                 "FROM __THIS__"),
    ])


def best_iteration(history: list[float], patience: int) -> int:
    """1-based round with the lowest loss, stopping ``patience`` rounds after it."""
    best, best_i = math.inf, 0
    for i, loss in enumerate(history):
        if loss < best:
            best, best_i = loss, i
        elif i - best_i >= patience:
            break
    return best_i + 1


def _first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model after its first ``n`` rounds."""
    java = model._java_obj
    gateway = SparkContext._active_spark_context._gateway
    tree = gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees = gateway.new_array(tree, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (t, w) in enumerate(zip(java.trees()[:n], java.treeWeights()[:n])):
        trees[i], weights[i] = t, w
    short = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(
        java.uid(), trees, weights, java.numFeatures())
    return GBTRegressionModel(java.copyValues(short, java.extractParamMap()))


def fit_forecaster(train: DataFrame, valid: DataFrame | None, features,
                   label: str = "sales", params: dict | None = None,
                   max_iter: int = TRAIN_ROUNDS, patience: int = PATIENCE, seed: int = 42,
                   scale_label: bool = True, score_valid: bool = True) -> FitResult:
    """M3: fit on ``train``; with ``valid``, stop early and report validation MAPE/RMSE.

    Early stopping: the rounds are fitted in budgets of twice the patience, then
    four times and so on, up to ``max_iter``; after each the loss of every
    prefix on ``valid`` is taken in one pass, and the first budget in which
    ``patience`` rounds bring no better loss is the last. A shorter fit with
    the same seed is a prefix of a longer one, so the best round's model is cut
    out of the fitted trees: the result is that of a fit of ``max_iter`` rounds,
    the work follows the round that stopped it. Without ``valid`` all rounds
    are fitted. The input keeps its partitions. Callers should checkpoint
    ``train``/``valid`` first: every round scans them.
    """
    ensure_checkpoint_dir(train.sparkSession)
    features = list(features)
    params = model_parameters(params)
    flagged = missing_flag_columns(train, features)
    scale = label_scale(train, label) if scale_label else 1.0
    labelled = train.withColumn(LABEL_COL, F.col(label).cast("double") / F.lit(scale))
    history: list[float] = []
    budget = min(max_iter, 2 * patience) if valid is not None else max_iter
    while True:
        settings = gbt_settings(params, budget, seed)
        model = _pipeline(features, flagged, settings, scale).fit(labelled)
        best = budget
        if valid is None:
            break
        v = valid.withColumn(LABEL_COL, F.col(label).cast("double") / F.lit(scale))
        prepped = PipelineModel(stages=model.stages[:2]).transform(v)
        history = list(model.stages[2].evaluateEachIteration(prepped, settings["lossType"]))
        best = best_iteration(history, patience)
        if budget - best >= patience or budget >= max_iter:
            break
        budget = min(max_iter, 2 * budget)
    if best < budget:
        stages = [*model.stages[:2], _first_trees(model.stages[2], best), *model.stages[3:]]
        model = PipelineModel(stages=stages)
    result = FitResult(model, features, label, params, best, history=history,
                       signature=train.select(*features).schema)
    if valid is not None and score_valid:
        m = score_metrics(predict(result, valid), label, "prediction",
                          floor=FIT_FLOOR).first()
        result.valid_mape, result.valid_rmse = m["mape"], m["rmse"]
    return result


def predict(fit: FitResult | PipelineModel, df: DataFrame) -> DataFrame:
    """M4: ``df`` with a ``prediction`` column (label units); nothing is collected.

    A :class:`FitResult` knows its inputs' types and checks them (S6).
    """
    model = fit.model if isinstance(fit, FitResult) else fit
    if isinstance(fit, FitResult):
        check_signature(df, fit.signature)
    out = model.transform(df)
    return out.select(*df.columns, "prediction")


def feature_importances(fit: FitResult | PipelineModel, k: int | None = 10) -> DataFrame:
    """Top-``k`` inputs by Spark's gain-based importance (one row per input)."""
    model = fit.model if isinstance(fit, FitResult) else fit
    trees = [s for s in model.stages if hasattr(s, "featureImportances")][0]
    names = input_names(model)
    imp = trees.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    rows = sorted(zip(names, imp), key=lambda r: (-r[1], r[0]))
    df = spark.createDataFrame(rows, "feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.limit(k) if k else df
