"""Boosted trees (M1-M4, D10-D12) against brute force."""

import heapq
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandcast.plans import boosting as B
from demandcast.plans.model import fit_forecaster, predict
from demandcast.session import shared_path
from demandcast.sources.sinks import RunLog

PLAIN = {"bagging_fraction": 1.0, "bagging_freq": 0, "lambda_l1": 0.0, "lambda_l2": 0.0, "min_child_weight": 1e-3,
         "min_split_gain": 0.0, "min_data_in_leaf": 1, "learning_rate": 1.0, "max_depth": -1, "num_leaves": 8}
NAMES = ["a", "b", "c"]


def made(n=400, seed=1, missing=0.1):
    """(key, a, b, c, y): two numeric features with missing values, one of few values."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = None if rng.random() < missing else round(rng.uniform(-3, 3), 3)
        b = None if rng.random() < missing else float(rng.randint(0, 30))
        c = rng.randint(0, 3)
        y = (10 if a is None else 3 * a) + (b or 0) * (1 if c > 1 else -0.5) + rng.gauss(0, 1)
        rows.append((i, a, b, c, round(y, 3)))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "key int, a double, b double, c int, y double").repartition(parts)


def fitted(spark, rows, params=None, max_iter=3, parts=3, valid=None, **options):
    return B.fit_boosted(frame(spark, rows, parts), None if valid is None else frame(spark, valid), NAMES, "y",
                         {**PLAIN, **(params or {})}, max_iter=max_iter, row_key=["key"], **options)


# ------------------------------------------------------------------- brute force --

def gain_of(g, n, l1, l2):
    return max(abs(g) - l1, 0.0) ** 2 / (n + l2)


def brute_best(rows, grad, p):
    """Best (gain, feature, cut, missing_left) over raw values of the node's rows."""
    l1, l2 = p["lambda_l1"], p["lambda_l2"]
    least = max(p["min_child_weight"], p["min_data_in_leaf"], 1)
    total = sum(grad[r[0]] for r in rows)
    parent, best = gain_of(total, len(rows), l1, l2), None
    for j in range(3):
        for cut in sorted({r[1 + j] for r in rows if r[1 + j] is not None}):
            for missing_left in (False, True):
                left = [r for r in rows if (missing_left if r[1 + j] is None else r[1 + j] <= cut)]
                n = len(left)
                if n < least or len(rows) - n < least:
                    continue
                g = sum(grad[r[0]] for r in left)
                gain = gain_of(g, n, l1, l2) + gain_of(total - g, len(rows) - n, l1, l2) - parent
                if gain > p["min_split_gain"] + 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, cut, missing_left)
    return best


def brute_tree(rows, grad, p):
    """Leaves (lists of row keys) of best-first growth."""
    best = brute_best(rows, grad, p)
    queue, done, count = [], [], 1
    push = lambda at, part, b: heapq.heappush(queue, (-b[0], at, part, b)) if b else done.append(part)
    push(0, rows, best)
    at = 1
    while queue and count < p["num_leaves"]:
        _, _, part, (_, j, cut, missing_left) = heapq.heappop(queue)
        left = [r for r in part if (missing_left if r[1 + j] is None else r[1 + j] <= cut)]
        right = [r for r in part if r not in left]
        for child in (left, right):
            push(at, child, brute_best(child, grad, p))
            at += 1
        count += 1
    return [sorted(r[0] for r in part) for part in done + [q[2] for q in queue]]


def grouped(model, rows, tree=0):
    """The tree's leaves as sorted lists of row keys."""
    x = np.array([[math.nan if v is None else v for v in r[1:4]] for r in rows], float)
    one = B.Tree(**{**vars(model.trees[tree]), "value": list(range(len(model.trees[tree].feature)))})
    out = {}
    for r, leaf in zip(rows, B.tree_values(one, x)):
        out.setdefault(leaf, []).append(r[0])
    return sorted(sorted(v) for v in out.values())


@pytest.mark.parametrize("params", [
    {"objective": "regression"}, {"objective": "regression", "lambda_l1": 8.0, "lambda_l2": 5.0},
    {"objective": "regression", "num_leaves": 5, "min_data_in_leaf": 25},
    {"objective": "regression_l1", "num_leaves": 6, "min_child_weight": 7.0, "lambda_l1": 3.0, "lambda_l2": 2.9}])
def test_first_tree_equals_brute_force(spark, params):
    rows = made(150)
    model = fitted(spark, rows, params, max_iter=1)
    p = {**PLAIN, **params}
    ys = [r[4] for r in rows]
    if p["objective"] == "regression_l1":
        init = statistics.median(ys)
        grad = {r[0]: float(np.sign(init - r[4])) for r in rows}
    else:
        init = sum(ys) / len(ys)
        grad = {r[0]: init - r[4] for r in rows}
    assert model.init == pytest.approx(init, abs=1e-5)
    leaves = sorted(brute_tree(rows, grad, p))
    assert grouped(model, rows) == leaves and 3 < len(leaves) <= p["num_leaves"]
    by = {r[0]: r for r in rows}
    want = []
    for leaf in leaves:
        if p["objective"] == "regression_l1":
            want.append(statistics.median(by[k][4] - init for k in leaf))
        else:
            want.append(B.leaf_value(sum(grad[k] for k in leaf), len(leaf), p["lambda_l1"], p["lambda_l2"]))
    tree = model.trees[0]
    assert sorted(tree.value[i] for i in tree.leaves()) == pytest.approx(sorted(want), abs=2e-3)


def test_best_split_of_histograms_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(30):
        p = {**PLAIN, "lambda_l1": float(rng.uniform(0, 3)), "lambda_l2": float(rng.uniform(0, 3)),
             "min_data_in_leaf": int(rng.integers(1, 6))}
        cells = [rng.integers(0, 5, 40), rng.integers(0, 3, 40)]
        for c in cells:
            c[rng.random(40) < 0.2] = B.MISSING
        g = rng.integers(-5, 6, 40)
        hist = np.zeros((2, 256, 2), np.int64)
        for j, c in enumerate(cells):
            np.add.at(hist[j, :, 0], c, g)
            np.add.at(hist[j, :, 1], c, 1)
        rows = [(i, *(None if c[i] == B.MISSING else int(c[i]) for c in cells), None, 0) for i in range(40)]
        want = brute_best(rows, dict(enumerate(g.tolist())), p)
        got = B.best_split(hist, 1.0, p)
        assert (got is None) == (want is None)
        if want:
            assert got.gain == pytest.approx(want[0])


# -------------------------------------------------------------------- parameters --

def test_num_leaves_and_depth(spark):
    rows = made(600)
    for leaves in (2, 7, 13):
        model = fitted(spark, rows, {"objective": "regression", "num_leaves": leaves}, max_iter=2)
        assert [len(t.leaves()) for t in model.trees] == [leaves] * 2
    shallow = fitted(spark, rows, {"objective": "regression", "num_leaves": 31, "max_depth": 2}, max_iter=1)
    assert len(shallow.trees[0].leaves()) == 4


def test_lambdas_shrink_leaves(spark):
    rows = made(300)
    size = []
    for l1, l2 in ((0, 0), (0, 20), (30, 0), (30, 200)):
        m = fitted(spark, rows, {"objective": "regression", "lambda_l1": float(l1), "lambda_l2": float(l2),
                                 "num_leaves": 2}, max_iter=1)
        size.append(max(abs(v) for v in m.trees[0].value))
    assert size[0] > size[1] > size[3] and size[0] > size[2] > size[3]


def test_unknown_parameters_raise():
    for bad in ({"leafs": 3}, {"objective": "poisson"}, {"max_bin": 300}, {"bagging_fraction": 0.0}):
        with pytest.raises(ValueError):
            B.boosting_settings({**PLAIN, **bad})
    p = B.boosting_settings(None)
    assert p["lambda_l1"] == 3.097758978478437 and p["bagging_freq"] == 5 and p["num_leaves"] == 7


def test_missing_is_not_minus_one(spark):
    rows = [(i, None if i % 3 == 0 else -1.0 if i % 3 == 1 else 5.0, 0.0, 0, [10.0, 20.0, 20.0][i % 3])
            for i in range(90)]
    model = fitted(spark, rows, {"objective": "regression", "num_leaves": 3}, max_iter=1)
    assert "a_missing" not in model.features
    got = {r.a: r.prediction for r in B.predict_boosted(model, frame(spark, rows)).collect()}
    assert got[None] == pytest.approx(10, abs=1e-4) and got[-1.0] == pytest.approx(20, abs=1e-4)
    # NaN is missing too, and the learned side takes values never seen missing in training
    nan = spark.createDataFrame([(1, math.nan, 0.0, 0, 1.0)], "key int, a double, b double, c int, y double")
    assert B.predict_boosted(model, nan).first().prediction == pytest.approx(10, abs=1e-4)


# ----------------------------------------------------------------- bags, partitions --

def test_bags_follow_keys_and_epochs():
    key = np.arange(20_000, dtype=np.int64) * 977
    bags = [B.in_bag(key, 42, e, 0.8) for e in range(3)]
    assert all(abs(b.mean() - 0.8) < 0.02 for b in bags)
    assert abs((bags[0] & bags[1]).mean() - 0.64) < 0.02
    assert (B.in_bag(key[::-1].copy(), 42, 1, 0.8)[::-1] == bags[1]).all()


@pytest.mark.parametrize("objective", ["regression_l1", "regression"])
def test_same_model_for_any_partitions(spark, objective):
    rows = made(500)
    params = {"objective": objective, "bagging_fraction": 0.8, "bagging_freq": 5, "feature_fraction": 0.7,
              "learning_rate": 0.3, "num_leaves": 6}
    models = [fitted(spark, rows, params, max_iter=7, parts=n, valid=made(100, 9)) for n in (2, 16)]
    assert models[0].init == models[1].init and models[0].history == models[1].history
    assert models[0].trees == models[1].trees and len(models[0].history) == 7
    # another bag from round 5 on, another seed another model
    other = fitted(spark, rows, params, max_iter=7, seed=7)
    assert other.trees != models[0].trees


# --------------------------------------------------------------- stopping, resuming --

def test_stop_rule_names_the_first_metric_that_ran_out():
    stop = B._Stop(2)
    got = [stop.add(i + 1, s) for i, s in enumerate([(3, 3), (2, 4), (1, 5), (1.5, 1), (1.2, 6)])]
    assert got == [None, None, 1, None, 3]  # RMSE ran out at round 3, MAPE at round 5


def test_early_stop_keeps_the_best_round(spark):
    rows, held = made(300), made(150, 5)
    rounds = []
    model = fitted(spark, rows, {"num_leaves": 16, "learning_rate": 0.8}, max_iter=200, valid=held, patience=4,
                   on_round=lambda r, s: rounds.append(r))
    assert rounds == list(range(1, len(model.history) + 1)) and len(rounds) < 200  # no round twice
    assert len(model.trees) == model.best_iteration == len(model.history) - 4
    assert (model.valid_mape, model.valid_rmse) == model.history[model.best_iteration - 1]
    scored = B.predict_boosted(model, frame(spark, held)).toPandas()
    err = scored.prediction - scored.y
    assert model.valid_rmse == pytest.approx(math.sqrt((err**2).mean()), rel=1e-4)
    assert model.valid_mape == pytest.approx((err.abs() / scored.y.abs().clip(lower=1)).mean(), rel=1e-4)


def test_killed_fit_resumes_to_the_same_model(spark):
    rows, held = made(300), made(100, 5)
    params = {"learning_rate": 0.2, "bagging_fraction": 0.8, "bagging_freq": 5}
    whole = fitted(spark, rows, params, max_iter=14, valid=held, every=3)
    folder = shared_path(spark, f"test-boosting/{RunLog.new_run_id()}")

    class Killed(Exception):
        pass

    def kill(at):
        def on_round(r, scores):
            if r == at:
                raise Killed
        return on_round

    for at in (5, 8, 11):
        with pytest.raises(Killed):
            fitted(spark, rows, params, max_iter=14, valid=held, every=3, folder=folder, on_round=kill(at))
    seen = []
    model = fitted(spark, rows, params, max_iter=14, valid=held, every=3, folder=folder,
                   on_round=lambda r, s: seen.append(r))
    assert min(seen) >= 9  # rounds up to the last written state are not fitted again
    assert model.trees == whole.trees and model.history == whole.history


# ------------------------------------------------------------------ L1 leaf medians --

def test_medians_beat_gradient_steps_on_a_skewed_label(spark):
    """At equal rounds and depth, medians as leaf values beat Spark's trees for the L1 loss."""
    rng = random.Random(3)
    rows = [(i, rng.uniform(0, 1), float(rng.randint(0, 9)), i % 4, 0.0) for i in range(1500)]
    rows = [(i, a, b, c, round(math.exp(2 * a + 0.3 * b + rng.gauss(0, 0.4)), 4)) for i, a, b, c, _ in rows]
    data = frame(spark, rows)
    params = {"learning_rate": 0.1, "max_depth": 3, "num_leaves": 8, "bagging_fraction": 1.0, "min_child_weight": 7}
    ours = B.fit_boosted(data, None, NAMES, "y", {**params, "min_data_in_leaf": 7}, max_iter=20, row_key=["key"])
    theirs = fit_forecaster(data, None, NAMES, "y", params, max_iter=20)
    mae = lambda scored: scored.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert mae(B.predict_boosted(ours, data)) < 0.95 * mae(predict(theirs, data))


def test_sketch_medians_and_edges(spark):
    rng = random.Random(8)
    values = [(g, rng.choice([rng.gauss(0, 100), float(rng.randint(-3, 3)), -0.0])) for g in range(4) for _ in range(301 + g)]
    s = B.Sketch()
    for g, v in values:
        s.add(np.array([g]), np.array([v]))
    got = B.medians(spark.createDataFrame([r for b in s.batches() for r in b.to_pylist()], B.SKETCH_SCHEMA))
    for g in range(4):
        want = statistics.median(v for h, v in values if h == g)
        assert got[g] == pytest.approx(want, rel=2**-11, abs=1e-12)
    rows = spark.createDataFrame([([float(i), float(i % 3), None],) for i in range(1000)], "x array<double>")
    edges = B.bin_edges(rows, 3, 10)
    assert edges[1] == [0.5, 1.5] and edges[2] == [] and len(edges[0]) == 9
    sizes = np.diff(np.searchsorted(edges[0], np.arange(1000.0)).tolist())
    assert sizes.max() <= 1 and max(np.bincount(np.searchsorted(edges[0], np.arange(1000.0)))) <= 101


# -------------------------------------------------------------- saving, importances --

def test_save_load_and_importances(spark):
    rows = made(300)
    model = fitted(spark, rows, {"num_leaves": 5, "learning_rate": 0.3}, max_iter=4, valid=made(80, 4))
    path = shared_path(spark, f"test-models/{RunLog.new_run_id()}")
    B.save_boosted(model, spark, path)
    loaded = B.load_boosted(spark, path)
    assert loaded == model
    data = frame(spark, rows)
    a = B.predict_boosted(model, data).select("key", "prediction")
    b = B.predict_boosted(loaded, data).select("key", F.col("prediction").alias("again"))
    assert a.join(b, "key").filter("prediction = again").count() == len(rows)
    counts = {}
    for t in model.trees:
        for f in t.feature:
            if f >= 0:
                counts[NAMES[f]] = counts.get(NAMES[f], 0) + 1
    got = [(r.feature, r.splits) for r in B.split_importances(spark.read.parquet(f"{path}/nodes")).collect()]
    assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    with pytest.raises(ValueError):
        B.predict_boosted(loaded, data.drop("b"))


def test_importances_of_a_hand_made_tree(spark):
    tree = B.Tree([0, 2, -1, -1, 0, -1, -1], [0] * 7, [1.0, 2.0, 0.0, 0.0, 3.0, 0.0, 0.0], [False] * 7, [1, 2, 0, 0, 5, 0, 0],
                  [4, 3, 0, 0, 6, 0, 0], [0.0, 0.0, 1.0, 2.0, 0.0, 3.0, 4.0], [9.0, 4.0, 0.0, 0.0, 1.0, 0.0, 0.0],
                  [8, 4, 2, 2, 4, 2, 2])
    model = B.BoostedModel(NAMES, "y", 0.0, [tree], {}, 1)
    got = B.split_importances(B.node_table(spark, model)).collect()
    assert [(r.feature, r.splits, r.gain) for r in got] == [("a", 2, 10.0), ("c", 1, 4.0)]


def test_edge_frames(spark):
    with pytest.raises(ValueError, match="no labelled"):
        fitted(spark, [(1, 1.0, 1.0, 1, None)])
    one = fitted(spark, [(1, 1.0, 1.0, 1, 4.0), (2, None, None, 1, None)], max_iter=3, valid=[(1, 1.0, 1.0, 1, None)])
    assert one.trees == [] and one.init == 4.0
    assert [r.prediction for r in B.predict_boosted(one, frame(spark, [(1, None, None, 1, 1.0)])).collect()] == [4.0]
    assert B.predict_boosted(one, frame(spark, [])).count() == 0
