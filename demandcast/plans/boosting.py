"""M1-M4 (with D10-D12): boosted regression trees grown best leaf first, as Spark jobs.

What the reference's trainer does and Spark ML's trees do not: leaf-wise growth to
``num_leaves``, L1 and L2 leaf penalties, leaf medians for the L1 loss, a bag redrawn
every ``bagging_freq`` rounds, missing values with a learned side, and a stop on
validation MAPE and RMSE.

Rows are binned once and written as blocks (one byte a feature, the label, a hash of the
row's key, the running prediction). A boosting round is a few passes over the blocks:

- every wanted tree node gets a histogram per feature. Tasks add up their own rows,
  Spark adds up the tasks, the driver sees ``nodes x features x bins`` sums;
- the driver keeps the open leaves in a queue by gain and splits the best one. Leaves
  next in the queue have their children counted in the same pass, so a round costs at
  most one pass per tree level, and the order of splits is still best first. Only the
  left child is counted, the right one is the difference;
- the leaf values are medians (L1) of merged quantile sketches keyed by leaf, or closed
  form (L2); every later pass adds the new trees to the stored predictions.

The first pass of a round also scores the validation blocks, so early stopping costs no
job, no round is fitted twice, and the loop ends ``patience`` rounds after the best one.
Every ``every`` rounds the predictions are written back and the trees beside them, into
two folders in turn: a lost executor reads stored blocks, a killed fit resumes.

Everything that tasks add up is a whole number (gradients are rounded to fixed steps),
bags are drawn from a hash of the row's key, and bin edges come from a sketch that does
not depend on the order of rows: the same rows in any number of partitions give the same
model.

Defined cases: rows without a label are left out; a missing feature (null or NaN) has a
bin of its own; rows that share a key share a bag; without a split that pays the fit
ends; an empty training frame raises; an empty validation frame counts as none.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandcast.operators.metrics import FIT_FLOOR
from demandcast.plans.model import (PATIENCE, REFERENCE_DEFAULTS, REFERENCE_FIXED, TRAIN_ROUNDS,
                                   model_parameters)
from demandcast.session import ensure_checkpoint_dir, shared_path
from demandcast.sources.sinks import check_signature

#: Value bins of a feature, and the code of a missing value.
MAX_BINS, MISSING = 255, 255
#: Mantissa bits that a sketch keeps: values closer than 1 in 4,096 share a sketch cell.
SKETCH_BITS = 12
#: Rows that a task holds at least, when the input has more partitions than that.
TASK_ROWS = 50_000
#: Sketch cells that a task keeps before it adds equal ones up.
SKETCH_ROWS = 1_000_000
#: Bits of the steps that a gradient of the label's scale is rounded to, and bits that
#: the sum over all rows may have (more rows, coarser steps).
STEP_BITS, SUM_BITS = 34, 60
#: Reducers that add up a pass's histograms and sketches.
PASS_REDUCERS = 4
TRAIN_ROLE, VALID_ROLE = 0, 1
ABSOLUTE = ("regression_l1", "l1", "mae", "absolute")
SQUARED = ("regression", "regression_l2", "l2", "mse", "squared")
# Further defaults of the reference's trainer.
MORE_DEFAULTS = {"feature_fraction": 1.0, "min_data_in_leaf": 20, "max_bin": MAX_BINS}
_BLOCKS = "role int, n int, codes binary, y binary, key binary, f binary"


@dataclass
class Tree:
    """Nodes as parallel lists; node 0 is the root, ``feature`` -1 marks a leaf."""

    feature: list[int]
    bin: list[int]
    threshold: list[float]
    missing_left: list[bool]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]
    count: list[int]

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]


@dataclass
class BoostedModel:
    features: list[str]
    label: str
    init: float
    trees: list[Tree]
    params: dict
    best_iteration: int
    valid_mape: float | None = None
    valid_rmse: float | None = None
    history: list[tuple[float, float]] = field(default_factory=list)
    signature: StructType | None = None


# ------------------------------------------------------------------ parameters --

def boosting_settings(params: dict | None) -> dict:
    """M2: the reference's parameters, all of them in effect; unknown names raise."""
    p = {**MORE_DEFAULTS, **model_parameters(params)}
    if "lr" in p:
        p["learning_rate"] = p.pop("lr")
    known = {*REFERENCE_FIXED, *REFERENCE_DEFAULTS, *MORE_DEFAULTS}
    if unknown := sorted(set(p) - known):
        raise ValueError(f"unknown boosting parameters: {unknown}")
    if p["objective"] not in ABSOLUTE + SQUARED:
        raise ValueError(f"unknown objective: {p['objective']}")
    p.setdefault("max_depth", -1)
    p.setdefault("num_leaves", 31)
    p.setdefault("learning_rate", 0.1)
    if not 2 <= int(p["max_bin"]) <= MAX_BINS:
        raise ValueError(f"max_bin must be in 2..{MAX_BINS}")
    if not (0 < p["bagging_fraction"] <= 1 and 0 < p["feature_fraction"] <= 1):
        raise ValueError("fractions must be in (0, 1]")
    return p


# -------------------------------------------------------------- quantile sketch --

def sketch_keys(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order, close ones alike."""
    bits = np.ascontiguousarray(values, np.float64).view(np.int64)
    size = bits & np.int64(0x7FFF_FFFF_FFFF_FFFF)
    return np.where(bits < 0, -size, size) >> np.int64(52 - SKETCH_BITS)


class Sketch:
    """Counts, least and greatest value per (group, key); equal however rows are dealt."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, group: np.ndarray, values: np.ndarray) -> None:
        if len(values):
            values = values.astype(np.float64, copy=False)
            self._keep((group.astype(np.int32), sketch_keys(values), np.ones(len(values), np.int64),
                        values, values))
            if self.rows > SKETCH_ROWS:
                self._merge()

    def _keep(self, part) -> None:
        group, key, n, lo, hi = part
        order = np.lexsort((key, group))
        group, key, n, lo, hi = (v[order] for v in part)
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        reduced = (group[first], key[first], np.add.reduceat(n, first),
                   np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first))
        self.parts.append(reduced)
        self.rows += len(first)

    def _merge(self) -> None:
        whole = tuple(np.concatenate(v) for v in zip(*self.parts))
        self.parts, self.rows = [], 0
        self._keep(whole)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in self.parts[0]],
                                             names=["group", "key", "n", "lo", "hi"])


SKETCH_SCHEMA = "group int, key long, n long, lo double, hi double"


def merged(sketches: DataFrame) -> DataFrame:
    """The tasks' sketches added up: a row per group and key."""
    return sketches.groupBy("group", "key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"),
                                                F.max("hi").alias("hi"))


def medians(sketches: DataFrame) -> dict[int, float]:
    """The median per group, of cells that stand for their rows by their middle."""
    middle = (F.col("lo") + F.col("hi")) / 2
    found = merged(sketches).groupBy("group").agg(F.percentile(middle, 0.5, F.col("n")).alias("median")).collect()
    return {r["group"]: r["median"] for r in found}  # a row per leaf


def bin_edges(rows: DataFrame, n_features: int, max_bin: int = MAX_BINS) -> list[list[float]]:
    """Upper edges of every feature's value bins, from a sketch of all rows.

    A feature of at most ``max_bin`` sketch cells gets a bin for each, others bins of
    about equal row counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for batch in batches:
            x = _matrix(batch.column(0), n_features)
            at, column = np.nonzero(~np.isnan(x))
            sketch.add(column, x[at, column])
        yield from sketch.batches()

    line = Window.partitionBy("group").orderBy("key")
    cells = merged(rows.select("x").mapInArrow(run, SKETCH_SCHEMA)).select(
        "*", F.sum("n").over(line).alias("upto"), F.lead("lo").over(line).alias("next"),
        F.count("*").over(Window.partitionBy("group")).alias("cells"),
        F.sum("n").over(Window.partitionBy("group")).alias("total"))
    step = lambda c: F.floor(c * max_bin / F.col("total"))
    cut = (F.col("cells") <= max_bin) | (step(F.col("upto")) > step(F.col("upto") - F.col("n")))
    found = (cells.filter(cut & F.col("next").isNotNull())
             .select("group", ((F.col("hi") + F.col("next")) / 2).alias("edge")).toArrow())
    edges: list[list[float]] = [[] for _ in range(n_features)]
    for group, edge in zip(found.column("group").to_pylist(), found.column("edge").to_pylist()):
        edges[group].append(edge)
    return [sorted(e) for e in edges]


# ----------------------------------------------------------------------- blocks --

def _matrix(column: pa.Array, n_features: int) -> np.ndarray:
    """A list column of doubles as rows x features; nulls become NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_features)


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin codes, features x rows."""
    out = np.empty(x.shape[::-1], np.uint8)
    for j, e in enumerate(edges):
        v = x[:, j]
        out[j] = np.where(np.isnan(v), MISSING, np.searchsorted(e, v, side="left"))
    return out


def numeric_rows(df: DataFrame, features: list[str], label: str, row_key: list[str] | None) -> DataFrame:
    """``x, y, key``: features and label as doubles, a hash of the row's key columns."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    return df.filter(F.col(label).isNotNull()).select(
        x.alias("x"), F.col(label).cast("double").alias("y"),
        F.xxhash64(*[F.col(c) for c in (row_key or df.columns)]).alias("key"))


def to_blocks(rows: DataFrame, edges: list[list[float]], role: int) -> DataFrame:
    """One row per Arrow batch: codes, labels, keys and predictions (0) as bytes."""
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = _matrix(batch.column(0), len(cuts))
                y = batch.column(1).to_numpy(zero_copy_only=False)
                key = batch.column(2).to_numpy(zero_copy_only=False)
                yield _block(role, _codes(x, cuts), y, key, np.zeros(n))

    return rows.mapInArrow(run, _BLOCKS)


def _block(role: int, codes, y, key, f) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"role": pa.array([role], pa.int32()), "n": pa.array([len(y)], pa.int32()),
         **{name: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())
            for name, v in (("codes", codes), ("y", y), ("key", key), ("f", f))}})


def _read_blocks(batches: Iterator[pa.RecordBatch]):
    """role, codes (features x rows), y, key, f of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            raw = {c: batch.column(c)[i].as_buffer() for c in ("codes", "y", "key", "f")}
            yield (batch.column("role")[i].as_py(), np.frombuffer(raw["codes"], np.uint8).reshape(-1, n),
                   np.frombuffer(raw["y"], np.float64), np.frombuffer(raw["key"], np.int64),
                   np.frombuffer(raw["f"], np.float64))


# ------------------------------------------------------------------- row helpers --

def assign(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """The tree node every row ends in."""
    feature, cut = np.array(tree.feature), np.array(tree.bin)
    missing_left, left, right = np.array(tree.missing_left), np.array(tree.left), np.array(tree.right)
    node = np.zeros(codes.shape[1], np.int64)
    rows = np.arange(codes.shape[1])
    while len(rows := rows[feature[node[rows]] >= 0]):
        at = node[rows]
        code = codes[feature[at], rows]
        go_left = np.where(code == MISSING, missing_left[at], code <= cut[at])
        node[rows] = np.where(go_left, left[at], right[at])
    return node


def in_bag(key: np.ndarray, seed: int, epoch: int, fraction: float) -> np.ndarray:
    """Rows of the bag of an epoch: a hash of the row's key, whatever partition it is in."""
    if fraction >= 1:
        return np.ones(len(key), bool)
    z = key.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + epoch * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53 < fraction


def _updated(f: np.ndarray, codes: np.ndarray, trees: list[Tree], role: int, init: float | None = None):
    f = f if init is None else f + init
    for tree in trees:
        f = f + np.array(tree.value)[assign(tree, codes)]
    return f


# -------------------------------------------------------------------- histograms --

@dataclass
class _Pass:
    """What a pass over the blocks needs to know: the state's trees and the bag."""

    init: float
    trees: list[Tree]          # trees that the stored predictions lack
    absolute: bool
    scale: float               # the label's scale, a power of two
    steps: float               # gradients are rounded to scale / steps
    seed: int
    epoch: int
    fraction: float

    def gradients(self, f: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = f - y
        return np.sign(d) if self.absolute else np.rint(d / self.scale * self.steps)


def _score(f: np.ndarray, y: np.ndarray, what: _Pass) -> list[int]:
    """Absolute share and squared error in units of the label's scale, summed as steps."""
    ape = np.abs(f - y) / np.maximum(np.abs(y), FIT_FLOOR) / what.scale
    return [int(np.rint(v * what.steps).astype(np.int64).sum()) for v in (ape, ((f - y) / what.scale) ** 2)]


def histograms(state: DataFrame, what: _Pass, tree: Tree, nodes: list[int], columns: list[int],
               score: bool = False) -> tuple[dict[int, np.ndarray], tuple[float, float] | None]:
    """Per wanted node an array ``features x 256 x (gradient steps, rows)``; with
    ``score`` also MAPE and RMSE of the validation rows under the present trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {w: np.zeros((len(columns), 256, 2), np.int64) for w in nodes}
        scored = np.zeros((2, 2), np.int64)
        for role, codes, y, key, f in _read_blocks(batches):
            f = _updated(f, codes, what.trees, role, what.init)
            if role == VALID_ROLE:
                if score:
                    scored += np.array([[v, len(y)] for v in _score(f, y, what)], np.int64)
                continue
            node, g = assign(tree, codes), what.gradients(f, y)
            bag = in_bag(key, what.seed, what.epoch, what.fraction)
            for w in nodes:
                rows = np.flatnonzero(bag & (node == w))
                part, weight = codes[:, rows], g[rows]
                for at, j in enumerate(columns):
                    sums[w][at, :, 0] += np.bincount(part[j], weight, 256).astype(np.int64)
                    sums[w][at, :, 1] += np.bincount(part[j], minlength=256)
        if score:
            sums[-1] = scored[:, None, :]
        for w, total in sums.items():
            at, cell = np.nonzero(total[:, :, 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), w, np.int32)), pa.array(at.astype(np.int32)),
                 pa.array(cell.astype(np.int32)), pa.array(total[at, cell, 0]), pa.array(total[at, cell, 1])],
                names=["node", "feature", "cell", "g", "n"])

    source = state if score else state.filter(F.col("role") == TRAIN_ROLE)
    found = (source.mapInArrow(run, "node int, feature int, cell int, g long, n long")
             .groupBy("node", "feature", "cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow())
    node, feature, cell, g, n = (found.column(i).to_numpy() for i in range(5))
    out = {w: np.zeros((len(columns), 256, 2), np.int64) for w in nodes}
    for w in nodes:
        own = node == w
        out[w][feature[own], cell[own]] = np.stack([g[own], n[own]], axis=1)
    if not score or not (node == -1).any():
        return out, None
    by = {int(k): (int(a), int(b)) for k, a, b in zip(feature[node == -1], g[node == -1], n[node == -1])}
    mape = by[0][0] / what.steps / by[0][1] * what.scale
    return out, (mape, math.sqrt(by[1][0] / what.steps / by[1][1]) * what.scale)


# --------------------------------------------------------------------- best first --

@dataclass
class Split:
    gain: float
    column: int
    cell: int
    missing_left: bool
    left: np.ndarray   # gradient, rows
    right: np.ndarray


def leaf_gain(g, n, l1: float, l2: float):
    """Regularised gain of a leaf: soft-thresholded gradient squared over rows plus l2."""
    return np.maximum(np.abs(g) - l1, 0.0) ** 2 / np.maximum(n + l2, 1e-300)


def leaf_value(g: float, n: float, l1: float, l2: float) -> float:
    """Regularised step of a leaf against its gradient."""
    return -math.copysign(max(abs(g) - l1, 0.0), g) / (n + l2)


def best_split(hist: np.ndarray, unit: float, p: dict) -> Split | None:
    """The best of all cuts of all features, missing values on either side.

    Ties go to the first feature, the lowest cut, missing values right.
    """
    l1, l2 = float(p["lambda_l1"]), float(p["lambda_l2"])
    least = max(float(p["min_child_weight"]), float(p["min_data_in_leaf"]), 1.0)
    g, n = hist[:, :, 0] * unit, hist[:, :, 1].astype(float)
    whole_g, whole_n = g.sum(axis=1)[0], n.sum(axis=1)[0]
    below_g, below_n = np.cumsum(g[:, :MISSING], axis=1), np.cumsum(n[:, :MISSING], axis=1)
    parent = leaf_gain(whole_g, whole_n, l1, l2)
    best = None
    gains = []
    for missing_left in (False, True):
        left_g = below_g + (g[:, MISSING:] if missing_left else 0)
        left_n = below_n + (n[:, MISSING:] if missing_left else 0)
        right_g, right_n = whole_g - left_g, whole_n - left_n
        gain = leaf_gain(left_g, left_n, l1, l2) + leaf_gain(right_g, right_n, l1, l2) - parent
        ok = (left_n >= least) & (right_n >= least) & (n[:, :MISSING] > 0)
        gains.append((np.where(ok, gain, -np.inf), left_g, left_n, right_g, right_n))
    both = np.stack([x[0] for x in gains], axis=2)
    at = int(both.argmax())
    column, cell, side = np.unravel_index(at, both.shape)
    gain = float(both[column, cell, side])
    if gain > float(p["min_split_gain"]) and gain > 0:
        _, left_g, left_n, right_g, right_n = gains[side]
        best = Split(gain, int(column), int(cell), bool(side),
                     np.array([left_g[column, cell], left_n[column, cell]]),
                     np.array([right_g[column, cell], right_n[column, cell]]))
    return best


def _empty_tree() -> Tree:
    return Tree([-1], [0], [0.0], [False], [0], [0], [0.0], [0.0], [0])


def _add_split(tree: Tree, node: int, feature: int, cell: int, threshold: float, s: Split) -> tuple[int, int]:
    left = len(tree.feature)
    for part in (s.left, s.right):
        for name, v in (("feature", -1), ("bin", 0), ("threshold", 0.0), ("missing_left", False), ("left", 0),
                        ("right", 0), ("value", 0.0), ("gain", 0.0), ("count", int(part[1]))):
            getattr(tree, name).append(v)
    tree.feature[node], tree.bin[node], tree.threshold[node] = feature, cell, threshold
    tree.missing_left[node], tree.left[node], tree.right[node], tree.gain[node] = \
        s.missing_left, left, left + 1, s.gain
    return left, left + 1


def grow(state: DataFrame, what: _Pass, p: dict, columns: list[int], edges: list[list[float]],
         root: np.ndarray, unit: float) -> Tree:
    """One tree of at most ``num_leaves`` leaves, the best open leaf split first.

    ``ahead`` holds every split that may be taken, with its children counted; the tree
    gets a split when its leaf is the best of the queue.
    """
    leaves, depth = int(p["num_leaves"]), int(p["max_depth"])
    ahead, out = _empty_tree(), _empty_tree()
    ahead.count[0] = out.count[0] = int(root[0, :, 1].sum())
    splits: dict[int, Split | None] = {0: best_split(root, unit, p) if leaves > 1 and depth != 0 else None}
    level, hists, place = {0: 0}, {0: root}, {0: 0}   # place: node of `ahead` -> node of `out`
    queue = [(-splits[0].gain, 0)] if splits[0] else []
    taken = 1
    while queue and taken < leaves:
        node = queue[0][1]
        if ahead.feature[node] < 0:
            # one pass counts the children of every leaf that may still be split
            opened = sorted(queue)[:leaves - taken]
            opened = [x for _, x in opened if ahead.feature[x] < 0]
            wanted = {}
            for x in opened:
                s = splits[x]
                j = columns[s.column]
                threshold = edges[j][s.cell] if s.cell < len(edges[j]) else math.inf
                left, right = _add_split(ahead, x, j, s.cell, threshold, s)
                level[left] = level[right] = level[x] + 1
                if leaves - taken > 1 and (depth < 0 or level[left] < depth):
                    wanted[left] = (x, right)
                else:
                    splits[left] = splits[right] = None
            if wanted:
                found, _ = histograms(state, what, ahead, list(wanted), columns)
                for left, (x, right) in wanted.items():
                    hists[left], hists[right] = found[left], hists[x] - found[left]
                    splits[left], splits[right] = (best_split(hists[k], unit, p) for k in (left, right))
        heapq.heappop(queue)
        a, b = _add_split(out, place[node], ahead.feature[node], ahead.bin[node], ahead.threshold[node], splits[node])
        taken += 1
        for child, at in ((ahead.left[node], a), (ahead.right[node], b)):
            place[child] = at
            if splits[child]:
                heapq.heappush(queue, (-splits[child].gain, child))
    return out


def leaf_medians(state: DataFrame, what: _Pass, tree: Tree) -> dict[int, float]:
    """The median residual of the bag's rows in every leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for role, codes, y, key, f in _read_blocks(batches):
            f = _updated(f, codes, what.trees, role, what.init)
            bag = in_bag(key, what.seed, what.epoch, what.fraction)
            sketch.add(assign(tree, codes)[bag], (y - f)[bag])
        yield from sketch.batches()

    return medians(state.filter(F.col("role") == TRAIN_ROLE).mapInArrow(run, SKETCH_SCHEMA))


# --------------------------------------------------------------------------- fit --

class _Stop:
    """Ends ``patience`` rounds after a metric's best round; the first metric to do
    so names the best round."""

    def __init__(self, patience: int):
        self.patience = patience
        self.best = [(math.inf, 0), (math.inf, 0)]   # value and round of MAPE, RMSE

    def add(self, round_: int, scores: tuple[float, float]) -> int | None:
        for i, v in enumerate(scores):
            if v < self.best[i][0]:
                self.best[i] = (v, round_)
            elif round_ - self.best[i][1] >= self.patience:
                return self.best[i][1]
        return None


def _save_progress(spark, folder: str, slot: int, progress: dict) -> None:
    (spark.createDataFrame([(json.dumps(progress),)], "value string").coalesce(1)
     .write.mode("overwrite").text(f"{folder}/progress-{slot}"))


def _load_progress(spark, folder: str) -> tuple[int, dict] | None:
    """The slot and content of the latest saved progress."""
    found = []
    for slot in (0, 1):
        try:
            row = spark.read.text(f"{folder}/progress-{slot}").first()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if row is not None:
            found.append((slot, json.loads(row["value"])))
    return max(found, key=lambda x: x[1]["round"]) if found else None


def fit_boosted(train: DataFrame, valid: DataFrame | None, features, label: str = "sales",
                params: dict | None = None, max_iter: int = TRAIN_ROUNDS, patience: int = PATIENCE,
                seed: int = 42, row_key: list[str] | None = None, folder: str | None = None,
                every: int = 10, on_round=None) -> BoostedModel:
    """M3: fit on ``train``; with ``valid``, stop on its MAPE and RMSE.

    ``row_key`` names the columns that tell rows apart (default: all columns); they draw
    the bags. ``folder`` keeps the fit's state: a second call with the same arguments
    goes on from the last written round. ``on_round(round, scores)`` is called after
    every scored round. The model holds the trees up to the best round.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    features, p = list(features), boosting_settings(params)
    folder = folder or shared_path(spark, f"boosting/{uuid.uuid4().hex}")
    absolute = p["objective"] in ABSOLUTE
    saved = _load_progress(spark, folder)
    if saved is None:
        progress = _prepare(spark, train, valid, features, label, p, row_key, folder, absolute)
        slot = 0
        _save_progress(spark, folder, slot, progress)
    else:
        slot, progress = saved
    edges, init, scale = progress["edges"], progress["init"], progress["scale"]
    trees = [Tree(**t) for t in progress["trees"]]
    history = [tuple(h) for h in progress["history"]]
    stop, best = _Stop(patience), None
    for i, h in enumerate(history):
        best = stop.add(i + 1, h)
    passes = _pass_session(spark)
    state = passes.read.schema(_BLOCKS).parquet(f"{folder}/state-{slot}")
    written = len(trees)
    steps = progress["steps"]
    unit = 1.0 if absolute else scale / steps
    freq = max(1, int(p["bagging_freq"])) if p["bagging_freq"] else None
    while best is None:
        round_ = len(trees)
        what = _Pass(init if written == 0 else 0.0, trees[written:], absolute, scale, steps, seed,
                     round_ // freq if freq else 0, float(p["bagging_fraction"]) if freq else 1.0)
        columns = _drawn_columns(len(features), float(p["feature_fraction"]), seed, round_)
        last = round_ >= max_iter
        if last and not (progress["has_valid"] and round_ and len(history) < round_):
            break
        root, scores = histograms(state, what, _empty_tree(), [] if last else [0], columns,
                                  score=progress["has_valid"] and round_ > 0)
        if scores is not None and len(history) < round_:
            history.append(scores)
            if on_round:
                on_round(round_, scores)
            best = stop.add(round_, scores)
        if last or best is not None:
            break
        tree = grow(state, what, p, columns, edges, root[0], unit)
        if len(tree.feature) == 1:
            break  # no split pays
        rate = float(p["learning_rate"])
        if absolute:
            values = leaf_medians(state, what, tree)
        else:
            sums = _leaf_sums(state, what, tree)
            values = {leaf: leaf_value(g * unit, n, float(p["lambda_l1"]), float(p["lambda_l2"]))
                      for leaf, (g, n) in sums.items()}
        for leaf in tree.leaves():
            tree.value[leaf] = rate * values.get(leaf, 0.0)
        trees.append(tree)
        if len(trees) - written >= every:
            slot = 1 - slot
            moved = _rewritten(state, what.init, trees[written:])
            moved.write.mode("overwrite").parquet(f"{folder}/state-{slot}")
            state = passes.read.schema(_BLOCKS).parquet(f"{folder}/state-{slot}")
            written = len(trees)
            progress |= {"round": written, "trees": [asdict(t) for t in trees], "history": history}
            _save_progress(spark, folder, slot, progress)
    if best is None:
        best = stop.best[0][1] if history else len(trees)
    model = BoostedModel(features, label, init, trees[:best], p, best, history=history,
                         signature=train.select(*features).schema)
    if history and best:
        model.valid_mape, model.valid_rmse = history[best - 1]
    return model


def _pass_session(spark: SparkSession) -> SparkSession:
    """A session for the passes. What they shuffle is bounded by the tree, not by the rows,
    so a few reducers do and nothing is re-planned while it runs; a round is many short
    jobs, and planning is a good part of each."""
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", str(PASS_REDUCERS))
    return session


def _drawn_columns(n: int, fraction: float, seed: int, round_: int) -> list[int]:
    """The features a tree may use."""
    if fraction >= 1:
        return list(range(n))
    rng = np.random.default_rng([seed, round_])
    return sorted(rng.choice(n, max(1, round(n * fraction)), replace=False).tolist())


def _prepare(spark, train, valid, features, label, p, row_key, folder, absolute) -> dict:
    """Bin edges, start value and label scale of the training rows; both sets as blocks."""
    rows = numeric_rows(train, features, label, row_key)
    n, low, high = rows.agg(F.count("*"), F.min("y"), F.max("y")).first()
    if not n:
        raise ValueError("no labelled training rows")
    edges = bin_edges(rows, len(features), int(p["max_bin"]))
    parts = [_fewer(to_blocks(rows, edges, TRAIN_ROLE), n)]
    has_valid, n_valid = False, 0
    if valid is not None:
        held = numeric_rows(valid, features, label, row_key)
        n_valid = held.count()
        has_valid = n_valid > 0
        if has_valid:
            parts.append(_fewer(to_blocks(held, edges, VALID_ROLE), n_valid))
    blocks = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    blocks.write.mode("overwrite").parquet(f"{folder}/state-0")
    state = spark.read.schema(_BLOCKS).parquet(f"{folder}/state-0")
    scale = 2.0 ** math.ceil(math.log2(max(high - low, abs(high), abs(low)) or 1.0))
    steps = 2.0 ** min(STEP_BITS, SUM_BITS - math.ceil(math.log2(n + n_valid + 1)))
    what = _Pass(0.0, [], absolute, scale, steps, 0, 0, 1.0)
    if absolute:
        init = leaf_medians(state, what, _empty_tree())[0]
    else:
        g, rows_n = _leaf_sums(state, what, _empty_tree())[0]
        init = -g * (scale / steps) / rows_n
    return {"round": 0, "trees": [], "history": [], "edges": edges, "init": init, "scale": scale,
            "steps": steps, "has_valid": has_valid}


def _fewer(blocks: DataFrame, rows: int) -> DataFrame:
    """At most a partition per TASK_ROWS rows, and no more than there were."""
    return blocks.coalesce(max(1, math.ceil(rows / TASK_ROWS)))


def _leaf_sums(state: DataFrame, what: _Pass, tree: Tree) -> dict[int, tuple[int, int]]:
    """Gradient steps and rows of the bag in every leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(tree.feature)
        total = np.zeros((2, size), np.int64)
        for role, codes, y, key, f in _read_blocks(batches):
            f = _updated(f, codes, what.trees, role, what.init)
            bag = in_bag(key, what.seed, what.epoch, what.fraction)
            leaf = assign(tree, codes)[bag]
            total += np.stack([np.bincount(leaf, what.gradients(f, y)[bag], size).astype(np.int64),
                               np.bincount(leaf, minlength=size)])
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]),
                                          pa.array(total[1, at])], names=["leaf", "g", "n"])

    sums = (state.filter(F.col("role") == TRAIN_ROLE).mapInArrow(run, "leaf int, g long, n long")
            .groupBy("leaf").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).collect())
    return {r["leaf"]: (r["g"], r["n"]) for r in sums}


def _rewritten(state: DataFrame, init: float, trees: list[Tree]) -> DataFrame:
    """The blocks with the trees' values added to the stored predictions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for role, codes, y, key, f in _read_blocks(batches):
            yield _block(role, codes, y, key, _updated(f, codes, trees, role, init))

    return state.mapInArrow(run, _BLOCKS)


# ----------------------------------------------------------------------- predict --

def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The tree's value for rows of raw features (rows x features, NaN missing)."""
    feature, threshold = np.array(tree.feature), np.array(tree.threshold)
    missing_left, left, right = np.array(tree.missing_left), np.array(tree.left), np.array(tree.right)
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while len(rows := rows[feature[node[rows]] >= 0]):
        at = node[rows]
        v = x[rows, feature[at]]
        go_left = np.where(np.isnan(v), missing_left[at], v <= threshold[at])
        node[rows] = np.where(go_left, left[at], right[at])
    return np.array(tree.value)[node]


def predict_boosted(model: BoostedModel, df: DataFrame) -> DataFrame:
    """M4: ``df`` with a ``prediction`` column; input names and types are checked."""
    check_signature(df, model.signature)
    trees, init, width = model.trees, model.init, len(model.features)

    @F.pandas_udf("double")
    def score(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in rows:
            x = np.concatenate([np.empty(0), *part]).reshape(-1, width)
            out = np.full(len(x), init)
            for tree in trees:
                out = out + tree_values(tree, x)
            yield pd.Series(out)

    # NaN stands for null, so the batches are plain doubles
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in model.features])
    return df.select(*[c for c in df.columns if c != "prediction"], score(x).alias("prediction"))


# ------------------------------------------------------------- nodes, importances --

NODES = ("tree int, node int, feature string, threshold double, bin int, missing_left boolean, "
         "left int, right int, value double, gain double, rows long")


def node_table(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """The ensemble as a table, a row per node; leaves have no feature."""
    rows = [(t, i, model.features[tree.feature[i]] if tree.feature[i] >= 0 else None, tree.threshold[i],
             tree.bin[i], tree.missing_left[i], tree.left[i], tree.right[i], tree.value[i], tree.gain[i],
             tree.count[i]) for t, tree in enumerate(model.trees) for i in range(len(tree.feature))]
    return spark.createDataFrame(rows, NODES)


def split_importances(nodes: DataFrame, k: int | None = 10) -> DataFrame:
    """How often each feature splits (the reference plot's default), and its gain."""
    out = (nodes.filter("feature is not null").groupBy("feature")
           .agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
           .orderBy(F.col("splits").desc(), "feature"))
    return out.limit(k) if k else out


def save_boosted(model: BoostedModel, spark: SparkSession, path: str) -> None:
    """The node table as Parquet and the rest as one JSON line beside it."""
    node_table(spark, model).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = {"features": model.features, "label": model.label, "init": model.init, "params": model.params,
            "best_iteration": model.best_iteration, "valid_mape": model.valid_mape,
            "valid_rmse": model.valid_rmse, "history": model.history,
            "signature": model.signature.json() if model.signature else None}
    (spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1)
     .write.mode("overwrite").text(f"{path}/meta"))


def load_boosted(spark: SparkSession, path: str) -> BoostedModel:
    """A saved model; its predictions equal the saved one's."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    place = {name: i for i, name in enumerate(meta["features"])}
    trees: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/nodes").collect():  # the model, not data
        trees.setdefault(r["tree"], []).append(r)
    built = []
    for t in sorted(trees):
        nodes = sorted(trees[t], key=lambda r: r["node"])
        built.append(Tree([place[r["feature"]] if r["feature"] is not None else -1 for r in nodes],
                          *[[r[c] for r in nodes] for c in ("bin", "threshold", "missing_left", "left", "right",
                                                            "value", "gain", "rows")]))
    signature = StructType.fromJson(json.loads(meta["signature"])) if meta["signature"] else None
    return BoostedModel(meta["features"], meta["label"], meta["init"], built, meta["params"],
                        meta["best_iteration"], meta["valid_mape"], meta["valid_rmse"],
                        [tuple(h) for h in meta["history"]], signature)
