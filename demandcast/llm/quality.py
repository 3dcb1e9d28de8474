"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model whose
non-negative unbiased risk is minimised:
``prior * E_P[l(g, 1)] + max(0, E_U[l(g, 0)] - prior * E_P[l(g, 0)])``. No
negative label is used. The class prior is estimated from the two samples: the
least ratio of the unlabelled to the positive share above any score threshold
bounds the prior from above and is tight where high scores are pure.

Features are shares of character-class bigrams and a few text statistics, all
computed on whole texts on the executors. The fit uses a bounded sample (``rows``
positives and as many unlabelled rows, drawn by hash); only their feature vectors
reach the driver. Ids may repeat: what is drawn are rows, and at most ``2 * rows`` of
each sample are taken.

Defined cases: a null or empty text scores 0; without any positive every score
is 0; whole texts of any length count; repeated rows each give a row; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import bounded_broadcast, text_or_empty, with_fields

#: Positives, and unlabelled rows, that a fit may use.
ROWS = 20_000
#: Gradient steps, their size, and the weight penalty.
STEPS, RATE, PENALTY = 400, 0.05, 1e-4
#: Least number of positives above a threshold that may bound the prior.
SUPPORT = 0.05

# character classes of bytes: lower, upper, digit, blank, line end, sentence
# punctuation, other symbols, beyond ASCII
_CLASSES = 8
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[[9, 32]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"!?-()"]] = 5
_CLASS[128:] = 7
N_FEATURES = _CLASSES * _CLASSES + 6


def features(text: bytes) -> np.ndarray:
    """Feature vector of a UTF-8 text."""
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not text:
        return out
    classes = _CLASS[np.frombuffer(text, dtype=np.uint8)]
    pairs = np.bincount(classes[:-1] * np.uint8(_CLASSES) + classes[1:],
                        minlength=_CLASSES * _CLASSES)
    out[:_CLASSES * _CLASSES] = np.sqrt(pairs / len(text))
    words = text.split()
    lines = text.split(b"\n")
    n = max(1, len(words))
    out[-6:] = (np.log1p(len(text)), len(text) / n / 10, len(set(words)) / n,
                len(set(lines)) / len(lines), np.log1p(len(lines)), len(words) > 0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class QualityModel:
    """A logistic model over standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return _sigmoid(z @ self.weights[:-1] + self.weights[-1])


def _descend(gradient, size: int) -> np.ndarray:
    """Adam from zero for a fixed number of steps."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both samples."""
    cuts = np.quantile(positive, np.linspace(0, 1 - SUPPORT, 200))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    return float(np.clip((u / p).min(), 0.01, 0.99))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> QualityModel:
    """Minimise the non-negative unbiased risk of a logistic model."""
    centre, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3

    def design(x):
        z = np.clip((x - centre) / scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    xp, xu = design(positive), design(unlabelled)

    def apart(w):  # positives against unlabelled, for the prior
        return (xp.T @ (_sigmoid(xp @ w) - 1) / len(xp) + xu.T @ _sigmoid(xu @ w) / len(xu)
                + PENALTY * w)

    if prior is None:
        w = _descend(apart, xp.shape[1])
        prior = estimate_prior(xp @ w, xu @ w)

    def risk(w):
        gp, gu = xp @ w, xu @ w
        sp, su = _sigmoid(gp), _sigmoid(gu)
        as_positive = prior * (xp.T @ (sp - 1)) / len(xp)
        negative = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        # the negatives' risk: below zero it is over-fitted, and its step turned round
        value = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        return (as_positive + negative if value >= 0 else -negative) + PENALTY * w

    return QualityModel(centre, scale, _descend(risk, xp.shape[1]), prior)


def with_features(docs: DataFrame, *keep: Column) -> DataFrame:
    """``*keep, features`` of every whole text."""
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names),
                 pa.array([features(t) for t in texts], pa.list_(pa.float32()))],
                names=[*names, "features"])

    return rows.mapInArrow(run, with_fields(rows.schema.fields[:-1], "features array<float>"))


def _sampled(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """About ``most`` rows at most, drawn by hash of all columns."""
    total = rows.count()
    if total <= most:
        return rows
    share = F.pmod(F.xxhash64(*rows.columns, F.lit(salt)), F.lit(1_000_000))
    return rows.filter(share < int(1_000_000 * most / total))


def _matrix(docs: DataFrame, most: int) -> np.ndarray:
    """Feature vectors of the rows, ``most`` of them at the utmost: rows that agree in
    all columns are drawn together, so many equal ones could pass the draw."""
    found = with_features(docs, F.col("doc_id")).select("features").limit(most).toPandas()
    return np.array(found["features"].tolist(), dtype=np.float64).reshape(-1, N_FEATURES)


def fit_quality(docs: DataFrame, positives: DataFrame, rows: int = ROWS) -> QualityModel | None:
    """Fit on texts of trusted positives (``doc_id`` rows) and of unlabelled rows.

    Both samples come from ``docs``; unlabelled rows are any of them, whatever
    their label. The ids of the positives are drawn before they meet the texts,
    so at most about ``rows`` ids are broadcast. Returns None without positives.
    """
    texts = docs.select("doc_id", "text")
    ids = _sampled(positives.select("doc_id").distinct(), rows, "positive")
    known = texts.join(bounded_broadcast(ids, 2 * rows), "doc_id", "left_semi")
    xp = _matrix(_sampled(known, rows, "row"), 2 * rows)
    if not len(xp):
        return None
    return fit_pu(xp, _matrix(_sampled(texts, rows, "unlabelled"), 2 * rows))


def score_quality(docs: DataFrame, model: QualityModel | None, *keep: Column) -> DataFrame:
    """``*keep, score, predicted`` of every whole text (0 to 1, higher: better)."""
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    names = rows.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            scores = np.zeros(len(texts))
            full = [i for i, t in enumerate(texts) if t]
            if full and fitted is not None:
                scores[full] = fitted.score(np.array([features(texts[i]) for i in full],
                                                     dtype=np.float64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(scores),
                 pa.array((scores >= 0.5).astype(np.int32))],
                names=[*names, "score", "predicted"])

    return rows.mapInArrow(run, with_fields(rows.schema.fields[:-1],
                                            "score double, predicted int"))
