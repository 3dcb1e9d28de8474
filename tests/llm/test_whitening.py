"""Operator 12 against numpy."""

import math
import random

import numpy as np
import pytest

from demandcast.llm import queries, whitening

CHECK = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, index int, x string"


def plain(rows, components=32):
    """(vec_id, x) of the rows that stay, and the covariance's eigenpairs."""
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    kept = [(i, np.floor(64 * v).astype(int) + 1_000_000) for i, v in kept if len(v) == width]
    x = np.array([v for _, v in kept])
    n = len(x)
    s = x.sum(axis=0)
    deviation = [sum(int(d) ** 2 for d in n * v - s) for v in x]
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in kept], n, deviation, c, values[::-1][:components], vectors[:, ::-1][:, :components], \
        values.sum()


def same(got, rows, components=32):
    ids, n, deviation, c, values, vectors, trace = plain(rows, components)
    k = len(values)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    assert {r.component for r in got} == set(range(1, k + 1))
    white = c @ vectors / np.sqrt(values)
    flip = {}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for at, i in enumerate(ids):
        for j in range(k):
            found = by[i, j + 1]
            assert any(f.deviation == deviation[at] for f in found)
            assert all(f.explained == pytest.approx(values[j] / trace, rel=1e-9) for f in found)
            if len(found) == 1:
                f = found[0]
                assert abs(f.whitened) == pytest.approx(abs(white[at, j]), rel=1e-6, abs=1e-7)
                if abs(f.whitened) > 1e-3:
                    assert flip.setdefault(j, np.sign(f.whitened * white[at, j])) == np.sign(f.whitened * white[at, j])
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{CHECK}/embeddings.parquet").collect()]
    got = queries.op12_embedding_whitening(spark, CHECK)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(got.collect(), rows)


def edge_rows(n=300, width=5):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, j + 1) for j in range(width)]) for i in range(n)]
    rows += [(900, None), (901, []), (902, [1.0] * (width - 1)), (903, [1.0] * (width - 1) + [None]),
             (904, [float("nan")] * width), (905, [float("inf")] + [0.0] * (width - 1)),
             (906, [-float("inf")] + [0.0] * (width - 1)), (3, rows[3][1]), (None, [0.5] * width)]
    return rows


def framed(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, "c", 1, "x") for i, v in rows], SCHEMA)


def test_edges_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 50)  # 10 rows a block
    monkeypatch.setattr(whitening, "BLOCKS_A_SPLIT", 3)
    rows = edge_rows()
    got = whitening.whiten(framed(spark, rows).repartition(6)).collect()
    same(got, rows)
    assert {r.component for r in got} == {1, 2, 3, 4, 5}
    assert not {r.vec_id for r in got} & set(range(900, 910))
    few = whitening.whiten(framed(spark, rows), components=2).collect()
    assert {r.component for r in few} == {1, 2}


def test_hot_vector_and_dependent_dimensions(spark):
    rng = random.Random(4)
    rows = [(i, [a, 2 * a, b]) for i in range(200) for a, b in [(float(rng.randint(-5, 5)), rng.gauss(0, 1))]]
    rows += [(1000 + i, [1.0, 2.0, 0.5]) for i in range(150)]
    got = whitening.whiten(framed(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2}  # the third has no variance
    assert len(got) == 2 * len(rows) and {r.identity_error < 1e-9 for r in got} == {True}
    white = np.array([r.whitened for r in got if r.component == 2])
    assert abs(white.mean()) < 1e-9 and white.var() == pytest.approx(1)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(framed(spark, rows))
        assert out.count() == 0 and out.columns[0] == "vec_id"
