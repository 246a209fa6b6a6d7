"""Whitening against a dense numpy fit over the distinct quantised vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposight.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, components=4):
    """vec_id -> (n, deviation, [whitened...], [explained...]) by numpy over the distinct floor(256 c) vectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in good}
    distinct = sorted(set(xs.values()))
    x = np.array(distinct, dtype=np.float64)
    n, sums = len(distinct), np.array(distinct, dtype=object).sum(axis=0)
    cov = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    out = {}
    for i, xi in xs.items():
        dev = sum((n * a - s) ** 2 for a, s in zip(xi, sums))
        w = [(np.array(xi) - x.mean(axis=0)) @ vectors[:, k] / math.sqrt(values[k]) for k in range(components)]
        out[i] = (n, dev, w, [values[k] / values.sum() for k in range(components)])
    return out


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    if clash:
        df = df.withColumns({"x": F.lit(1), "copies": F.lit("a"), "w0": F.lit(2.0), "n": F.lit(0), "component": F.lit(9)})
    return df


def cases(seed=5, n=60, d=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.array([0.5, 0.3, 0.2, 0.1, 0.05, 0.02])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[3][1]) for i in range(25)]  # one vector held by many rows
    rows += [(200, None), (201, []), (202, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(205, rows[7][1]), (205, rows[7][1])]  # a repeated row
    return rows


@pytest.mark.parametrize("clash", [False, True])
def test_whitening_equals_numpy(spark, clash):
    rows = cases()
    found = whitening.whiten(frame(spark, rows, clash), components=4).collect()
    expect = brute(rows)
    assert sorted({r.vec_id for r in found}) == sorted(expect)
    assert len(found) == 4 * (len(rows) - 5)
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and errors.pop() <= 1e-4
    for r in found:
        n, dev, w, explained = expect[r.vec_id]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(abs(r.whitened) - abs(w[r.component - 1])) <= 1e-6 * (1 + abs(w[r.component - 1]))
        assert abs(r.explained - explained[r.component - 1]) <= 1e-4 * explained[r.component - 1]
    # One sign per component for all rows.
    for k in range(1, 5):
        ratios = {round(r.whitened / expect[r.vec_id][2][k - 1], 6) for r in found if r.component == k and abs(expect[r.vec_id][2][k - 1]) > 1e-3}
        assert len(ratios) == 1


def test_whitened_covariance_is_identity(spark):
    found = whitening.whiten(frame(spark, cases(seed=9)), components=4)
    distinct = found.join(whitening.quantised(frame(spark, cases(seed=9))), "vec_id").dropDuplicates(["x", "component"])
    per = {}
    for r in distinct.collect():
        per.setdefault(tuple(r.x), {})[r.component] = r.whitened
    w = np.array([[v[k] for k in range(1, 5)] for v in per.values()])
    cov = np.cov(w.T, bias=True)
    assert np.abs(cov - np.eye(4)).max() <= 1e-6


def test_whitening_empty_and_degenerate(spark):
    assert whitening.whiten(frame(spark, []), components=4).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [float("nan")])]), components=4).collect() == []
    # One distinct vector: a zero covariance, nothing to whiten.
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]), components=4).collect() == []
    # Two distinct vectors in two dimensions: one direction only.
    two = whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.0, 0.0]), (None, [0.0, 0.0])]), components=4).collect()
    assert sorted((r.vec_id is None, r.component) for r in two) == [(False, 1), (False, 1), (True, 1)]
    assert all(abs(abs(r.whitened) - 1) <= 1e-12 for r in two)


def test_whitening_needs_one_length(spark):
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.1])]), components=4)
