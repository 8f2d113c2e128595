"""The classifier's sums over all unlabelled rows against one array, and their weights against a slow descent."""

import numpy as np
import pytest

from tallow.llm import quality_classifier as qc


def rows_of(spark, bins, parts):
    data = [(k, bins[k::parts].astype(np.int16).tobytes()) for k in range(parts)]
    return spark.createDataFrame(data, "part long, bins binary").repartition(3)


def bins_of(n, size, seed):
    rng = np.random.default_rng(seed)
    width = size // len(qc.NAMES)
    return np.column_stack([k * width + rng.integers(0, width, n) for k in range(len(qc.NAMES))])


def test_sums_of_tasks_equal_those_of_one_array(spark):
    size = 14 * 3 + 1
    bins, theta = bins_of(500, size - 1, 0), np.random.default_rng(1).normal(size=size)
    one, many = qc._Sums(size), qc._all_sums(rows_of(spark, bins, 7), theta)
    one.add(bins, theta)
    x = np.zeros((500, size))
    x[np.arange(500)[:, None], bins] = 1
    x[:, -1] = 1
    s = 1 / (1 + np.exp(-x @ theta))
    assert many.n == one.n == 500 and many.loss == pytest.approx(np.logaddexp(0, x @ theta).sum())
    assert np.allclose(many.grad, x.T @ s) and np.allclose(many.hess, (x * (s * (1 - s))[:, None]).T @ x) and np.allclose(one.hess, many.hess)


def test_weights_minimise_the_risk_over_all_rows(spark):
    size, prior = 14 * 2 + 1, 0.3
    good, unlabelled = bins_of(80, size - 1, 2), bins_of(400, size - 1, 3)
    good[:, 0] = 1
    theta = qc._minimise(np.zeros(size), good, rows_of(spark, unlabelled, 5), prior, steps=40)

    def risk(w):
        zp, zu = w[good].sum(1) + w[-1], w[unlabelled].sum(1) + w[-1]
        return prior * np.logaddexp(0, -zp).mean() + np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() + qc.DECAY / 2 * (w[:-1] ** 2).sum()

    at = risk(theta)
    rng = np.random.default_rng(4)
    assert all(risk(theta + 0.05 * rng.normal(size=size)) > at for _ in range(50))
