"""Densities and bandwidths against sums over all pairs of points."""

import numpy as np
import pytest

from wakeline.operators import stats


def gauss(x, y, p, h):
    z = ((x - p[:, 0]) / h[0]) ** 2 + ((y - p[:, 1]) / h[1]) ** 2
    return np.exp(-z / 2).mean() / (2 * np.pi * h[0] * h[1])


def leave_one_out(p, h):
    """Log likelihood of each point under the density of the others."""
    p = np.asarray(p, float).reshape(len(p), -1)
    z = sum(((p[:, None, k] - p[None, :, k]) / h[k]) ** 2 for k in range(p.shape[1]))
    k = np.exp(-z / 2)
    np.fill_diagonal(k, 0)
    return np.log(np.maximum(k.sum(1), np.exp(-12.5)) / ((len(p) - 1) * np.prod(h) * (2 * np.pi) ** (p.shape[1] / 2))).sum()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal([0, 0], [1, 3], (300, 2)), rng.normal([6, -4], [0.5, 1], (200, 2))])
    rows = [(float(a), float(b)) for a, b in p]
    return p, spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "x double, y double").repartition(4)


def test_grid_against_all_points(spark, cloud):
    p, df = cloud
    out = stats.density_grid(df, "x", "y", (0.6, 1.1), (0.5, 1.0)).collect()
    for r in out[::7]:
        assert r.density == pytest.approx(gauss(r.x, r.y, p, (0.6, 1.1)), rel=0.01, abs=2e-4)  # a cell is an eighth of a bandwidth
    assert sum(r.density for r in out) * 0.5 * 1.0 == pytest.approx(1, abs=0.005)
    one = stats.density_grid(spark.createDataFrame([(0.0, 0.0)] * 3, "x double, y double"), "x", "y", (1.0, 1.0), (20.0, 20.0)).collect()
    assert [(r.i, r.j) for r in one] == [(0, 0)] and one[0].density == pytest.approx(1 / (2 * np.pi))
    assert stats.density_grid(df.limit(0), "x", "y", (1.0, 1.0), (1.0, 1.0)).count() == 0


@pytest.mark.parametrize("columns", [["x"], ["x", "y"]])
def test_likelihoods_against_all_pairs(cloud, columns):
    p, df = cloud
    widths = [[0.3 * f] + [0.8 * f] * (len(columns) - 1) for f in (0.5, 1.0, 2.0, 5.0)]
    got = {r.candidate: r.log_likelihood for r in stats.bandwidth_likelihoods(df.dropna(), columns, widths, resolution=8).collect()}
    for k, h in enumerate(widths):
        assert got[k] == pytest.approx(leave_one_out(p[:, : len(columns)], h), rel=0.004)


@pytest.mark.parametrize("columns", [["x"], ["x", "y"]])
def test_best_bandwidth(cloud, columns):
    p, df = cloud
    own = p[:, : len(columns)]
    shares = np.geomspace(0.02, 1, 120)
    sd = own.std(0, ddof=1)
    best = shares[np.argmax([leave_one_out(own, s * sd) for s in shares])]
    found = np.array(stats.best_bandwidth(df.dropna(), columns, low=0.02, high=1.0))
    assert found / sd == pytest.approx(np.full(len(columns), best), rel=0.3)  # the top is flat
    assert leave_one_out(own, found) > leave_one_out(own, best * sd) - 1
    with pytest.raises(ValueError):
        stats.best_bandwidth(df.where("x > 1e9"), ["x"])
