"""Intervals of medians, quantiles and root mean squares against plain resampling."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import stats
from wakeline.plans.catalog import QUERIES

STATISTICS = {"median": np.median, "rms": lambda v, axis=None: np.sqrt(np.mean(np.square(v), axis=axis)), "mean": np.mean}


def plain(v, of, R=4000, alpha=0.05, blocks=100, seed=1):
    """BCa by drawing units with replacement; the acceleration from leaving out one random part after the other."""
    rng = np.random.default_rng(seed)
    draws = np.concatenate([of(v[rng.integers(0, len(v), (500, len(v)))], axis=1) for _ in range(R // 500)])
    part = rng.permutation(len(v)) % blocks
    drop = np.array([of(v[part != b]) for b in range(blocks)])
    off, norm = drop.mean() - drop, NormalDist()
    a = (off**3).sum() / (6 * (off**2).sum() ** 1.5) if (off**2).sum() else 0
    z0 = norm.inv_cdf((draws < of(v)).mean() + (draws == of(v)).mean() / 2)
    return np.quantile(draws, [norm.cdf(z0 + (z0 + norm.inv_cdf(p)) / (1 - a * (z0 + norm.inv_cdf(p)))) for p in (alpha / 2, 1 - alpha / 2)])


@pytest.mark.parametrize("statistic", list(STATISTICS))
def test_intervals_against_plain_resampling(spark, statistic):
    rng = np.random.default_rng(12)
    v = rng.gamma(2.0, 3.0, 2000)  # skewed, so that the acceleration shows
    rows = [("a", i, float(x + e)) for i, x in enumerate(v) for e in (-0.5, 0.5)] + [("b", i, float(x)) for i, x in enumerate(-v[:400])] + [(None, 1, 2.0), ("a", 5000, None), ("b", 7000, float("nan"))]
    out = {r.g: r for r in stats.bootstrap_statistic(spark.createDataFrame(rows, "g string, id int, v double").repartition(5), "v", ["g"], "id", statistic).collect()}
    of = STATISTICS[statistic]
    for g, own in (("a", v), ("b", -v[:400])):
        lo, hi = plain(own, of)
        assert out[g].units == len(own) and out[g].value == pytest.approx(of(own), rel=6e-4)
        assert out[g].lo == pytest.approx(lo, abs=0.12 * (hi - lo)) and out[g].hi == pytest.approx(hi, abs=0.12 * (hi - lo))
    assert (out[None].units, out[None].value) == (1, 2.0)


def test_quantile_level_and_reductions(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(50, 10, (1500, 5))
    df = spark.createDataFrame([(i, float(x)) for i, row in enumerate(v) for x in row], "id int, v double").withColumn("g", F.lit(1))
    out = stats.bootstrap_statistic(df, "v", ["g"], "id", "quantile", 0.9, within="median").first()
    own = np.median(v, axis=1)
    lo, hi = plain(own, lambda x, axis=None: np.quantile(x, 0.9, axis=axis))
    assert out.value == pytest.approx(np.quantile(own, 0.9), rel=6e-4)
    assert out.lo == pytest.approx(lo, abs=0.15 * (hi - lo)) and out.hi == pytest.approx(hi, abs=0.15 * (hi - lo))
    same = stats.bootstrap_statistic(df, "v", ["g"], "id", "quantile", 0.9, within="median").first()
    assert same == out  # draws follow the seed


def test_median_interval_covers(spark):
    """Ninety-five in a hundred intervals of the median hold the true one, a few more or less."""
    rng = np.random.default_rng(8)
    v = rng.exponential(1.0, (200, 120))
    df = spark.createDataFrame([(g, i, float(x)) for g, row in enumerate(v) for i, x in enumerate(row)], "g int, id int, v double")
    out = stats.bootstrap_statistic(df, "v", ["g"], "id", "median", R=1000).collect()
    assert len(out) == 200 and 0.9 <= np.mean([r.lo <= np.log(2) <= r.hi for r in out]) <= 0.99


def test_work_does_not_follow_units(spark):
    """Ten times the units, all values alike: the same cells, so the rows that replicates are drawn from do not grow."""
    big = spark.range(200_000).select(F.lit("a").alias("g"), F.col("id"), (F.col("id") % 50 + 1).cast("double").alias("v"))
    r = stats.bootstrap_statistic(big, "v", ["g"], "id", "median", R=2000).first()
    assert (r.units, r.value) == (200_000, 25.5) or r.value == pytest.approx(25.5, abs=0.51)
    assert 25 <= r.lo <= r.hi <= 26


def test_cells_are_in_order_and_narrow(spark):
    v = np.concatenate([[0.0, 1.0, -1.0, 2.0, 0.5, 1 - 2**-53, 1e-300, -1e300, 3.0], np.random.default_rng(0).normal(size=300), 2.0 ** np.arange(-60, 60)])
    got = sorted((r.v, r.c) for r in spark.createDataFrame([(float(x),) for x in v], "v double").select("v", stats.float_cell(F.col("v"), 11).alias("c")).collect())
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))
    for c in {c for _, c in got}:
        own = [x for x, k in got if k == c]
        assert max(own) - min(own) <= abs(own[0]) * 2**-11 + 1e-320


def test_query_against_plain_medians(spark):
    out = {(r.statistic, r.confidence): r for r in QUERIES["bootstrap_medians"](spark, "/root/testdata/sf0.001").collect()}
    from wakeline.plans.catalog import _scored

    own = _scored(spark, "/root/testdata/sf0.001").toPandas()
    for c, rows in own.groupby("confidence"):
        mean = rows.groupby("id")["length"].mean()
        assert out["median length", c].value == pytest.approx(float(mean.median()), rel=1e-3) and out["median length", c].units == len(mean)
        miss = np.maximum(0, np.maximum(rows["lo"] - rows["actual"], rows["actual"] - rows["hi"]))
        assert out["rms miss", c].value == pytest.approx(float(np.sqrt((miss**2).groupby(rows["id"]).mean().mean())), rel=1e-3)
