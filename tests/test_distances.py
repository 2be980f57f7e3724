"""Least distances by cells against all pairs of points."""

import random

import numpy as np
import pytest

from wakeline.operators import tracks

KIND = "id int, lat double, lon double"


def all_pairs(p, q):
    (a, b), (c, d) = np.radians(p).T, np.radians(q).T
    h = np.sin((a[:, None] - c) / 2) ** 2 + np.cos(a)[:, None] * np.cos(c) * np.sin((b[:, None] - d) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))) * 6378.137


def walk(rng, n, lat, lon, step=0.2):
    p = np.cumsum(rng.normal(0, step, (n, 2)), 0) + [lat, lon]
    return np.stack([np.clip(p[:, 0], -90, 90), (p[:, 1] + 180) % 360 - 180], 1)


def test_least_and_mean_against_all_pairs(spark):
    """Far apart, crossing, over the pole and the date line, single and equal points, and tracks of another kind of longitude."""
    rng = np.random.default_rng(6)
    own = {
        1: walk(rng, 300, -60, 20), 2: walk(rng, 250, -58, 22), 3: walk(rng, 80, 50, -100), 4: walk(rng, 200, 0, 179.5), 5: walk(rng, 200, 0.5, -179.5), 6: walk(rng, 60, 89.5, 0),
        7: walk(rng, 60, 89.0, 170), 8: np.array([[90.0, 10.0]]), 9: np.array([[-60.0, 200.0]]), 10: np.array([[-60.0, -160.0]] * 3), 11: rng.uniform([-90, -180], [90, 180], (150, 2)), 12: rng.uniform([-90, -180], [90, 180], (150, 2)),
    }
    df = spark.createDataFrame([(k, float(a), float(b)) for k, v in own.items() for a, b in v] + [(1, None, 3.0), (2, 3.0, None)], KIND).repartition(5)
    pairs = [(a, b) for a in own for b in own if a < b] + [(1, 1), (1, 99)]
    stated = spark.createDataFrame(pairs, "id_a int, id_b int")
    least = {(r.id_a, r.id_b): r.least_km for r in tracks.least_distances(df, df, stated).collect()}
    mean = {(r.id_a, r.id_b): r.mean_km for r in tracks.mean_distances(df.dropna(), df.dropna(), stated).collect()}
    assert set(least) == set(pairs) - {(1, 99)} == set(mean)
    for a, b in least:
        d = all_pairs(own[a], own[b])
        assert least[a, b] == pytest.approx(d.min(), abs=1e-6) and mean[a, b] == pytest.approx(d.mean(), rel=1e-9)
    assert least[9, 10] == pytest.approx(0, abs=1e-3) and least[1, 1] == 0


def test_candidates_follow_the_length(spark):
    """Tracks ten times as long, over the same course, meet in far fewer than a hundred times as many pairs of points."""
    rng = np.random.default_rng(9)

    def met(n):
        a = np.stack([np.linspace(-60, -20, n), np.linspace(0, 60, n)], 1) + rng.normal(0, 0.02, (n, 2))
        b = np.stack([np.linspace(-58, -22, n), np.linspace(8, 66, n)], 1) + rng.normal(0, 0.02, (n, 2))
        df = spark.createDataFrame([(k, float(x), float(y)) for k, v in ((1, a), (2, b)) for x, y in v], KIND)
        front = tracks.distance_candidates(df, df, spark.createDataFrame([(1, 2)], "id_a int, id_b int"))
        pairs = front.join(tracks._located(df, "a"), ["id_a", "i_a", "j_a"]).join(tracks._located(df, "b"), ["id_b", "i_b", "j_b"]).count()
        found = tracks.least_distances(df, df, spark.createDataFrame([(1, 2)], "id_a int, id_b int")).first().least_km
        assert found == pytest.approx(all_pairs(a, b).min(), abs=1e-6)
        return pairs

    small, large = met(400), met(4000)
    assert small < 400 * 20 and large < 4000 * 20, (small, large)


def test_short_tracks_meet_without_cells(spark, monkeypatch):
    """Both ways give the same least distances; pairs of short tracks go through no cells."""
    rng = random.Random(8)
    rows = [(k, rng.uniform(-80, 80), rng.uniform(-180, 180)) for k in range(4) for _ in range(30)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3)], "id_a int, id_b int")
    found = [{(r.id_a, r.id_b): r.least_km for r in tracks.least_distances(df, df, pairs, direct=n).collect()} for n in (0, 900)]
    assert len(found[0]) == 4
    assert found[1] == pytest.approx(found[0])
