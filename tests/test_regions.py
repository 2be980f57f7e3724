"""Contours, alpha shapes, mixtures and point predictions against analytic values and plain versions."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from wakeline.functions import contours as C
from wakeline.functions import distributions as D
from wakeline.operators import regions
from wakeline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def grid(f, lo, hi, n=200):
    x = np.linspace(lo, hi, n)
    return f(*np.meshgrid(x, x, indexing="ij")), x, x


def flat(region):
    return sum((-1 if hole else 1) * abs(C.signed_area(ring)) for _, hole, ring in region)


def test_ring_has_a_hole():
    z, x, y = grid(lambda x, y: -np.abs(np.hypot(x, y) - 2), -4, 4)
    region = C.level_region(z + 10, x, y, 9.0)
    assert [(part, hole) for part, hole, _ in region] == [(0, False), (0, True)]
    assert flat(region) == pytest.approx(math.pi * (9 - 1), rel=0.003)
    assert C.in_region(np.array([[2, 0], [0, 0], [0, -1.5], [3.2, 0]]), region).tolist() == [True, False, True, False]


def test_island_within_a_hole():
    z, x, y = grid(lambda x, y: np.cos(2 * np.hypot(x, y)) + 2, -4, 4, 400)
    region = C.level_region(z * (np.hypot(*np.meshgrid(x, y)) < 3.9), x, y, 2.5)
    rings = sorted((np.hypot(*ring.T).mean(), hole) for _, hole, ring in region)
    edges = [math.pi / 6, math.pi - math.pi / 6, math.pi + math.pi / 6]
    assert [h for _, h in rings] == [False, True, False]
    assert [r for r, _ in rings] == pytest.approx(edges, rel=0.01)
    assert C.in_region(np.array([[0, 0], [1.5, 0], [3.1, 0]]), region).tolist() == [True, False, True]


def test_saddles_and_random_grids_agree_with_cells():
    """Even-odd membership of grid points is what the grid says, also where corners meet across a cell."""
    rng = np.random.default_rng(5)
    for n in (2, 3, 8, 25):
        for _ in range(20):
            z, x, y = rng.random((n, n)), np.arange(n) * 1.0, np.arange(n) * 2.0
            region = C.level_region(z, x, y, 0.5)
            inner = np.stack(np.meshgrid(x, y, indexing="ij"), -1).reshape(-1, 2)
            assert (C.in_region(inner, region) == (z >= 0.5).ravel()).all()
            for part, hole, ring in region:
                assert hole == (C.signed_area(ring) < 0)
                if hole:
                    about = next(g for p, h, g in region if p == part and not h)
                    assert D.inside_ring(ring, about).mean() > 0.9


def test_open_lines_are_joined():
    z, x, y = grid(lambda x, y: 5 - np.hypot(x - 2, y), 0, 4, 101)  # the edge cuts the disc
    lines = C.level_lines(z, x, y, 3.2)
    assert len(lines) == 1 and not np.allclose(lines[0][0], lines[0][-1])
    (ring,) = C.rings_of(lines)
    assert abs(C.signed_area(ring)) == pytest.approx(math.pi * 1.8**2 / 2, rel=0.01)
    z, x, y = grid(lambda x, y: np.abs(x - y), 0, 4, 101)
    assert len(C.level_lines(z, x, y, 1.0)) == 2 and len(C.rings_of(C.level_lines(z, x, y, 1.0))) == 1


def test_contours_agree_with_cells_and_mass(spark):
    levels = np.linspace(0.001, 0.999, 201)
    q = D.normal_ppf(levels) * 100
    df = spark.createDataFrame([(1, levels.tolist(), q.tolist(), (q / 2).tolist(), 0.0, 0.0), (2, levels.tolist(), q.tolist(), q.tolist(), 400.0, 0.0)], "id long, levels array<double>, qx array<double>, qy array<double>, x double, y double")
    out = {(r.id, r.confidence): r for r in regions.evaluate(df, ["id"], (0.5, 0.9), kind="contour").collect()}
    for (i, c), r in out.items():
        assert r.area == pytest.approx(-2 * math.pi * 100 * (50 if i == 1 else 100) * math.log(1 - c), rel=0.02)
        dist = D.Bivariate(q, q / (3 - i), levels)
        assert r.area == pytest.approx(dist.contour_area(c, 600, 100000), rel=0.01)
        assert r.covered == (i == 1) and [g.hole for g in r.rings] == [False]


def test_two_humps(spark):
    """A mixture far apart has two parts, its 0.9 region covers nine in ten drawn points, and mass ranks a point."""
    part = {"weight": 1.0, "mx": 0.0, "my": 0.0, "l11": 1.0, "l22": 0.5, "l21": 0.5}
    parts = [part, part | {"weight": 2.0, "mx": 12.0, "l11": 2.0}]
    kind = "id long, parts array<struct<weight:double,mx:double,my:double,l11:double,l22:double,l21:double>>, x double, y double"
    drawn = D.Mixture(np.array([list(p.values()) for p in parts])).sample(600, 3)
    df = spark.createDataFrame([(i, parts, float(a), float(b)) for i, (a, b) in enumerate(drawn)], kind)
    out = regions.mixture_regions(df, ["id"], (0.5, 0.9)).collect()
    assert len(out) == 1200 and {len({g.part for g in r.rings}) for r in out if r.confidence == 0.9} == {2}
    for c in (0.5, 0.9):
        covered = np.mean([r.covered for r in out if r.confidence == c])
        assert covered == pytest.approx(c, abs=4 * math.sqrt(c * (1 - c) / 600))
    for r in out:
        assert (r.mass <= r.confidence + 0.02) if r.covered else (r.mass >= r.confidence - 0.02)
    one = regions.mixture_regions(spark.createDataFrame([(0, [part], 9.0, 9.0)], kind), ["id"], (0.5, 0.9)).collect()
    for r in one:
        assert r.area == pytest.approx(-2 * math.pi * 0.5 * math.log(1 - r.confidence), rel=0.01) and not r.covered and r.mass > 0.999


def test_delaunay_circles_are_empty():
    rng = np.random.default_rng(1)
    for p in (rng.random((60, 2)), rng.permutation(np.stack(np.meshgrid(np.arange(7.0), np.arange(7.0)), -1).reshape(-1, 2))):
        tri = C.triangles(p)
        hull = D.convex_hull(p)
        a, b, c = (p[tri[:, k]] for k in range(3))
        area = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
        assert (area > -1e-12).all() and area.sum() == pytest.approx(C.signed_area(hull), rel=1e-6)
        for u, v, w in p[tri]:
            m = np.linalg.solve(2 * np.array([v - u, w - u]), [(v * v - u * u).sum(), (w * w - u * u).sum()])
            assert (np.hypot(*(p - m).T) > np.hypot(*(u - m)) - 1e-9).all()


def test_alpha_shapes():
    rng = np.random.default_rng(7)
    t, s = rng.random(1200) * 2 * np.pi, np.sqrt(rng.uniform(4, 9, 1200))
    ring = np.stack([s * np.cos(t), s * np.sin(t)], 1)
    region = C.alpha_region(ring, 0.12)
    assert [h for _, h, g in region if abs(C.signed_area(g)) > 1] == [False, True]
    assert flat(region) == pytest.approx(math.pi * 5, rel=0.08)
    assert C.in_region(np.array([[2.5, 0], [0, 0], [5, 5]]), region).tolist() == [True, False, False]
    crescent = ring[np.hypot(*(ring - [1.5, 0]).T) > 1.6]
    assert flat(C.alpha_region(crescent, 0.12)) < 0.75 * C.signed_area(D.convex_hull(crescent))
    assert C.alpha_region(np.array([[0, 0], [1, 1.0]])) == [] == C.alpha_region(np.stack([np.arange(9.0)] * 2, 1))
    square = C.alpha_region(np.array([[0, 0], [1, 0], [1, 1], [0, 1.0], [0, 1]]))
    assert flat(square) == pytest.approx(1)


def test_alpha_shape_of_a_normal_pair(spark):
    levels = np.linspace(0.001, 0.999, 201)
    q = D.normal_ppf(levels) * 100
    df = spark.createDataFrame([(1, levels.tolist(), q.tolist(), q.tolist(), 0.0, 0.0)], "id long, levels array<double>, qx array<double>, qy array<double>, x double, y double")
    for r in regions.evaluate(df, ["id"], (0.5, 0.9), kind="alpha").collect():
        whole = -2 * math.pi * 100**2 * math.log(1 - r.confidence)
        assert 0.6 * whole < r.area < 1.05 * whole and r.covered


def test_alpha_shapes_of_keys(spark):
    """Many points of one key come down to its cells; the shape of a square with a corner cut out has that area, the sphere's here being flat."""
    rng = np.random.default_rng(3)
    p = rng.random((30000, 2)) * 10
    p = p[~((p[:, 0] > 5) & (p[:, 1] > 5))]
    rows = [("a", float(x), float(y)) for x, y in p] + [("b", 1.0, 1.0)] * 5 + [("c", float(i), float(i)) for i in range(4)] + [("d", None, 1.0), ("d", 0.0, 0.0), ("d", 0.0, 2.0), ("d", 2.0, 0.0)]
    out = {r.id: r for r in regions.alpha_shapes(spark.createDataFrame(rows, "id string, x double, y double").repartition(4), "id", "x", "y").collect()}
    assert out["a"].points == len(p) and out["a"].kept <= 16 * 16 * 4
    assert out["a"].area == pytest.approx(75, rel=0.03) and out["a"].rings[0].hole is False
    assert (out["b"].area, out["b"].rings, out["c"].rings) == (0.0, [], [])
    assert out["d"].points == 3 and out["d"].area == pytest.approx(2, rel=1e-3)


def test_point_predictions_against_the_curve():
    rng = np.random.default_rng(2)
    levels = np.array([0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975])
    q = np.sort(rng.normal(size=(40, 7)), 1) * 10
    q[0], q[1, 3], q[2] = 4.0, q[1, 2], q[2][::-1]
    out = D.cubic_points(q, levels)
    even = (np.arange(4000) + 0.5) / 4000
    for row, (mean, median, top) in zip(q, out):
        if np.ptp(row) == 0:
            assert (mean, median, top) == (4.0, 4.0, 4.0)
            continue
        d = D.MonotoneCubic(row, levels)
        assert mean == pytest.approx(d.inverse(even).mean(), abs=0.01)
        assert median == pytest.approx(float(d.inverse(0.5)), abs=1e-9)
        assert d.pdf(top) >= d.pdf(D.mode(d, 4000)) * (1 - 1e-9)
    other = D.cubic_points(q[3:5], np.array([0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 0.9]))
    assert other[0, 1] == pytest.approx(float(D.MonotoneCubic(q[3], np.array([0.1, 0.2, 0.3, 0.4, 0.6, 0.8, 0.9])).inverse(0.5)), abs=1e-9)


@pytest.mark.parametrize("name", ["region_alpha_shapes", "mixture_regions", "reference_area", "distribution_points"])
def test_rows_are_dealt_over_all_cores(spark, name):
    """Small rows are dear here: none of these may end in one task. One core a row in a small table is enough to see it."""
    assert QUERIES[name](spark, "/root/testdata/sf0.01").select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_contour_query_against_cells(spark):
    """The stand-in's curve has several humps: parts, and holes in them; areas are those of a fine grid's cells, coverage what the density says."""
    from wakeline.sources.fixtures import predictions

    levels = [0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975]
    p = predictions(spark, SF).toPandas().groupby(["id", "time_idx"])
    out = {(r.id, r.time_idx, r.confidence): r for r in QUERIES["region_contours"](spark, SF).collect()}
    assert len(out) == 2 * len(p) and {r.parts for r in out.values()} == {1, 5} and {r.holes for r in out.values()} == {0, 4}
    for key, own in list(p)[:6]:
        q = own.sort_values("quantile")["prediction"].to_numpy()
        dist = D.Bivariate(q, q, levels)
        for c in (0.5, 0.9):
            r = out[(*key, c)]
            assert r.area == pytest.approx(dist.contour_area(c, 400, 100000), rel=0.01)
            at = np.array([[own["actual"].iloc[0]] * 2])
            density, level = dist.pdf(at)[0], dist.level(c, 100000)
            assert abs(density / level - 1) < 0.1 or r.covered == (density > level)


def test_quantile_density_with_tails(spark):
    """Against one row at a time by the definition; mass one within the data, known quantiles of a normal sample."""
    levels = np.linspace(0.02, 0.98, 49)
    q = D.normal_ppf(levels) * 2 + 7
    skew = np.exp(D.normal_ppf(levels))
    rows = [(1, levels.tolist(), q.tolist()), (2, levels.tolist(), skew.tolist()), (3, levels.tolist(), [4.0] * 49), (4, [0.1, 0.5, 0.9], [1.0, 2.0, 5.0])]
    out = {r.id: r for r in regions.quantile_density(spark.createDataFrame(rows, "id int, levels array<double>, qx array<double>"), ["id"]).collect()}
    for r in out.values():
        assert r.cdf[0] == 0 and r.cdf[-1] == pytest.approx(1) and (np.diff(r.edges) >= 0).all() and (np.diff(r.cdf) >= 0).all()
        assert (r.edges[0], r.edges[-1]) == (min(rows[r.id - 1][2]), max(rows[r.id - 1][2]))
    inside = lambda p: 0.02 + 0.96 * p  # noqa: E731  the range holds 0.96 of the mass
    for p in (0.1, 0.25, 0.5, 0.8):
        assert np.interp(p, out[1].cdf, out[1].edges) == pytest.approx(float(D.normal_ppf(np.array([inside(p)]))[0] * 2 + 7), abs=0.08)
        assert np.interp(p, out[2].cdf, out[2].edges) == pytest.approx(float(np.exp(D.normal_ppf(np.array([inside(p)]))[0])), rel=0.08)
    for key, own in ((2, skew), (4, np.array([1.0, 2.0, 5.0]))):
        at = np.array(rows[key - 1][1])
        dx = np.diff(own)
        fit = lambda p, d, to: float(np.polyval(np.polyfit(p, d, 1), to))
        k = min(3, len(dx))
        low, high = fit(at[:k], dx[:k], 0), fit(at[-k:], dx[-k:], 1)
        low, high = (dx[:2].sum() if low < dx[0] else low), (dx[-2:].sum() if high < dx[-1] else high)
        wide = np.concatenate([[own[0] - low], own, [own[-1] + high]])
        hd = np.concatenate([[wide[0]], D.harrell_davis_weights(len(wide), np.arange(1, 1000) / 1000) @ wide, [wide[-1]]])
        keep = np.flatnonzero((hd > own[0]) & (hd < own[-1]))
        assert out[key].edges[1:-1] == pytest.approx(hd[keep])
    df = spark.createDataFrame([(1, out[1].edges, out[1].cdf, x) for x in (7.0, 6.0, -50.0, out[1].edges[-1])], "id int, edges array<double>, cdf array<double>, x double")
    got = [r[0] for r in df.select(regions.density_at(F.col("edges"), F.col("cdf"), F.col("x"))).collect()]
    normal = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / 2 / 0.96
    assert got[0] == pytest.approx(normal(0), rel=0.06) and got[1] == pytest.approx(normal(0.5), rel=0.06) and got[2] == 0 and got[3] > 0
    assert df.select(regions.density_quantile(F.col("edges"), F.col("cdf"), 0.5)).first()[0] == pytest.approx(7, abs=0.01)


def test_quantile_density_query(spark):
    """The stand-ins are even about their median."""
    rows = QUERIES["quantile_density"](spark, SF).collect()
    assert rows and all(r.q25 < r.median < r.q75 and abs(r.q25 + r.q75 - 2 * r.median) < 2e-5 and r.density >= 0 for r in rows)
    assert max(r.density for r in rows) < 0.1


def test_ranks_of_products_are_those_of_all_products():
    rng = np.random.default_rng(2)
    for a, b in ((rng.random(40), rng.random(30)), (rng.integers(0, 4, 25) * 1.0, rng.integers(0, 3, 50) * 0.5), (np.ones(9), np.ones(9)), (np.zeros(3), rng.random(5))):
        every = np.sort(np.outer(a, b), axis=None)
        ranks = list(range(0, len(every), 7)) + [len(every) - 1]
        assert D.product_ranks(a, b, ranks) == every[ranks].tolist()


def test_hulls_of_independent_axes_are_those_of_all_points():
    """The hull and the levels are found from the axes alone, without the grid of their products."""
    rng = np.random.default_rng(4)
    levels = np.array([0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975])
    for qx, qy in ((levels * 60, levels * 60), (np.sort(rng.normal(size=7)) * 50, np.sort(rng.normal(size=7)) * 80)):
        dist = D.Bivariate(qx, qy, levels)
        x, y, z = dist.even(10000)
        for c, hull in zip((0.5, 0.9), dist.hulls((0.5, 0.9), 10000)):
            dense = z >= np.sort(z, axis=None)[z.size - int(c * z.size)]
            want = D.convex_hull(np.stack([x[dense], y[dense]], 1))
            assert D.area_on_sphere(hull) == pytest.approx(D.area_on_sphere(want), rel=1e-12)
        assert dist.levels((0.5, 0.9), 10000) == pytest.approx(np.quantile(z, [0.5, 0.1]).tolist(), rel=1e-12)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(D.Bivariate, "even", None)
            dist.hulls((0.5,), 10000)


def test_regions_without_their_rings(spark):
    rows = [(k, [0.1, 0.5, 0.9], [k - 1.0, k + 0.0, k + 2.0], [k - 1.0, k + 0.0, k + 2.0], 0.0, 0.0) for k in range(70)]
    df = spark.createDataFrame(rows, "id int, levels array<double>, qx array<double>, qy array<double>, x double, y double")
    for kind in ("hull", "contour"):
        full = regions.evaluate(df, ["id"], (0.5, 0.9), kind=kind, samples=1000, grid=30)
        bare = regions.evaluate(df, ["id"], (0.5, 0.9), kind=kind, samples=1000, grid=30, rings=False)
        assert bare.columns == ["id", "confidence", "area", "covered", "parts", "holes"]
        assert sorted(bare.collect()) == sorted(full.select(*bare.columns).collect())
        assert full.where("parts <> size(filter(rings, g -> not g.hole)) or holes <> size(filter(rings, g -> g.hole))").count() == 0


def test_density_summary_is_that_of_the_steps(spark):
    """Quantiles and density as from the arrays of `quantile_density`, without a row of them leaving the task."""
    rng = np.random.default_rng(6)
    levels = [0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975]
    rows = [(k, levels, [float(v) for v in np.sort(rng.normal(size=7)) * 20], float(x)) for k, x in enumerate(rng.normal(size=80) * 20)]
    rows += [(100, levels, [3.0] * 7, 3.0), (101, levels, [3.0] * 7, 4.0), (102, levels, rows[0][2], rows[0][2][-1]), (103, levels, rows[0][2], None)]
    df = spark.createDataFrame(rows, "id int, levels array<double>, qx array<double>, x double")
    edges, cdf = F.col("edges"), F.col("cdf")
    steps = regions.quantile_density(df, ["id"]).join(df.select("id", "x"), "id")
    want = steps.select("id", *[regions.density_quantile(edges, cdf, p) for p in (0.25, 0.5, 0.75)], regions.density_at(edges, cdf, F.col("x"))).collect()
    got = {r.id: (*r.quantiles, None if r.density != r.density else r.density) for r in regions.density_summary(df, ["id"], (0.25, 0.5, 0.75)).collect()}
    assert len(want) == len(got) == len(rows)
    for k, *numbers in want:
        assert [v is None for v in got[k]] == [v is None for v in numbers]
        assert [v for v in got[k] if v is not None] == pytest.approx([v for v in numbers if v is not None], rel=1e-12)


def test_regions_are_handed_on_in_pieces():
    """A batch of many rows does not hold all their rings at once."""
    import pandas as pd

    sizes = [len(f) for f in regions._pieces([pd.DataFrame({"k": range(1000)}), pd.DataFrame({"k": []})])]
    assert sum(sizes) == 1000 and max(sizes) <= 64


def test_reference_boxes_are_those_of_their_draws():
    steps = np.random.default_rng(1).normal(size=(40, 2))
    lo, hi = D.reference_box(steps, 6, np.array([0.1, 0.5]), 2000)
    paths = np.cumsum(steps[np.random.default_rng(0).integers(0, 40, (2000, 6))], axis=1)
    for k, alpha in enumerate((0.1, 0.5)):
        side = 1 - math.sqrt(1 - alpha)
        assert lo[k] == pytest.approx(np.quantile(paths, side / 2, axis=0))
        assert hi[k] == pytest.approx(np.quantile(paths, 1 - side / 2, axis=0))
    assert D.resampled_places(40, 6, 2000, 0, True) is D.resampled_places(40, 6, 2000, 0, True)


def test_regions_that_lie_alike_are_made_once(spark):
    """Rows moved about share a region, and each has the area, coverage and rings that it has by itself."""
    from types import SimpleNamespace

    import pandas as pd

    levels = [0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975]
    shapes = [([-30.0, -20, -10, 0, 10, 20, 30], [-30.0, -20, -10, 0, 10, 20, 30], levels), ([-9.0, -3, -1, 0, 4, 5, 8], [-30.0, -20, -10, 0, 10, 20, 30], levels), ([-8.0, -7, -3, 0, 2, 5, 11], [-5.0, -3, -2, 0, 4, 5, 7], levels), ([-4.0, 0, 5], [-1.0, 0, 9], [0.1, 0.5, 0.9])]
    rng = np.random.default_rng(8)
    rows = []
    for k in range(240):
        qx, qy, p = shapes[k % 4]
        x, y = (rng.random(2) * 300).tolist()
        rows.append((k, p, [x + v for v in qx], [(x if k % 4 == 0 else y) + v for v in qy], x + float(rng.normal()) * 9, (x if k % 4 == 0 else y) + float(rng.normal()) * 9))
    names = ["id", "levels", "qx", "qy", "x", "y"]
    df = spark.createDataFrame(rows, "id int, levels array<double>, qx array<double>, qy array<double>, x double, y double")
    frame = pd.DataFrame([tuple(np.array(v) if isinstance(v, list) else v for v in row) for row in rows], columns=names)
    made, whole = [], D.Bivariate
    local = SimpleNamespace(schema=df.schema, mapInPandas=lambda work, kinds: pd.concat(list(work(iter([frame])))))
    for kind in ("hull", "contour"):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(regions, "spread", lambda rows, keys: local)
            m.setattr(D, "Bivariate", lambda *a, **k: made.append(a) or whole(*a, **k))
            out = regions.evaluate(df, ["id"], (0.5, 0.9), kind=kind, samples=2500, grid=40)
        assert len(out) == 480
        for r in out.sample(80, random_state=1).itertuples():
            _, p, qx, qy, x, y = rows[r.id]
            dist = whole(np.array(qx), np.array(qy), np.array(p))
            if kind == "hull":
                region = [(0, False, dist.hulls([r.confidence], 2500)[0])]
            else:
                sides = [np.linspace(d.x[0], d.x[-1], 40) for d in (dist.x, dist.y)]
                region = C.level_region(np.outer(dist.x.pdf(sides[0]), dist.y.pdf(sides[1])), *sides, dist.levels([r.confidence], 2500)[0])
            assert r.area == pytest.approx(C.region_area(region), rel=2e-3)  # points of equal density may fall to either side of a level by a last digit
            assert r.area == pytest.approx(C.region_area([(g["part"], g["hole"], np.array([[v["x"], v["y"]] for v in g["ring"]])) for g in r.rings]), rel=1e-6)
            assert r.covered == C.in_region(np.array([[x, y]]), region)[0] and (r.parts, r.holes) == (sum(not h for _, h, _ in region), sum(h for _, h, _ in region))
    assert len(made) == 8


def test_a_level_of_zero_holds_the_whole_grid():
    z, x, y = grid(lambda x, y: np.maximum(1 - np.hypot(x, y), 0), -2, 2, 50)
    for level in (0.0, 1e-9):
        region = C.level_region(z, x, y, level)
        assert flat(region) == pytest.approx(16.0 if level == 0 else math.pi, rel=0.08)


@pytest.mark.parametrize("radius", [None, 0.05])
def test_alpha_shapes_of_large_keys_are_those_of_all_their_points(spark, radius):
    """Tile by tile as from all points at once: even points, a dense nest with a few far ones, points of a lattice, a line; every point counts."""
    rng = np.random.default_rng(11)
    nest = np.concatenate([rng.normal(size=(500, 2)) * 0.01, rng.normal(size=(60, 2)) * 3, [[40.0, 7.0]]])
    t = rng.random(500) * 2 * np.pi
    sets = {"even": rng.random((600, 2)) * [10, 300], "nest": nest, "lattice": np.round(rng.random((900, 2)) * 24), "ring": np.stack([np.cos(t), np.sin(t)], 1) * rng.uniform(0.8, 1, (500, 1)), "line": np.stack([np.arange(200.0)] * 2, 1)}
    rows = [(k, float(x), float(y)) for k, p in sets.items() for x, y in p] + [("few", 0.0, 0.0), ("few", 0.0, 2.0), ("few", 2.0, 0.0), ("few", 2.0, math.nan)]
    df = spark.createDataFrame(rows, "id string, x double, y double").repartition(5)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(regions, "TILE", 25)
        out = {r.id: r for r in regions.alpha_shapes(df, "id", "x", "y", radius, whole=100).collect()}
    edges = lambda rings: {(tuple(a), tuple(b)) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])}
    assert set(out) == {*sets, "few"} and out["few"].points == 3
    for k, p in sets.items():
        want = [ring.tolist() for _, _, ring in C.alpha_region(p, radius)]
        got = [[[v.x, v.y] for v in g.ring] for g in out[k].rings]
        assert edges(got) == edges(want), k
        assert out[k].points == len(p) and out[k].kept == len({a for a, _ in edges(want)}) and bool(want) == (k != "line")
    # A cell's inner points count too: the whole shape of a track is that of all its points.
    dent = np.concatenate([rng.random((300, 2)), rng.random((700, 2)) * 0.06])
    one = regions.alpha_shapes(spark.createDataFrame([(1, float(x), float(y)) for x, y in dent], "id int, x double, y double"), "id", "x", "y", 0.03).first()
    assert one.area == pytest.approx(C.region_area(C.alpha_region(dent, 0.03)), rel=1e-9)


def test_holes_that_meet_their_exterior_stay():
    """The area of an alpha shape is that of its triangles, also where a hole touches the rim in a point."""
    for seed in range(60):
        p = np.random.default_rng(seed).random((70, 2))
        p = p / np.ptp(p, axis=0)
        tri = C.triangles(p)
        r = C.radii(p, tri)
        radius = float(np.median(r)) * 1.6
        a, b, c = (p[tri[r <= radius * C.ALIKE][:, k]] for k in range(3))
        whole = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]).sum() / 2
        assert flat(C.alpha_region(p, radius)) == pytest.approx(whole, rel=1e-9)
