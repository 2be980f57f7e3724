"""Hand-computed values, inverse pairs and properties of the operators SQL does not check."""

import math
import time
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.functions import calendar, distributions as D, naming, scores, spatial
from wakeline.operators import binning, joins, regions, reshape, scoring, stats, tracks, windows
from wakeline.sources import datasets, tables
from wakeline.streaming.tracks import stream_bins, stream_chunks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_haversine_forms(spark):
    zero, right = F.lit(0.0), F.lit(math.pi / 2)
    assert one(spark, spatial.great_circle(zero, zero, zero, right), spatial.great_circle_atan(zero, zero, zero, right)) == pytest.approx((math.pi / 2, math.pi / 2))
    null = F.lit(None).cast("double")
    assert one(spark, spatial.great_circle(null, zero, zero, right), scores.area_quality(null, F.lit(1.0), F.lit(2.0))) == (None, None)


def test_lens_and_quality(spark):
    r = one(spark, spatial.lens_area(F.lit(2.0), F.lit(2.0), F.lit(4.0)), spatial.lens_area(F.lit(3.0), F.lit(1.0), F.lit(0.5)), spatial.lens_area(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert r == pytest.approx((0.0, math.pi, 2 * math.pi / 3 - math.sqrt(3) / 2))
    a = lambda x: scores.area_quality(F.lit(x), F.lit(10.0), F.lit(1000.0))
    assert one(spark, a(10.0), a(1000.0), a(100.0)) == pytest.approx((1, 0, 0.5))
    q = scores.coverage_quality(F.lit(0.95), F.lit(0.95)), scores.coverage_quality_symmetric(F.lit(0.9999), F.lit(0.95))
    assert one(spark, *q) == pytest.approx((1, 0), abs=1e-9)


def test_areas_agree(spark):
    ring = scores.rectangle(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0))
    d = spark.range(1).select(ring.alias("ring"))
    assert d.select(spatial.ring_area_on_sphere(F.col("ring"))).first()[0] == pytest.approx(1, rel=1e-3)
    tri = np.array([[0, 0], [900, 100], [300, 1500.0]])
    n = 1500
    x, y = np.meshgrid((np.arange(n) + 0.5) * 900 / n, (np.arange(n) + 0.5) * 1500 / n)
    inside = D.inside_ring(np.stack([x.ravel(), y.ravel()], 1), tri)
    e = np.exp(2 * y.ravel() / D.R)
    assert D.area_on_sphere(tri) == pytest.approx((4 * e / (1 + e) ** 2)[inside].sum() * 900 * 1500 / n / n, rel=2e-3)
    k = one(spark, spatial.ellipse_area_km(F.lit(10.0), F.lit(5.0), F.lit(0.0)))[0]
    assert k == pytest.approx(math.pi * 50, rel=1e-4)


def test_thinning_and_starts(spark):
    t = [0, 0.3, 0.5, 1.1, 1.2, 2.2]
    df = spark.createDataFrame([("a", float(x)) for x in t], "id string, d double").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400))
    for f in (tracks.thin, tracks.thin_native):
        assert sorted(r.d for r in f(df, 1.0).collect()) == [0, 1.1, 2.2]
    index = spark.createDataFrame([("a", i) for i in range(11)], "id string, time_idx int")
    assert sorted(r.time_idx for r in tracks.starts(index, 3, compat=True).collect()) == [0, 5, 10]
    assert sorted(r.time_idx for r in tracks.starts(index, 3).collect()) == [0, 4, 8]


def test_runs_and_gaps(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([False, True, True, False, True])], "id string, ts int, f boolean")
    assert sorted(r.ts for r in tracks.longest_run(df, "f").collect()) == [1, 2]
    assert sorted(r.ts for r in tracks.longest_run(df, "f", compat=True).collect()) == [0, 1, 2]
    dense = tracks.densify(spark.createDataFrame([("a", t, float(t)) for t in (3, 4, 7)], "id string, time_idx int, v double"), ["v"])
    assert sorted((r.time_idx, r.v, r.missing) for r in dense.collect()) == [(3, 3, False), (4, 4, False), (5, 4, True), (6, 4, True), (7, 7, False)]


def test_season_labels(spark):
    r = one(spark, *[calendar.season(calendar.month_index(F.lit(float(t)))) for t in (0, 62, 155, 248)])
    assert r == ("winter", "spring", "summer", "autumn")
    d = spark.createDataFrame([([1.0, 2.0, 3.0],), ([4.0],), ([],), ([1.0, None],)], "v array<double>")
    assert [r[0] for r in d.select(windows.resampled(F.col("v"), 5)).collect()] == [[1, 1.5, 2, 2.5, 3], [4] * 5, [], [None] * 5]


def test_names(spark):
    p = one(spark, naming.feature_parts(F.lit("encoder_future_diff_abs_spearman_lat-lon_loc")))[0]
    assert (p.period, p.statistic, p.first, p.second) == ("encoder_future_diff_abs", "loc", "lat", "lon")
    assert one(spark, naming.file_token(F.lit("/x/rw_test_ct12_a.csv")), naming.without_unit(F.lit("Speed [km/h]")), naming.plain_markup(F.lit("a<sub>2</sub>"))) == ("ct12", "Speed", "a_{2}")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-500, 500), min_size=4, max_size=9, unique=True))
def test_monotone_cubic(values):
    v = np.sort(values)
    if np.diff(v).min() < 1e-3:
        return
    p = np.linspace(0.05, 0.95, len(v))
    d = D.MonotoneCubic(v, p)
    x = np.linspace(v[0], v[-1], 200)
    assert np.allclose(d.cdf(v), p) and (np.diff(d.cdf(x)) >= -1e-12).all()
    q = np.linspace(0.06, 0.94, 11)
    assert np.allclose(d.cdf(d.inverse(q)), q, atol=1e-6)


def test_harrell_davis():
    assert D.beta_cdf(np.array([0.0, 0.3, 1.0]), 2, 3) == pytest.approx([0, 1 - 0.7**4 - 4 * 0.3 * 0.7**3, 1])
    w = D.harrell_davis_weights(9, np.array([0.25, 0.5]))
    assert np.allclose(w.sum(1), 1) and np.allclose(w[1], w[1][::-1])
    s = D.SmoothedQuantiles(np.random.default_rng(0).normal(size=400), 20)
    assert abs(s.inverse(0.5)) < 0.2 and abs(D.highest_density_interval(s, 0.5)[1] - 0.67) < 0.4


def test_polygons():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2.0]])
    assert len(D.convex_hull(np.vstack([square, [[1, 1]]]))) == 4
    cut = D.clip_convex(square, np.array([[1, 1], [3, 1], [3, 3], [1, 3.0]]))
    assert {tuple(p) for p in cut} == {(1, 1), (2, 1), (2, 2), (1, 2)}


def test_mixture():
    m = D.Mixture(np.array([[1.0, 0, 0, 1, 1, 0]]))
    assert m.negative_log_likelihood(np.zeros(2)) == pytest.approx(math.log(2 * math.pi))
    assert m.confidence_of(np.array([0, math.sqrt(-2 * math.log(0.5))]), 4000) == pytest.approx(0.5, abs=0.04)
    assert m.energy_score(np.zeros(2)) < m.energy_score(np.array([3.0, 0]))
    assert D.area_on_sphere(m.hull(0.5)) < D.area_on_sphere(m.hull(0.9))


def test_region_areas_grow_with_confidence(spark):
    levels = [0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975]
    q = [-30.0, -20.0, -10.0, 0.0, 10.0, 20.0, 30.0]
    rows = spark.createDataFrame([(1, levels, q, [x / 2 for x in q], 1.0, 1.0), (2, levels, [5.0] * 7, q, 99.0, 0.0)], "id int, levels array<double>, qx array<double>, qy array<double>, x double, y double")
    for kind in ("hull", "contour"):
        out = {(r.id, r.confidence): r for r in regions.evaluate(rows, ["id"], kind=kind).collect()}
        assert out[1, 0.5].area < out[1, 0.9].area <= out[1, 0.95].area
        assert out[1, 0.9].covered == 1 and out[2, 0.95].covered == 0


def test_bootstrap_resamples_units(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(10, 2, 80)
    df = spark.createDataFrame([("m", int(i), float(v + e)) for i, v in enumerate(base) for e in (-1, 0, 1)], "model string, id int, v double")
    for method in ("bca", "percentile"):
        r = stats.bootstrap(df, "v", ["model"], "id", 2000, method=method).first()
        half = 1.96 * base.std() / math.sqrt(80)
        assert r["mean"] == pytest.approx(base.mean()) and r.units == 80
        assert r.hi - r.lo == pytest.approx(2 * half, rel=0.15)


def test_hurst():
    rng = np.random.default_rng(3)
    assert tracks.hurst(rng.normal(size=2000)) == pytest.approx(0.5, abs=0.1)
    assert tracks.hurst(np.cumsum(rng.normal(size=2000))) > 0.8
    assert math.isnan(tracks.hurst(np.arange(5.0)))


def test_p_values(spark):
    df = spark.createDataFrame([("a", 0.5, 30), ("b", 0.0, 30)], "name string, r double, n int")
    out = {r.name: r for r in stats.significance(stats.with_p_values(df)).collect()}
    assert out["a"].p == pytest.approx(0.0043, abs=3e-4) and out["a"].p_adjusted == pytest.approx(2 * out["a"].p)
    assert out["b"].p == pytest.approx(1) and out["a"].significant == "yes - corrected" and out["b"].significant == "no"


def test_selection_prefers_relevant_features(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=600), rng.normal(size=600)
    df = spark.createDataFrame([(float(a), float(a + 0.01 * c), float(b), float(a + b / 2)) for a, b, c in zip(x, z, rng.normal(size=600))], "x double, copy double, z double, y double")
    chosen = stats.select_features(df, ["x", "copy", "z"], "y", 2)
    assert chosen[0] in ("x", "copy") and chosen[1] == "z"


def test_readers(spark, tmp_path):
    (tmp_path / "data.csv").write_text("ID,DATE_TIME,LATITUDE,LONGITUDE,depth\na,2020-01-01 06:00:00,-50.5,10,NaN\na,2020-01-01 12:00:00,-51,11,3\n")
    (tmp_path / "meta.csv").write_text("ID,Species,Weight\na,seal,3.5\n")
    f = tables.read_fixes(spark, str(tmp_path / "data.csv"))
    assert [r.depth for r in f.orderBy("ts").collect()] == [None, 3]
    assert tables.read_metadata(spark, str(tmp_path / "meta.csv")).first().asDict() == {"id": "a", "species": "seal", "weight": 3.5}
    (tmp_path / "bad.csv").write_text("ID,LATITUDE\na,1\n")
    with pytest.raises(ValueError):
        tables.read_fixes(spark, str(tmp_path / "bad.csv"))
    folder = tmp_path / "models"
    folder.mkdir()
    (folder / "rw_test_ct1.csv").write_text("x\n1\n2\n")
    (folder / "rw_test_ct2.csv").write_text("x\n1\n")
    (folder / "rw_train_ct3.csv").write_text("x\n1\n2\n")
    files = tables.read_folder(spark, str(folder), "test")
    assert [r.file_id for r in tables.valid_ids(files).collect()] == ["ct1"]
    (tmp_path / "grid.txt").write_text("-5 4\n-7 -8\n")
    assert {(r.lat, r.lon, r.value) for r in tables.read_text_grid(spark, str(tmp_path / "grid.txt"), 90).collect()} == {(45, -135, -5), (45, -45, 0), (-45, -135, -7), (-45, -45, -8)}
    calls = []

    def make(n):
        calls.append(n)
        return spark.range(n)

    assert [tables.cached_table(make, spark, str(tmp_path / "cache"), n=3).count() for _ in range(2)] == [3, 3] and calls == [3]
    assert tables.cached_table(_three, spark, str(tmp_path / "cache")).count() == 3 == tables.cached_table(_three, spark, str(tmp_path / "cache"), n=3).count()
    assert len(list((tmp_path / "cache").iterdir())) == 2
    with pytest.raises(ValueError):
        tables.cached_table(lambda: spark.range(5), spark, str(tmp_path / "cache"))


def test_rules_keep_minimal_sets(spark):
    items = spark.createDataFrame([(["a", "t"],)] * 8 + [(["a", "b", "t"],)] * 8 + [(["c"],)] * 4, "items array<string>")
    out = {tuple(sorted(r.antecedent)) for r in stats.rules(items, "t", 0.1, 0.7).collect()}
    assert out == {("a",), ("b",)}


def test_naive_and_scaling(spark):
    b = spark.createDataFrame([("a", t, float(t)) for t in range(12)], "id string, time_idx int, v double")
    index = windows.forecast_index(b, 4, 2).where("start = 0")
    p = windows.window_points(index, b, ["v"], 4, 2, 3)
    assert [r.v for r in windows.naive_last(p, ["v"]).collect()] == [3]
    assert [r.v for r in windows.naive_line(p, ["v"], 2).orderBy("step").collect()] == pytest.approx([4, 5])
    s = windows.window_scale(p, ["v"])
    back = windows.denormalise(windows.normalise(p, s, ["v"]), s, ["v"])
    assert sorted(r.v for r in back.collect()) == pytest.approx(list(range(9)))
    assert windows.leaks(p, ["v"]).count() == 0


def test_asof_falls_back(spark):
    at = lambda *h: spark.createDataFrame([("a", float(x), float(x)) for x in h], "id string, h double, v double").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    out = {r.h: r.v_base for r in joins.asof(at(10, 30, 5).select("id", "h", "ts"), at(4, 8, 9, 10), ["v"], 6).collect()}
    assert out == {10: (4 + 8 + 9) / 3, 30: 10, 5: 4}


def test_reshape(spark):
    d = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "a", 3.0)], "k int, c string, v double")
    wide = reshape.pivot(d, ["k"], "c", ["a", "b"], "v")
    assert sorted(map(tuple, reshape.unpivot(wide, ["k"], ["a", "b"]).collect()), key=str) == sorted([(1, "a", 2.0), (1, "b", None), (2, "a", 3.0), (2, "b", None)], key=str)
    assert reshape.expand(spark.createDataFrame([(1, [5, 6])], "k int, x array<int>"), ["k"], "x").collect() == [(1, 0, 5), (1, 1, 6)]


def test_models_compared(spark):
    s = spark.createDataFrame([("a", 0.81234, 0.2), ("b", 0.81233, 0.1), ("c", 0.5, 0.0)], "model string, value double, std double")
    assert scoring.best_model(s).first().model == "b"


def test_split_and_folds(spark):
    d = spark.range(200).select((F.col("id") % 7).alias("id"), F.col("id").cast("int").alias("time_idx"), F.rand(1).alias("y"), F.col("id").alias("k"))
    assert {r.split: r["count"] for r in binning.split(d).groupBy("split").count().collect()} == {"train": 160, "val": 20, "test": 20}
    n = [r["count"] for r in stats.folds(d, "y", "k").groupBy("fold").count().collect()]
    assert len(n) == 5 and max(n) - min(n) <= 10


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", i * 3600 * 5, -50.0 + i, float(i)) for i in range(40)] + [("b", i * 3600 * 30, -40.0, 1.0) for i in range(9)] + [("z", 3600 * 24 * 400, 0.0, 0.0)]
    spark.createDataFrame(rows, "id string, s long, lat double, lon double").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    for f, name in ((stream_bins, "bins"), (lambda d: stream_chunks(d, "1 day"), "chunks")):
        q = f(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = {tuple(r) for r in f(batch).where("id <> 'z'").collect()}
        assert {tuple(r) for r in spark.table(name).where("id <> 'z'").collect()} == want and want


def test_plans_push_down_and_share_a_shuffle(spark):
    sf = "/root/testdata/sf0.001"
    from wakeline.sources.fixtures import fixes

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = tracks.with_speed(tracks.with_steps(fixes(spark, sf).where("value > 5"))).groupBy("id").agg(F.avg("speed").alias("v"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1
        assert "GreaterThan(value,5.0)" in plan and "event_type" not in plan.split("ReadSchema")[1].split("\n")[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_reference_areas_take_the_full_sample(spark):
    from wakeline.plans import catalog

    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(1).normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id string, ts int, dx double, dy double").withColumn("y", F.lit(0.0))
    steps = np.array([r[2:] for r in rows])
    picks = np.random.default_rng(0).integers(0, 300, (10000, 28))
    paths, side = steps[picks].cumsum(1), 1 - np.sqrt(0.95)
    lo, hi = np.quantile(paths, [side / 2, 1 - side / 2], axis=0)
    got = {r.time_step: r.area_ref for r in regions.reference_areas(df, 28, (0.05, 0.95)).where("confidence = 0.95").collect()}
    assert sorted(got) == list(range(28))
    for t in range(28):
        assert got[t] == pytest.approx(np.prod(hi[t] - lo[t]), rel=0.01)
    assert catalog.QUERIES["reference_area"](spark, "/root/testdata/sf0.001").agg(F.max("time_step")).first()[0] == 27


def test_region_hulls_have_the_true_area(spark):
    levels = np.linspace(0.001, 0.999, 201)
    q = D.normal_ppf(levels) * 100
    row = [(1, levels.tolist(), q.tolist(), q.tolist(), 0.0, 0.0)]
    df = spark.createDataFrame(row, "id long, levels array<double>, qx array<double>, qy array<double>, x double, y double")
    for r in regions.evaluate(df, ["id"], (0.5, 0.9)).collect():
        assert r.area == pytest.approx(-2 * math.pi * 100**2 * math.log(1 - r.confidence), rel=0.04)
    p = np.random.default_rng(4).normal(size=(20000, 2)) * [3, 0.01]
    assert {tuple(v) for v in D.convex_hull(p)} == {tuple(v) for part in (D.convex_hull(np.vstack([D.convex_hull(x) for x in np.array_split(p, 25)])),) for v in part}


def test_long_tracks_take_linear_time(spark):
    n = 400_000
    one = spark.range(n).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("time_idx"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.when(F.col("id") % 50 == 7, F.col("id").cast("double")).alias("v"), F.rand(1).alias("k"), F.rand(2).alias("dt"))
    began = time.time()
    assert tracks.fill_both_ways(one, ["v"]).where("v is null").count() == 0
    assert tracks.replace_zero_dt(one, "closest", 0.5).where("dt < 0.5").count() == 0
    assert stats.rolling_correlation(one, "k", "dt", 3).where("rho is null").count() == 0
    index = windows.forecast_index(one, 16, 4)
    assert windows.with_gaps(index, one).where("decoder_gap = 0").count() == n - 19
    assert time.time() - began < 60


def test_adjusted_p_values_with_ties(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(3000) ** 3, np.repeat([0.2, 1.0], 700)])
    n = len(p)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * n / np.arange(1, n + 1))[::-1])[::-1]
    want = np.empty(n)
    want[order] = np.minimum(q, 1)
    df = spark.createDataFrame(list(enumerate(p.tolist())), "i int, p double").repartition(7)
    got = {r.i: r.p_adjusted for r in stats.benjamini_hochberg(df, ranges=16).collect()}
    assert np.allclose([got[i] for i in range(n)], want)


def test_folds_are_even(spark):
    out = stats.folds(spark.range(10007).withColumn("v", F.rand(3)), "v", "id", 5, 10).groupBy("fold").count().collect()
    assert len(out) == 5 and max(r["count"] for r in out) - min(r["count"] for r in out) <= 10
    few = spark.range(500).withColumn("v", F.col("id") * 1.0)  # approximate quantiles of few rows are exact
    fold_of = lambda d: {r.id: r.fold for r in stats.folds(d, "v", "id").collect()}
    assert fold_of(few) == fold_of(few.repartition(13))


def test_bootstrap_acceleration_is_that_of_leaving_one_out(spark):
    v = np.random.default_rng(5).exponential(size=60)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [(None, i, float(x)) for i, x in enumerate(v)], "g string, id int, v double")
    rows = stats.bootstrap(df, "v", ["g"], "id", 20000).collect()
    left = (v.sum() - v) / (len(v) - 1)
    d = left.mean() - left
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    rng = np.random.default_rng(0)
    draws = v[rng.integers(0, 60, (20000, 60))].mean(1)
    z0 = NormalDist().inv_cdf((draws < v.mean()).mean())
    q = [NormalDist().cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (-1.96, 1.96)]
    lo, hi = np.quantile(draws, q)
    assert len(rows) == 2
    for r in rows:
        assert r.lo == pytest.approx(lo, abs=0.03) and r.hi == pytest.approx(hi, abs=0.03) and r.units == 60


def test_leap_segments(spark):
    df = spark.createDataFrame([(1, f"{y}-06-01 00:00:00") for y in (2019, 2020, 2021)], "id int, t string").select("id", F.to_timestamp("t").alias("ts"))
    flags = lambda **k: [r.leap for r in tracks.leap_segments(df, **k).orderBy("ts").collect()]
    assert flags() == [False, True, False] and flags(compat=True) == [False, False, True]


def test_rings_of_lines():
    t = np.linspace(0, 2 * np.pi, 41)[:-1]
    circle = np.stack([np.cos(t), np.sin(t)], 1)
    parts = np.split(circle, [7, 11, 25, 33])
    ring = D.ring_of_lines([parts[i] for i in (2, 0, 4, 1, 3)])
    assert len(ring) == 41 and (ring[0] == ring[-1]).all()
    assert np.hypot(*np.diff(ring, axis=0).T).max() == pytest.approx(2 * np.sin(np.pi / 40))
    assert len(D.ring_of_lines([circle[:3]])) == 4


def test_names_with_future():
    assert naming.with_future(["sex"], ["future_season", "moon"], {"moon": ["moon_a", "moon_b"]}) == ["sex", "future_season", "moon_a", "moon_b"]
    levels = naming.levels_with_future({"season": ["winter", None], "sex": ["f", "m"]}, ["future_season"])
    assert levels["future_season"] == ["winter", None]
    assert naming.may_be_missing(levels) == ["season", "future_season"]


def test_random_lengths_follow_beta(spark):
    index = spark.range(20000).selectExpr("id", "0 AS start", "19 AS encoder_end", "23 AS decoder_end")
    got = windows.random_lengths(index, 20, 5, 0.5, 0.5).selectExpr("encoder_end - start + 1 AS n").groupBy("n").count().collect()
    share = {r.n: r["count"] / 20000 for r in got}
    want = np.diff([0, *(2 / np.pi * np.arcsin(np.sqrt((np.arange(15) + 0.5) / 15))), 1])
    assert sum(share.values()) == pytest.approx(1) and all(share[5 + j] == pytest.approx(want[j], abs=0.012) for j in range(16))


def test_columns_side_by_side_have_names_of_their_own(spark):
    df = spark.range(3).withColumn("v", F.lit(1))
    with pytest.raises(ValueError):
        joins.side_by_side(df, df, "id")


def test_reanchored_tracks_keep_their_steps(spark):
    fixes = spark.createDataFrame([("a", i, 40 * math.sin(i), 50 * math.cos(2 * i)) for i in range(30)], "id string, ts int, lat double, lon double")
    own, new = ([(math.radians(r.lat), math.radians(r.lon)) for r in sorted(d.collect(), key=lambda r: r.ts)] for d in (fixes, tracks.reanchor(fixes)))
    far = lambda p, q: math.acos(max(-1, min(1, math.sin(p[0]) * math.sin(q[0]) + math.cos(p[0]) * math.cos(q[0]) * math.cos(p[1] - q[1]))))
    assert new[0] == (0, 0)
    assert [far(*z) for z in zip(new, new[1:])] == pytest.approx([far(*z) for z in zip(own, own[1:])], abs=1e-6)
    turn = lambda p, q: math.atan2(math.cos(q[0]) * math.sin(q[1] - p[1]), math.cos(p[0]) * math.sin(q[0]) - math.sin(p[0]) * math.cos(q[0]) * math.cos(q[1] - p[1]))
    assert [math.cos(turn(*z)) for z in zip(new, new[1:])] == pytest.approx([math.cos(turn(*z)) for z in zip(own, own[1:])], abs=1e-6)


def _three(n=3):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().range(n)


def test_batches_are_even_and_repeatable(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, int(n)) for i, n in enumerate(np.minimum(rng.geometric(0.02, 5000), 400))]  # a third or more in a few buckets
    df = spark.createDataFrame(rows, "id int, n int")
    out = tables.batch_table(df.repartition(7), ["id"], "n", 32, 16, 1)
    got = out.collect()
    assert sorted((r.id, r.n) for r in got) == sorted(rows)
    assert {tuple(r) for r in got} == {tuple(r) for r in tables.batch_table(df.repartition(3), ["id"], "n", 32, 16, 1).collect()}
    assert {tuple(r) for r in got} != {tuple(r) for r in tables.batch_table(df, ["id"], "n", 32, 16, 2).collect()}
    by = {}
    for r in got:
        by.setdefault((r.bucket, r.batch), []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own))) and max(r.n for r in own) - min(r.n for r in own) < 16
    for bucket in {b for b, _ in by}:
        sizes = [len(by[k]) for k in sorted(k for k in by if k[0] == bucket)]
        assert set(sizes[:-1]) <= {32} and 0 < sizes[-1] <= 32
    tables.write_batches(out, str(tmp_path / "b"), 4)
    back = tables.read_batches(spark, str(tmp_path / "b"))
    assert back.count() == 5000
    seen = [set(map(tuple, tables.read_batches(spark, str(tmp_path / "b"), [k]).select("bucket", "batch").collect())) for k in range(4)]
    assert sum(map(len, seen)) == len(by) == len(set().union(*seen))  # no batch is in two folders
    order = [(r.bucket, r.batch) for r in spark.read.parquet(str(tmp_path / "b" / "shard=1")).collect()]
    assert sum(a != b for a, b in zip(order, order[1:])) == len(set(order)) - 1  # a batch's rows follow each other
    assert tables.batch_table(df.limit(0), ["id"], "n").count() == 0


def test_raster_in_tiles_against_a_plain_lookup(spark, tmp_path):
    from wakeline.operators import grids

    rng = np.random.default_rng(2)
    raster = np.round(rng.normal(-2000, 900, (36, 72)), 3)  # five degrees, north first
    (tmp_path / "depth.txt").write_text("\n".join(" ".join(map(str, row)) for row in raster) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # several blocks
    try:
        grid = tables.read_text_grid(spark, str(tmp_path / "depth.txt"), 5.0)
        assert grid.rdd.getNumPartitions() > 1 or grid.count() == 36 * 72
        flat = np.minimum(raster, 0.0)
        assert {(r.lat, r.lon): r.value for r in grid.collect()} == {(90 - (i + 0.5) * 5, -180 + (j + 0.5) * 5): flat[i, j] for i in range(36) for j in range(72)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    south = flat[::-1]
    p = np.concatenate([rng.uniform([-90, -180], [90, 180], (300, 2)), [[90, 0], [-90, 180], [0, 179.9], [0, -179.9], [2.5, 2.5], [89.9, 177.6]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(-1, None, 1.0)], "n int, lat double, lon double")
    for size in (4, 7, 64):
        cut = grids.tiles(grid, 5.0, size)
        got = {how: {r.n: r.d for r in grids.value_at(df, cut, 5.0, "d", size, how).collect()} for how in ("nearest", "bilinear")}
        for n, (lat, lon) in enumerate(p):
            y, x = min(max((lat + 90) / 5 - 0.5, 0), 35), ((lon + 180) / 5 - 0.5) % 72
            i, j = min(int(y), 34), int(x)
            a, b, k = y - i, x - j, (j + 1) % 72
            want = (south[i, j] * (1 - b) + south[i, k] * b) * (1 - a) + (south[i + 1, j] * (1 - b) + south[i + 1, k] * b) * a
            assert got["bilinear"][n] == pytest.approx(want, abs=1e-6), (size, lat, lon)
            assert got["nearest"][n] == south[i + (a >= 0.5), k if b >= 0.5 else j]
        assert got["bilinear"][-1] is None
    part = grids.tiles(grid.where("lat > 0"), 5.0, 8)
    out = {r.n: r.d for r in grids.value_at(df, part, 5.0, "d", 8).collect()}
    assert all(out[n] is None for n, (lat, _) in enumerate(p) if lat < -5) and all(out[n] is not None for n, (lat, _) in enumerate(p) if lat > 5)


def test_nearest_grid_takes_the_middle_of_a_cell(spark):
    rows = [(0.0, lat, v) for lat, v in ((10.1, 1.0), (10.02, 2.0), (9.9, 3.0))] + [(900.0, 10.02, 9.0), (0.0, 10.0, None)]
    grid = spark.createDataFrame([(s, lat, 20.0, v) for s, lat, v in rows], "s double, lat double, lon double, value double").withColumn("ts", F.timestamp_seconds("s"))
    fix = spark.createDataFrame([(100.0, 10.05, 20.1)], "s double, lat double, lon double").withColumn("ts", F.timestamp_seconds("s"))
    for parts in (1, 4):
        assert joins.nearest_grid(fix, grid.repartition(parts)).first().value == 2.0


def test_encoder_hurst_and_frames_against_single_windows(spark):
    rng = np.random.default_rng(11)
    rows = [(k, int(t), float(v), float(v * 3 % 80), float(v * 7 % 170)) for k in (1, 2) for t, v in enumerate(np.cumsum(rng.normal(size=60))) if t % 9 != 4]
    b = spark.createDataFrame(rows, "id int, time_idx int, v double, lat double, lon double")
    index = windows.forecast_index(b, 20, 4)
    points = windows.window_points(index, b, ["v", "lat", "lon"], 20, 4)
    got = {(r.id, r.start): r.hurst for r in windows.encoder_hurst(index, b, "v", 20).collect()}
    for (i, start), own in points.where("role = 'encoder'").toPandas().sort_values("time_idx").groupby(["id", "start"]):
        assert got[i, start] == pytest.approx(tracks.hurst(own["v"].to_numpy()), nan_ok=True)
    shapes = {(r.id, r.start): r for r in windows.encoder_shapes(index, b, "lon", "lat", 20).collect()}
    for r in tracks.shape(points.where("role = 'encoder'"), ["id", "start"], "time_idx", "lon", "lat").collect():
        own = shapes[r.id, r.start]
        for name in ("net_x", "net_y", "path_x", "path_y", "direction", "turning"):
            assert own[name] == pytest.approx(r[name], abs=1e-9), name
    for frames, joined in ((windows.encoder_scales(index, b, ["v"], 20), windows.window_scale(points, ["v"])), (windows.last_values(index, b, ["v"], 20), windows.naive_last(points, ["v"]))):
        cols = joined.columns
        key = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(cols).collect())  # noqa: E731, B023
        assert key(frames) == key(joined)
    new = {(r.id, r.start): r for r in windows.window_features(index, b, "v", 20, 4).collect()}
    for r in windows.window_table(points, "v").collect():
        for name in ("net", "path", "missing", "mae", "worst", "gap", "mean_gap"):
            assert new[r.id, r.start][name] == pytest.approx(r[name], abs=1e-9), name
    table = windows.error_table(index, b, "v", b.select("id", "time_idx", (F.col("v") - 1).alias("lo"), F.col("v").alias("median"), (F.col("v") + 3).alias("hi"), F.col("v").alias("actual")), 20, 4)
    first = table.first()
    assert table.count() == index.count() and (first.length, first.covered, first.asymmetry, first.right_tail) == (4, 1, 3, 1)


def test_scaled_windows_take_covariates_and_unseen_labels(spark):
    b = spark.createDataFrame([(i, t, float(t * i)) for i in (1, 2) for t in range(40)] + [(3, t, 5.0) for t in range(33, 40)], "id int, time_idx int, v double")
    m = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (3, "z", 3.0)], "id int, kind string, w double")
    weather = spark.createDataFrame([(1, t, t / 2) for t in range(40)], "id int, time_idx int, rain double")
    out = datasets.load_scaled(b, m, ["v"], 4, 2, ["kind"], weather, minima={"train": 0}).collect()
    assert {(r.id, r.kind) for r in out} == {(1, 2), (2, 1), (3, 0)}  # z is in no training window
    assert {r.v for r in out if r.id == 3} == {None} and all(r.rain == r.time_idx / 2 for r in out if r.id == 1) and {r.rain for r in out if r.id == 2} == {None}
    sd = np.std(np.arange(4), ddof=1)
    assert all(r.v == pytest.approx((r.time_idx - r.start - 1.5) / sd) for r in out if r.id in (1, 2))
    plain = datasets.load_scaled(b, m, ["v"], 4, 2, minima={"train": 0}, scaled=False).where("id = 2").first()
    assert plain.v == 2 * plain.time_idx


def test_states_in_every_coordinate_system(spark):
    import datetime as dt
    import math

    from wakeline.functions import spatial
    from wakeline.sources import datasets

    at = lambda h: dt.datetime(2020, 3, 1) + dt.timedelta(hours=h)
    places = [(-50.0, 179.0), (-50.5, 179.8), (-51.0, -179.6), (-51.0, -179.6), (-52.0, -178.0), (-52.2, -177.0), (-52.1, -177.5)]
    fixes = spark.createDataFrame([(1, at(6 * i), a, b, float(i)) for i, (a, b) in enumerate(places)], "id long, ts timestamp, lat double, lon double, wind0 double")
    meta = spark.createDataFrame([(1, "seal", 3.0)], "id long, species string, weight double")
    grid = fixes.select("lat", "lon", "ts", F.col("wind0").alias("wind"), (F.col("wind0") * 2).alias("wave"))

    def states(system, **options):
        own = datasets.load_states(fixes, meta, system, velocity="components", weather=grid, weather_columns=["wind", "wave"], cell=0.1, static=["species"], **options)
        return own.orderBy("time_idx").collect()

    def step(a, b):  # north and east of b seen from a, by bearing and angle
        (la, lo), (lb, lp) = ([math.radians(v) for v in z] for z in (a, b))
        north, east = math.sin(lb) * math.cos(la) - math.cos(lb) * math.sin(la) * math.cos(lp - lo), math.cos(lb) * math.sin(lp - lo)
        angle = math.acos(min(1.0, math.sin(la) * math.sin(lb) + math.cos(la) * math.cos(lb) * math.cos(lp - lo)))
        bearing = math.atan2(east, north)
        return (angle * math.cos(bearing), angle * math.sin(bearing)) if a != b else (0.0, 0.0)

    centre = tuple(sum(z) / len(z) for z in zip(*places))
    near = lambda got, want: math.isclose(got, want, abs_tol=1e-6)
    v = [[c * 4 for c in step(a, b)] for a, b in zip(places, places[1:])]
    v.append([sum(z) / len(z) for z in zip(*v)])
    for rows in (states("spherical"), states("spherical", delta=None)):
        assert {z.species for z in rows} == {"seal"} and [(z.wind, z.wave) for z in rows] == [(i, 2 * i) for i in range(7)]
        summed = [(0.0, 0.0)]
        for a, b in zip([centre, *places], places):
            n, e = step(a, b)
            summed.append((summed[-1][0] - n, summed[-1][1] + e))
        assert all(near(z.sn, w[0]) and near(z.we, w[1]) for z, w in zip(rows, summed[1:]))
        assert all(near(z.v_sn, w[0]) and near(z.v_we, w[1]) and near(z.dt, 0.25) for z, w in zip(rows, v))
    for z, p in zip(states("spherical-ref-point"), places):
        n, e = step(centre, p)
        assert near(z.sn, -n) and near(z.we, e)
    moved = states("spherical-dx")
    assert (moved[0].dlat, moved[0].dlon) == (0, 0) and near(moved[3].dlat, 0) and near(moved[3].dlon, 0)
    assert all(near(z.x, math.cos(math.radians(a)) * math.cos(math.radians(b))) and near(z.z, math.sin(math.radians(a))) for z, (a, b) in zip(moved, places))
    # The increment's angle is that of the step, whatever the frame.
    assert all(near(math.cos(math.radians(z.dlat)) * math.cos(math.radians(z.dlon)), math.cos(math.hypot(*step(a, b)))) for z, a, b in zip(moved[1:], places, places[1:]))
    assert len(states("mercator", bins=1460)) == 7
    with pytest.raises(ValueError):
        datasets.coordinates(fixes, "polar")
    with pytest.raises(ValueError):
        datasets.steps_ahead(fixes, "squared")
    ends = fixes.limit(1).select(*spatial.step_between(F.lit(0.1), F.lit(0.2), F.lit(0.1), F.lit(0.2)), spatial.step_between(F.lit(0.1), F.lit(0.2), F.lit(None).cast("double"), F.lit(0.2))[0]).first()
    assert tuple(ends) == (0.0, 0.0, None)
    assert datasets.flat(fixes, ["wind0"]).columns == ["id", "lat", "lon", "day", "year", "wind0"]


def test_rules_without_conditions_that_add_nothing(spark):
    rng = np.random.default_rng(3)
    sets = {tuple(sorted(rng.choice(list("abcdefgh"), rng.integers(1, 6), False))) for _ in range(60)}
    own = spark.createDataFrame([(list(z), float(i)) for i, z in enumerate(sorted(sets))], "antecedent array<string>, confidence double")
    want = {z for z in sets if not any(set(y) < set(z) for y in sets)}
    assert {tuple(z.antecedent) for z in stats.simplest(own).collect()} == want
    assert stats.simplest(own.limit(0)).count() == 0


def test_prune_by_number_of_tracks(spark):
    fixes = spark.sql("SELECT id, timestamp_seconds(i * 86400) AS ts, 1.0D AS lat, 2.0D AS lon FROM range(1, 7) t(id), range(10) s(i)")
    meta = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'a'), (3L, 'a'), (4L, 'b'), (5L, 'b'), (6L, NULL) t(id, species)")
    ids = lambda *args, **options: {z.id for z in tracks.prune(fixes, meta, None, 5, 2, *args, **options).select("id").distinct().collect()}
    assert (ids(0), ids(2), ids(3), ids(4)) == ({1, 2, 3, 4, 5}, {1, 2, 3, 4, 5}, {1, 2, 3}, set())
    assert ids(3, null_as="b") == {1, 2, 3, 4, 5, 6} and ids(3, apply=lambda d: d.withColumn("species", F.lit("c"))) == {1, 2, 3, 4, 5, 6}
    plan = tracks.prune(fixes, meta, None, 5, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [species" in plan


def test_observed_steps_are_counts_of_rows(spark):
    """Of all windows, as frames, without a row for each of their steps."""
    from wakeline.operators import windows

    have = [0, 1, 2, 5, 6, 9, 10, 11, 15, 16]
    df = spark.createDataFrame([(1, t, 0.5) for t in have] + [(2, 0, 1.0)], "id int, time_idx int, value double")
    got = {r.start: (r.encoder, r.decoder) for r in windows.observed_steps(df, 4, 3).collect()}
    assert got == {s: (sum(s <= t < s + 4 for t in have), sum(s + 4 <= t < s + 7 for t in have)) for s in have if s + 6 <= 16}


def test_reanchored_tracks_over_many_batches(spark):
    """What is carried over from batch to batch is the last place: short batches give what long ones do."""
    from wakeline.operators import tracks

    df = spark.range(60).selectExpr("id % 3 as id", "timestamp_seconds(id * 100) as ts", "id as event_id", "(id * 7) % 50 - 20.0D as lat", "(id * 31) % 300 - 150.0D as lon")
    whole = {r.event_id: (r.lat, r.lon) for r in tracks.reanchor(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        short = {r.event_id: (r.lat, r.lon) for r in tracks.reanchor(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == short and [whole[k] for k in range(3)] == [(0.0, 0.0)] * 3
    plan = tracks.reanchor(df)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
