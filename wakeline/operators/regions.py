"""Two-dimensional prediction regions of each (animal, step), by grouped Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import contours as C
from wakeline.functions import distributions as D
from wakeline.functions import scores, spatial


def quantile_arrays(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key with the sorted levels and quantiles of both axes and the actual point; an axis with itself is gathered once."""
    def side(d, n):
        own = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("quantile", "prediction"))).alias("q"), F.max("actual").alias(f"{n}"))
        return own.select(*keys, n, F.transform("q", lambda s: s["quantile"]).alias("levels"), F.transform("q", lambda s: s["prediction"]).alias(f"q{n}"))

    if y is x:
        return side(x, "x").withColumns({"qy": F.col("qx"), "y": F.col("x")})
    return side(x, "x").join(side(y, "y").drop("levels"), list(keys))


RINGS = "array<struct<part:int,hole:boolean,ring:array<struct<x:double,y:double>>>>"


def spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt out whatever their size: a row is work of some milliseconds and a few hundred bytes, which size-based partitions would put in one task.

    By a hash of the keys, as an exchange by the keys themselves would be taken for one that is there already and dropped."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*keys))


def evaluate(rows: DataFrame, keys: Sequence[str], confidences: Sequence[float] = scores.CONFIDENCES, kind: str = "hull", rho: float = 0.0, samples: int = 100000, grid: int = 120, rings: bool = True) -> DataFrame:
    """area (km2), covered, parts, holes and, if asked for, rings of every key and confidence.

    Rows hold levels, qx, qy, x and y. Rows are worked on in Arrow batches, and only rows are shuffled. A `hull` is that of the
    densest part of `samples` points of equal mass; a `contour` is traced on a grid of the density, with parts and holes; an
    `alpha` shape is that of the densest of 500 drawn points. A level past the largest sampled one widens a hull by what is
    missing. A point is covered if it lies in an exterior and in no hole.

    A region moves with its quantiles, so it is made once for all rows of a task whose quantiles lie alike about their own place, and moved to each.
    """
    own = spread(rows.select(*keys, "levels", "qx", "qy", "x", "y"), keys)

    def regions(dist):
        tops = [min(c, 0.99) for c in confidences]
        if kind == "hull":
            for c, top, ring in zip(confidences, tops, dist.hulls(tops, samples)):
                centre = ring.mean(0)
                yield [(0, False, centre + (ring - centre) * (1 + c - top))]
        elif kind == "contour":
            x, y = (np.linspace(d.x[0], d.x[-1], grid) for d in (dist.x, dist.y))
            z = np.outer(dist.x.pdf(x), dist.y.pdf(y)) if not dist.rho else dist.pdf(np.stack(np.meshgrid(x, y, indexing="ij"), -1).reshape(-1, 2)).reshape(grid, grid)
            for level in dist.levels(confidences, samples):
                yield C.level_region(z, x, y, level)
        else:
            drawn = dist.sample(500)
            drawn = drawn[np.argsort(-dist.pdf(drawn), kind="stable")]
            for c in confidences:
                yield C.alpha_region(drawn[: max(3, int(c * len(drawn)))])

    def work(frames):
        @lru_cache(maxsize=64)
        def shape(levels, qx, qy):
            return list(regions(D.Bivariate(np.frombuffer(qx), np.frombuffer(qy), np.frombuffer(levels), rho)))

        for f in _pieces(frames, PIECE if rings else 1024):
            out = []
            for at, levels, qx, qy in _alike(f):
                place = f[list(keys)].iloc[at]
                moved = np.stack([v[len(v) // 2] for n in ("qx", "qy") for v in f[n].iloc[at]]).reshape(2, -1).T
                point = f[["x", "y"]].iloc[at].to_numpy(float) - moved
                for c, region in zip(confidences, shape(levels, qx, qy)):
                    holes = sum(hole for _, hole, _ in region)
                    own = place.assign(confidence=float(c), area=C.region_areas(region, moved[:, 1]), covered=C.in_region(point, region).astype(int), parts=len(region) - holes, holes=holes)
                    out.append(own.assign(rings=[_as_rows([(part, hole, ring + by) for part, hole, ring in region]) for by in moved]) if rings else own)
            yield pd.concat(out)

    return own.mapInPandas(work, _region_kinds(own, keys, rings))


def _alike(f: pd.DataFrame):
    """Which rows share their levels and their quantiles about the middle one, and those, as bytes. Quantiles are alike to 2^-40 of their spread: their own places round them by more than nothing."""
    for _, at in f["levels"].map(len).pipe(lambda n: n.groupby(n).indices).items():
        wide = [np.stack(f["levels"].iloc[at].to_list()).astype(float)]
        for n in ("qx", "qy"):
            q = np.stack(f[n].iloc[at].to_list()).astype(float)
            q = q - q[:, [q.shape[1] // 2]]
            size = np.ptp(q, axis=1, keepdims=True)
            unit = np.exp2(np.floor(np.log2(np.where(size > 0, size, 1.0))) - 40)
            wide.append(np.rint(q / unit) * unit + 0.0)
        wide, k = np.concatenate(wide, 1), wide[0].shape[1]
        for row, own in pd.Series([v.tobytes() for v in wide]).pipe(lambda v: v.groupby(v, sort=False).indices).items():
            yield at[own], *(row[8 * i * k : 8 * (i + 1) * k] for i in range(3))


#: Rows of an Arrow batch that are worked on before their results are handed on: a row's rings may be some hundred KB of Python objects.
PIECE = 64


def _pieces(frames, piece: int = PIECE):
    """Batches of rows cut into short ones, so that a task holds the results of few rows at a time."""
    for f in frames:
        for at in range(0, len(f), piece):
            yield f.iloc[at : at + piece]


def _as_rows(region) -> list[dict]:
    return [{"part": part, "hole": hole, "ring": [{"x": a, "y": b} for a, b in np.asarray(ring, float).tolist()]} for part, hole, ring in region]


def _regions(own: DataFrame, keys: Sequence[str], regions, more: Sequence[str] = (), rings: bool = True) -> DataFrame:
    """area, covered, parts, holes and rings of what `regions` yields for each row, and the numbers that it yields besides, named by `more`."""

    def work(frames):
        for f in _pieces(frames):
            out = []
            for row in f.itertuples(index=False):
                point = np.array([[row.x, row.y]], float)
                for c, region, *besides in regions(row):
                    holes = sum(hole for _, hole, _ in region)
                    out.append([*row[: len(keys)], float(c), C.region_area(region), int(C.in_region(point, region)[0]), len(region) - holes, holes, *([_as_rows(region)] * rings), *besides])
            yield pd.DataFrame(out, columns=[*keys, "confidence", "area", "covered", "parts", "holes", *["rings"] * rings, *more])

    return own.mapInPandas(work, _region_kinds(own, keys, rings, more))


def _region_kinds(own: DataFrame, keys: Sequence[str], rings: bool, more: Sequence[str] = ()) -> str:
    return ", ".join([*(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys), "confidence double, area double, covered int, parts int, holes int", *[f"rings {RINGS}"] * rings, *(f"{m} double" for m in more)])


def mixture_regions(rows: DataFrame, keys: Sequence[str], confidences: Sequence[float] = scores.CONFIDENCES, grid: int = 160, rings: bool = True) -> DataFrame:
    """area, covered, parts, holes and, if asked for, rings of Gaussian mixtures, and `mass`, that of the part denser than the point.

    Rows hold parts, an array of (weight, mx, my, l11, l22, l21) with the factor's diagonal positive, and the point x, y. The density is
    taken on a grid four deviations about all parts; its levels are those that hold each share of the grid's mass.
    """
    own = spread(rows.select(*keys, "parts", "x", "y"), keys)

    def regions(row):
        parts = np.array([[p[c] for c in ("weight", "mx", "my", "l11", "l22", "l21")] for p in row.parts], float)
        dist = D.Mixture(parts)
        wide = 4 * np.stack([parts[:, 3], np.hypot(parts[:, 4], parts[:, 5])], 1)
        x, y = (np.linspace((parts[:, 1 + k] - wide[:, k]).min(), (parts[:, 1 + k] + wide[:, k]).max(), grid) for k in range(2))
        z = dist.pdf(np.stack(np.meshgrid(x, y, indexing="ij"), -1).reshape(-1, 2)).reshape(grid, grid)
        mass = float(z[z > dist.pdf(np.array([[row.x, row.y]], float))[0]].sum() / z.sum())
        for c in confidences:
            yield c, C.level_region(z, x, y, C.mass_level(z, x, y, c)), mass

    return _regions(own, keys, regions, ["mass"], rings)


#: Keys of up to that many points are worked on as one row, those of more in tiles; and points of a tile at the start.
WHOLE, TILE = 2000, 500


def alpha_shapes(points: DataFrame, key: str, x: str, y: str, radius: float | None = None, whole: int = WHOLE) -> DataFrame:
    """rings, area (km2), how many points there were, and how many were kept as corners, of the alpha shape of all points of each key in the Mercator plane.

    Keys of up to `whole` points are a row each; no task holds all points of a larger one (`_tiled_edges`), whose shape is the same.
    """
    finite = lambda c: F.abs(F.col(c)) < math.inf
    own = points.where(finite(x) & finite(y)).select(key, F.col(x).alias("x"), F.col(y).alias("y"))
    sizes = own.groupBy(key).agg(F.count("*").alias("points"))
    large = sizes.where(F.col("points") > whole)
    kinds = f"{key} {own.schema[key].dataType.simpleString()}, rings {RINGS}, area double, points long, kept int"

    def shapes(make):
        def work(frames):
            for f in _pieces(frames):
                out = []
                for row in f.itertuples(index=False):
                    region = make(row)
                    out.append([row[0], _as_rows(region), C.region_area(region), row.points, len({tuple(v) for _, _, ring in region for v in ring.tolist()})])
                yield pd.DataFrame(out, columns=[key, "rings", "area", "points", "kept"])

        return work

    place = lambda v, names: np.array([[p[n] for n in names] for p in v], float).reshape(-1, len(names))
    some = not large.isEmpty()
    few = own.join(large, key, "left_anti") if some else own
    lists = spread(few.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("p"), F.count("*").alias("points")), [key])
    out = lists.mapInPandas(shapes(lambda row: C.alpha_region(place(row.p, "xy"), radius)), kinds)
    if not some:
        return out
    edges = _tiled_edges(own.join(large.select(key), key), key, radius)
    sides = edges.groupBy(key).agg(F.collect_list(F.struct("x", "y", "x1", "y1")).alias("e"))
    rows = spread(large.join(sides, key, "left").select(key, "points", F.coalesce("e", F.array().cast("array<struct<x:double,y:double,x1:double,y1:double>>")).alias("e")), [key])

    def traced(row):
        e = place(row.e, ("x", "y", "x1", "y1"))
        return C.region_of_edges(e[:, :2], e[:, 2:])

    return out.unionByName(rows.mapInPandas(shapes(traced), kinds))


def _tiled(state: DataFrame) -> DataFrame:
    """Points in the tile, four radii `r` wide, that is their own and in those that begin within two radii. Places are x / sx and y / sy."""
    at = lambda c, by: F.floor((F.col(c) / F.col(f"s{c}") + by * F.col("r")) / (4 * F.col("r")))
    near = lambda c: F.explode(F.sequence(at(c, -2.001), at(c, 2.001)))
    own = state.withColumn("_i", near("x")).withColumn("_j", near("y"))
    return own.withColumn("core", (F.col("_i") == at("x", 0.0)) & (F.col("_j") == at("y", 0.0)))


def _tiled_edges(own: DataFrame, key: str, radius: float | None) -> DataFrame:
    """The directed edges (x, y, x1, y1) about the alpha shape of each key's points, by tiles of the plane.

    What a circle of radius r through a point meets lies within 2 r of it, so a tile and its rim tell every triangle of up to r at its points. r doubles until each point is a
    corner of one. On the way a point may go that no empty circle of r touches even beside only the points of its own cell, a cell being less than r across: an
    empty circle of r or more about the points that stay is one about all (a circle that holds a point of the cell can be moved off it, away from a point of the
    cell that it does not hold, and the last one it leaves is touched). So triangles over r, and the edges of shapes of r or more, are those of all points, while tiles stay small.
    """
    box = own.groupBy(key).agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))], F.min(F.struct("x", "y")).alias("_a"), F.max(F.struct("x", "y")).alias("_b"), F.count("*").alias("_n"))
    wide = lambda c: F.col(f"_hi{c}") - F.col(f"_lo{c}")
    box = box.where((wide("x") > 0) & (wide("y") > 0)).withColumns({"sx": wide("x"), "sy": wide("y")})
    off = lambda c, p: (F.col(f"{p}.{c}" if p else c) - F.col(f"_a.{c}")) / F.col(f"s{c}")
    flat = own.join(box, key).groupBy(key).agg(F.max(F.abs(off("x", "_b") * off("y", "") - off("y", "_b") * off("x", ""))).alias("_far"))
    box = box.join(flat.where("_far > 1e-12").select(key), key)
    state = own.distinct().join(box.select(key, "sx", "sy", F.pow(F.lit(2.0), F.floor(F.log2(F.sqrt(TILE / 16.0 / F.col("_n"))))).alias("r")), key).localCheckpoint()
    while True:  # radii at whose start no tile is too full, eight at a time
        level = state.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("_r", F.col("r") * F.pow(F.lit(2.0), -F.col("_l")))
        full = level.groupBy(key, "_l", *[F.floor(F.col(c) / F.col(f"s{c}") / (4 * F.col("_r"))).alias(f"_{c}") for c in "xy"]).agg(F.count("*").alias("_n")).groupBy(key, "_l").agg(F.max("_n").alias("_n"))
        best = full.groupBy(key).agg(F.min(F.when(F.col("_n") <= 2 * TILE, F.col("_l"))).alias("_l"))
        state = state.join(best, key).withColumn("r", F.col("r") * F.pow(F.lit(2.0), -F.coalesce("_l", F.lit(8)))).localCheckpoint()
        if state.where("_l is null and r > 1e-12").isEmpty():
            break
        state = state.drop("_l")
    state = state.select(key, "x", "y", "sx", "sy", "r", F.lit(None).cast("double").alias("g"), F.lit(None).cast("double").alias("top"))
    columns, done = [key, "x", "y", "sx", "sy", "r", "g", "top"], []
    if radius is not None:
        done.append(state.where(F.col("r") > radius))
        state = state.where(F.col("r") <= radius)
    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in columns)

    def local(f):
        f = f.sample(frac=1, random_state=0)
        return f, f[["x", "y"]].to_numpy() / f[["sx", "sy"]].to_numpy(), float(f["r"].iloc[0])

    def grow(f):
        f, p, r = local(f)
        core = f["core"].to_numpy()
        if not core.any():
            return f.iloc[:0][columns].assign(stays=True)
        g = f["g"].to_numpy(float)
        if radius is None and np.isnan(g[core]).any():
            tri = C.triangles(p, r)
            size = C.radii(p, tri)
            least = C.least_radii(len(p), tri[size <= r * C.ALIKE], size[size <= r * C.ALIKE])
            g = np.where(np.isnan(g) & np.isfinite(least), least, g)
        own, p, g = f[core], p[core], g[core]
        stays = np.ones(len(p), bool)
        for at in pd.DataFrame(np.floor(p / (r / 2))).groupby([0, 1]).indices.values():
            if len(at) > 3:
                stays[at] = C.touched(p[at], r)
        known = np.concatenate([g, own["top"].to_numpy(float)])
        return own[columns].assign(g=g, top=np.nanmax(known) if not np.isnan(known).all() else np.nan, stays=stays | np.isnan(g) * (radius is None))

    def edges(f):
        f, p, r = local(f)
        if not f["core"].any() or len(p) < 3:
            return pd.DataFrame(columns=[key, "x", "y", "x1", "y1"])
        tri = C.triangles(p, r)
        e = C.rim(tri[C.radii(p, tri) <= r * C.ALIKE], len(p))
        e = e[f["core"].to_numpy()[e[:, 0]]]
        begin, end = (f[["x", "y"]].to_numpy()[e[:, k]] for k in range(2))
        return pd.DataFrame({key: f[key].iloc[0], "x": begin[:, 0], "y": begin[:, 1], "x1": end[:, 0], "y1": end[:, 1]})

    while not state.isEmpty():
        grown = _tiled(state).groupBy(key, "_i", "_j").applyInPandas(grow, f"{kinds}, stays boolean").localCheckpoint()
        known = grown.groupBy(key).agg(F.max(F.nanvl("top", F.lit(None))).alias("_top"), F.max(F.isnan(F.coalesce("g", F.lit(math.nan)))).alias("_open"), F.max("r").alias("_r"))
        going = F.col("_open") & (F.col("_r") < 32) if radius is None else F.col("_r") * 2 <= radius
        grown = grown.join(known.withColumn("_going", going), key)
        done.append(grown.where("not _going").select(*columns[:-1], F.col("_top").alias("top")))
        state = grown.where("_going and stays").select(*columns).withColumn("r", F.col("r") * 2).localCheckpoint()
    whole = reduce(DataFrame.unionByName, done)
    whole = whole.withColumn("r", F.lit(float(radius)) if radius is not None else F.col("top") * 1.5).where("r is not null")
    return _tiled(whole).groupBy(key, "_i", "_j").applyInPandas(edges, f"{key} {own.schema[key].dataType.simpleString()}, x double, y double, x1 double, y1 double")


def mixtures(points: DataFrame, key: str, part: str, x: str, y: str, least: int = 3) -> DataFrame:
    """`parts` of a mixture for every key: a Gaussian for each value of `part` with `least` points and spread both ways, weighed by its points."""
    own = points.groupBy(key, part).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vxy"))
    own = own.where((F.col("n") >= least) & (F.col("vx") > 0)).withColumn("l11", F.sqrt("vx")).withColumn("l21", F.col("vxy") / F.col("l11"))
    own = own.withColumn("l22", F.sqrt(F.greatest(F.col("vy") - F.col("l21") * F.col("l21"), F.lit(0.0)))).where("l22 > 1e-9 * sqrt(vy)")
    row = F.struct(F.col(part), F.col("n").cast("double").alias("weight"), "mx", "my", "l11", "l22", "l21")
    return own.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("parts"))


def point_predictions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, median and mode of either axis (D32, D53), for all rows of a batch at once."""
    own = spread(rows.select(*keys, "levels", "qx", "qy"), keys)

    def work(frames):
        for f in frames:
            out = f[list(keys)].copy()
            for axis in "xy":
                found = np.full((len(f), 3), np.nan)
                kind = f["levels"].map(lambda p: tuple(p))
                for levels, at in kind.groupby(kind, sort=False).indices.items():
                    found[at] = D.cubic_points(np.stack(f[f"q{axis}"].iloc[at].to_list()), np.array(levels, float))
                out[[f"{axis}_mean", f"{axis}_median", f"{axis}_mode"]] = found
            yield out

    kinds = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)
    return own.mapInPandas(work, f"{kinds}, x_mean double, x_median double, x_mode double, y_mean double, y_median double, y_mode double")


def quantile_density(rows: DataFrame, keys: Sequence[str], values: str = "qx", bins: int = 1000) -> DataFrame:
    """edges and cdf, arrays of a step density within the range of each key's quantiles (D31), all rows of a batch at once."""
    own = spread(rows.select(*keys, "levels", values), keys)

    def work(frames):
        for f in frames:
            edges, cdf = np.empty(len(f), object), np.empty(len(f), object)
            kind = f["levels"].map(lambda p: tuple(p))
            for levels, at in kind.groupby(kind, sort=False).indices.items():
                for k, (e, c) in zip(at, D.tailed_density(np.stack(f[values].iloc[at].to_list()), np.array(levels, float), bins)):
                    edges[k], cdf[k] = e, c
            yield f[list(keys)].assign(edges=edges, cdf=cdf)

    kinds = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)
    return own.mapInPandas(work, f"{kinds}, edges array<double>, cdf array<double>")


def density_summary(rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float], values: str = "qx", at: str = "x", bins: int = 1000) -> DataFrame:
    """quantiles, an array in the order of `probabilities`, and the density at a value, of the step density of `quantile_density`.

    The steps are used where they are made: a row's are 16 KB, which no exchange then has to hold.
    """
    own = spread(rows.select(*keys, "levels", values, at), keys)

    def work(frames):
        for f in _pieces(frames):
            quantiles, density = np.empty(len(f), object), np.empty(len(f))
            kind = f["levels"].map(lambda p: tuple(p))
            x = f[at].to_numpy(float)
            for levels, places in kind.groupby(kind, sort=False).indices.items():
                for k, (edges, cdf) in zip(places, D.tailed_density(np.stack(f[values].iloc[places].to_list()), np.array(levels, float), bins)):
                    quantiles[k], density[k] = D.step_quantiles(edges, cdf, probabilities), D.step_density(edges, cdf, x[k])
            yield f[list(keys)].assign(quantiles=quantiles, density=density)

    kinds = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys)
    return own.mapInPandas(work, f"{kinds}, quantiles array<double>, density double")


def density_at(edges: Column, cdf: Column, x: Column) -> Column:
    """The step density at a value, zero outside; the last edge belongs to the last step."""
    k = F.least(F.size(F.filter(edges, lambda e: e <= x)), F.size(edges) - 1)
    step = lambda a: F.get(a, k) - F.get(a, k - 1)
    return F.when((x >= F.get(edges, F.lit(0))) & (x <= F.get(edges, F.size(edges) - 1)), F.try_divide(step(cdf), step(edges))).otherwise(0.0)


def density_quantile(edges: Column, cdf: Column, p: float) -> Column:
    """The value of a level."""
    k = F.greatest(F.least(F.size(F.filter(cdf, lambda c: c <= p)), F.size(cdf) - 1), F.lit(1))
    share = F.try_divide(F.lit(p) - F.get(cdf, k - 1), F.get(cdf, k) - F.get(cdf, k - 1))
    return F.get(edges, k - 1) + F.coalesce(share, F.lit(0.0)) * (F.get(edges, k) - F.get(edges, k - 1))


def reference_areas(steps: DataFrame, horizon: int, confidences: Sequence[float] = scores.CONFIDENCES, draws: int = 10000, replace: bool = True) -> DataFrame:
    """area_ref by id, time_step and confidence: boxes of resampled own steps (dx, dy) about the last position y0."""
    lists = steps.where("dx is not null and dy is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "dx", "dy"))).alias("s"), F.max_by("y", "ts").alias("y0"))
    own = spread(lists.select("id", "y0", F.transform("s", lambda s: s["dx"]).alias("dx"), F.transform("s", lambda s: s["dy"]).alias("dy")), ["id"])

    def work(frames):
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                d = np.stack([np.asarray(row.dx), np.asarray(row.dy)], 1)
                if len(d) < (2 if replace else horizon):
                    continue
                boxes = D.reference_box(d, horizon, 1 - np.array(confidences, float), draws, 0, replace)
                for c, lo, hi in zip(confidences, *boxes):
                    g = lambda y: 1 / (1 + np.exp(2 * (row.y0 + y) / spatial.EARTH_RADIUS))  # noqa: E731, B023
                    area = -2 * spatial.EARTH_RADIUS * (hi[:, 0] - lo[:, 0]) * (g(hi[:, 1]) - g(lo[:, 1]))
                    out += [[row.id, t, float(c), float(a)] for t, a in enumerate(area)]
            yield pd.DataFrame(out, columns=["id", "time_step", "confidence", "area_ref"])

    return own.mapInPandas(work, f"id {own.schema['id'].dataType.simpleString()}, time_step int, confidence double, area_ref double")


def ellipse_scores(rows: DataFrame, confidences: Sequence[float] = scores.CONFIDENCES) -> DataFrame:
    """Coverage and areas, planar and on the sphere, of the ellipses of (x, y, x_se, y_se) against (x_real, y_real)."""
    each = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("confidence"), F.lit(1 - float(c)).alias("error")) for c in confidences])).alias("c")
    own = rows.select("*", each).select("*", "c.*").drop("c")
    k = F.sqrt(-2 * F.log("error"))
    a, b = F.col("x_se") * k, F.col("y_se") * k
    return own.withColumns({"covered": scores.in_ellipse(F.col("x_real"), F.col("y_real"), F.col("x"), F.col("y"), a, b), "area": scores.ellipse_area(a, b), "area_km": spatial.ellipse_area_km(a, b, F.col("y"))}).drop("error")
