"""Correlations, tests, histograms, bootstrap intervals and rules."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.tracks import nearest_before


def ordered_means(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """Mean of each column by keys, its values added one by one in the order of a column.

    A partial aggregate's last digit depends on how rows are dealt over tasks, which shows where a mean is rounded at a half or compared with another.
    Running sums of sorted rows do not, and no task holds a group's rows.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select(*keys, *[F.avg(c).over(upto).alias(c) for c in columns], F.lead(F.lit(1)).over(w).alias("_more"))
    return own.where("_more is null").select(*keys, *columns)


def correlations(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r of every pair of columns and the rows both have, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
    wide = df.groupBy(*keys).agg(*[f for i, (a, b) in enumerate(pairs) for f in (F.corr(a, b).alias(f"r{i}"), both(a, b).alias(f"n{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("p")
    return wide.select(*keys, each).select(*keys, "p.*")


def average_ranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Columns replaced by their average ranks within the keys, nulls kept."""
    out = df
    for c in columns:
        w = Window.partitionBy(*keys).orderBy(c)
        ties = Window.partitionBy(*keys, c)
        out = out.withColumn(f"_{c}", F.when(F.col(c).isNotNull(), F.rank().over(w) - F.sum(F.col(c).isNull().cast("int")).over(Window.partitionBy(*keys)) + (F.count("*").over(ties) - 1) / 2))
    return out.withColumns({c: F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def spearman(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rank correlation within each group of the keys."""
    return correlations(average_ranks(df, columns, keys), columns, keys)


def with_p_values(corr: DataFrame) -> DataFrame:
    """Two-sided p of r by Fisher's z, and Benjamini-Hochberg adjusted ones over all rows."""
    r = F.greatest(F.lit(-0.999999999), F.least(F.lit(0.999999999), F.col("r")))
    z = F.abs(0.5 * F.log((1 + r) / (1 - r))) * F.sqrt(F.greatest(F.col("n") - 3, F.lit(0)))
    return benjamini_hochberg(corr.withColumn("p", 2 * (1 - normal_cdf(z))))


def normal_cdf(z):
    """Standard normal distribution function, to 7.5e-8 (a published rational approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 0.3989422804014327 * F.exp(-z * z / 2) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def benjamini_hochberg(df: DataFrame, p: str = "p", ranges: int = 512) -> DataFrame:
    """p_adjusted: least over higher ranks of p n / rank.

    Tests are first counted by distinct p, equal ones share their highest rank; values fall into ranges by approximate
    quantiles, which are ranked side by side, and only a row for each range passes through one task.
    """
    each = df.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c")).where("_p is not null")
    cuts = each.agg(F.percentile_approx("_p", F.array(*[F.lit(i / ranges) for i in range(1, ranges)])).alias("_cuts"), F.sum("_c").alias("_n"))
    own = each.join(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda e: F.col("_p") > e)))  # one row
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("_b").agg(F.sum("_c").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    rank = F.sum("_c").over(Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    ranked = own.join(F.broadcast(sizes.select("_b", "_before")), "_b").withColumn("_q", F.col("_p") * F.col("_n") / rank)  # `ranges` rows
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy("_b").agg(F.min("_q").alias("_m")).withColumn("_above", F.coalesce(F.min("_m").over(above), F.lit(1.0)))
    inside = F.min("_q").over(Window.partitionBy("_b").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    adjusted = ranked.join(F.broadcast(least.select("_b", "_above")), "_b").select("_p", F.least(F.lit(1.0), inside, "_above").alias("p_adjusted"))  # `ranges` rows
    return df.join(adjusted, F.col(p) == F.col("_p"), "left").drop("_p")


def significance(df: DataFrame, level: float = 0.05) -> DataFrame:
    """Label of each test before and after correction."""
    label = F.when(F.col("p_adjusted") <= level, "yes - corrected").when(F.col("p") <= level, "yes - not corrected").otherwise("no")
    return df.withColumn("significant", label)


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts by equal bins, the last one closed."""
    b = F.least(F.floor((F.col(column) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def heatmap(df: DataFrame, x: str, y: str, value: str, edges_x: tuple[float, float, int], edges_y: tuple[float, float, int]) -> DataFrame:
    """Mean and count on a grid of right-closed bins, the lowest edge included, with bin centres."""
    def code(c, lo, hi, n):
        w = (hi - lo) / n
        return F.greatest(F.ceil((F.col(c) - lo) / w) - 1, F.lit(0)).cast("int"), lo + w / 2, w

    (i, x0, wx), (j, y0, wy) = code(x, *edges_x), code(y, *edges_y)
    own = df.where(F.col(x).between(*edges_x[:2]) & F.col(y).between(*edges_y[:2]))
    out = own.groupBy(i.alias("i"), j.alias("j")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.withColumns({"x": F.lit(x0) + F.col("i") * wx, "y": F.lit(y0) + F.col("j") * wy})


def rolling_correlation(df: DataFrame, x: str, y: str, half: int, ident: str = "id", order: str = "time_idx") -> DataFrame:
    """Centred rolling r over 2 half + 1 rows; the edges take the nearest full value, short tracks zero."""
    w, down = Window.partitionBy(ident).orderBy(order), Window.partitionBy(ident).orderBy(F.desc(order))
    frame = w.rowsBetween(-half, half)
    full = F.when(F.count("*").over(frame) == 2 * half + 1, F.corr(x, y).over(frame))
    out = df.withColumns({"_r": full, "_n": F.count("*").over(Window.partitionBy(ident))})
    near = F.coalesce("_r", nearest_before(F.col("_r"), down), nearest_before(F.col("_r"), w))
    return out.withColumn("rho", F.when(F.col("_n") < 2 * half, 0.0).otherwise(near)).drop("_r", "_n")


def drop_sparse(df: DataFrame, share: float = 0.6, keep: Sequence[str] = ()) -> DataFrame:
    """Without the columns whose share of nulls or NaN reaches `share`; one aggregate decides."""
    real = {n for n, t in df.dtypes if t in ("double", "float")}
    none = lambda c: F.col(c).isNull() | (F.isnan(c) if c in real else F.lit(False))
    row = df.agg(*[F.avg(none(c).cast("int")).alias(c) for c in df.columns]).first()
    return df.select([c for c in df.columns if c in keep or (row[c] or 0.0) < share])


def fill_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plus infinity becomes the column's largest finite value."""
    inf = F.lit(float("inf"))
    most = df.agg(*[F.max(F.when(F.col(c) < inf, F.col(c))).alias(f"_{c}") for c in columns])
    out = df.join(F.broadcast(most))  # one row
    return out.select([F.when(F.col(c) == inf, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def bootstrap(df: DataFrame, value: str, group: Sequence[str], unit: str, R: int = 100_000, alpha: float = 0.05, seed: int = 0, method: str = "bca") -> DataFrame:
    """(group, mean, lo, hi, units) of the mean over units, whole units resampled.

    Units are reduced to one value each; then every unit enters each of R replicates with a Poisson weight of mean one,
    drawn from a hash of unit and replicate, so weighted sums add up over tasks and no task sees a group's units.
    The bias of `bca` comes from the replicates, its acceleration from the skewness of all units, as leaving one
    out has for a mean.
    """
    n_tasks = df.sparkSession.sparkContext.defaultParallelism
    per = df.groupBy(*group, unit).agg(F.avg(value).alias("_v")).where("_v is not null")
    coded = per.select(*group, "_v", F.xxhash64(*group, unit, F.lit(seed)).alias("_h")).repartition(n_tasks, "_h")
    kinds = [f"{g} {per.schema[g].dataType.simpleString()}" for g in group]
    poisson = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 9)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)

    def weights(h: np.ndarray, at: int) -> np.ndarray:
        """Weights of units in replicates 4 at to 4 at + 4: a hash for every four, of 16 bits each."""
        x = h[:, None] + (np.arange(at, at + 1024, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return poisson[(x ^ (x >> np.uint64(31))).view(np.uint16)]

    def sums(frames):
        held: dict[tuple, np.ndarray] = {}
        for f in frames:
            for key, own in f.groupby(list(group), dropna=False, sort=False):
                key = tuple(None if k != k else k for k in key)
                total = held.setdefault(key, np.zeros((2, -(-R // 4096) * 4096)))
                for lo in range(0, len(own), 512):
                    h, v = own["_h"].to_numpy()[lo : lo + 512].view(np.uint64), own["_v"].to_numpy()[lo : lo + 512]
                    two = np.stack([v, np.ones(len(v))])
                    for at in range(0, total.shape[1], 4096):
                        total[:, at : at + 4096] += two @ weights(h, at // 4)
            if len(held) > 64:
                yield from packed(held)
                held = {}
        yield from packed(held)

    def packed(held):
        for key, total in held.items():
            yield pd.DataFrame({**{g: [k] * R for g, k in zip(group, key)}, "_r": np.arange(R), "_s": total[0, :R], "_w": total[1, :R]})[[*group, "_r", "_s", "_w"]]

    drawn = coded.mapInPandas(sums, ", ".join([*kinds, "_r int, _s double, _w double"]))
    drawn = drawn.groupBy(*group, "_r").agg(F.try_divide(F.sum("_s"), F.sum("_w")).alias("_m"))
    moments = per.groupBy(*group).agg(F.avg("_v").alias("mean"), F.skewness("_v").alias("_skew"), F.count("*").alias("units"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    named = moments.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "mean", "_skew", "units")
    # A group is R replicates here, however many units it has.
    replicates = drawn.groupBy(*group).agg(F.array_sort(F.collect_list("_m")).alias("_all"))
    joined = replicates.join(named, _all(same))
    norm = NormalDist()

    def interval(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                draws, q = np.asarray(row["_all"], float), np.array([alpha / 2, 1 - alpha / 2])
                if method == "bca" and row["units"] > 2 and draws.std() > 0:
                    share = (draws < row["mean"]).mean() + (draws == row["mean"]).mean() / 2
                    z0 = norm.inv_cdf(float(np.clip(share, 1 / R, 1 - 1 / R)))
                    a = row["_skew"] / (6 * np.sqrt(row["units"])) if row["_skew"] == row["_skew"] and row["_skew"] is not None else 0.0
                    q = np.array([norm.cdf(z0 + (z0 + norm.inv_cdf(p)) / (1 - a * (z0 + norm.inv_cdf(p)))) for p in q])
                lo, hi = np.quantile(draws, q) if len(draws) else (np.nan, np.nan)
                out.append([*[row[g] for g in group], row["mean"], lo, hi, row["units"]])
            yield pd.DataFrame(out, columns=[*group, "mean", "lo", "hi", "units"])

    return joined.select(*group, "mean", "_skew", "units", "_all").mapInPandas(interval, ", ".join([*kinds, "mean double, lo double, hi double, units long"]))


def float_cell(v: Column, bits: int) -> Column:
    """A code of doubles by sign, exponent and the first bits of the mantissa: values of one code differ by a share of 2^-bits at most, and codes are in the order of values."""
    size = F.abs(v)
    exponent = F.when(size > 0, F.floor(F.log2(size))).otherwise(-1074).cast("long")
    # A logarithm next to a power of two may round to either side.
    exponent = exponent + F.when(size >= F.pow(F.lit(2.0), exponent + 1), 1).when((size > 0) & (size < F.pow(F.lit(2.0), exponent)), -1).otherwise(0)
    code = (exponent + 1075) * (1 << bits) + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << bits)).cast("long")
    return F.when(size == 0, F.lit(0).cast("long")).when(v > 0, code).otherwise(-code)


def weighted_statistic(values: np.ndarray, weights: np.ndarray, statistic: str, level: float) -> np.ndarray:
    """The statistic of ascending values under each row of whole weights: of the sample that holds every value as often as its weight says."""
    total = weights.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if statistic == "mean":
            return weights @ values / total
        if statistic == "rms":
            return np.sqrt(weights @ (values * values) / total)
        upto = np.cumsum(weights, 1)
        at = np.maximum(total - 1, 0) * level
        low = np.floor(at)
        take = lambda k: values[np.minimum((upto <= k[:, None]).sum(1), len(values) - 1)]
        a = take(low)
        return np.where(total > 0, a + (take(np.minimum(low + 1, np.maximum(total - 1, 0))) - a) * (at - low), np.nan)


def bootstrap_statistic(
    df: DataFrame, value: str, group: Sequence[str], unit: str, statistic: str = "median", level: float = 0.5, within: str = "mean",
    R: int = 10_000, alpha: float = 0.05, seed: int = 0, method: str = "bca", bits: int = 11, blocks: int = 100,
) -> DataFrame:
    """(group, value, lo, hi, units) of a statistic over units: "mean", "rms", "median" or the "quantile" of a level.

    Every unit is reduced to the mean, root mean square or (approximate) median of its rows. Units are then counted in cells of the value, which are
    2^-bits wide relative to it and stand at their units' mean: a sketch that partial aggregates merge, and exact where units of a cell are equal.
    A unit's weight in a replicate is Poisson with mean one, and sums of those are Poisson too, so a replicate draws one weight a cell,
    however many units there are. Replicates are dealt over tasks in blocks of 500. The acceleration of `bca` comes from leaving out one of
    `blocks` hashed parts of the units after the other (a delete-d jackknife), which holds for quantiles where leaving out single units does not.
    """
    reduce = {"mean": F.avg(value), "rms": F.sqrt(F.avg(F.col(value) * F.col(value))), "median": F.percentile_approx(value, F.lit(0.5), F.lit(10000)).cast("double")}[within]
    level = 0.5 if statistic == "median" else level
    per = df.groupBy(*group, unit).agg(reduce.alias("_v")).where("_v is not null and not isnan(_v)")
    part = F.pmod(F.xxhash64(unit, F.lit(seed)), F.lit(blocks)).cast("int")
    counted = per.groupBy(*group, float_cell(F.col("_v"), bits).alias("_c"), part.alias("_p")).agg(F.sum("_v").alias("_s"), F.count("*").alias("_n"))
    cells = counted.groupBy(*group, "_c").agg((F.sum("_s") / F.sum("_n")).alias("v"), F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("_p").alias("p"), F.col("_n").alias("n")))).alias("by"))
    # A group's row is its cells: at most 2^bits for every power of two in the range of its values.
    rows = cells.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("v", "n", "by"))).alias("cells"), F.xxhash64(*group, F.lit(seed)).alias("_h"))
    names, step = [f"_g{i}" for i in range(len(group))], 500
    kinds = [f"{g} {per.schema[g].dataType.simpleString()}" for g in group]
    parts = rows.select(*group, "cells", "_h", F.explode(F.sequence(F.lit(0), F.lit((R - 1) // step))).alias("_b"))
    parts = parts.repartition(df.sparkSession.sparkContext.defaultParallelism, *group, "_b")

    def arrays(row):
        return np.array([c["v"] for c in row["cells"]], float), np.array([c["n"] for c in row["cells"]], float)

    def draw(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                v, n = arrays(row)
                rng = np.random.default_rng([row["_h"] & 0xFFFFFFFF, row["_b"]])
                weights = rng.poisson(n, (min(step, R - row["_b"] * step), len(n)))
                out.append([*[row[g] for g in group], weighted_statistic(v, weights, statistic, level)])
            yield pd.DataFrame(out, columns=[*group, "_r"])

    drawn = parts.mapInPandas(draw, ", ".join([*kinds, "_r array<double>"]))
    # R numbers a group, however many units it has.
    replicates = drawn.groupBy(*group).agg(F.flatten(F.collect_list("_r")).alias("_all")).select(*[F.col(g).alias(n) for g, n in zip(group, names)], "_all")
    joined = rows.join(replicates, _all([F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)])).select(*group, "cells", "_all")
    norm = NormalDist()

    def interval(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                v, n = arrays(row)
                draws, q = np.asarray(row["_all"], float), np.array([alpha / 2, 1 - alpha / 2])
                draws = draws[np.isfinite(draws)]
                found = float(weighted_statistic(v, n[None], statistic, level)[0])
                if method == "bca" and n.sum() > 2 and len(draws) and draws.std() > 0:
                    left = np.tile(n, (blocks, 1))
                    for k, cell in enumerate(row["cells"]):
                        for b in cell["by"]:
                            left[b["p"], k] -= b["n"]
                    left = left[(left.sum(1) > 0) & (left.sum(1) < n.sum())]
                    drop = weighted_statistic(v, left, statistic, level)
                    off = drop.mean() - drop if len(drop) else np.zeros(1)
                    a = float((off**3).sum() / (6 * (off**2).sum() ** 1.5)) if (off**2).sum() > 0 else 0.0
                    share = (draws < found).mean() + (draws == found).mean() / 2
                    z0 = norm.inv_cdf(float(np.clip(share, 1 / R, 1 - 1 / R)))
                    q = np.array([norm.cdf(z0 + (z0 + norm.inv_cdf(p)) / (1 - a * (z0 + norm.inv_cdf(p)))) for p in q])
                lo, hi = np.quantile(draws, q) if len(draws) else (np.nan, np.nan)
                out.append([*[row[g] for g in group], found, lo, hi, int(n.sum())])
            yield pd.DataFrame(out, columns=[*group, "value", "lo", "hi", "units"])

    return joined.mapInPandas(interval, ", ".join([*kinds, "value double, lo double, hi double, units long"]))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def kernel_density(df: DataFrame, x: str, points: Sequence[float], bandwidth: float, resolution: float = 0.05) -> DataFrame:
    """Gaussian density at some points (A29): values are first counted on a grid of `resolution` bandwidths, so
    what is broadcast and multiplied is the occupied grid and not the rows."""
    cell = bandwidth * resolution
    grid = df.where(F.col(x).isNotNull()).groupBy(F.round(F.col(x) / cell).alias("g")).agg(F.count("*").alias("n"))
    at = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    z = (F.col("at") - F.col("g") * cell) / bandwidth
    weight = F.exp(-z * z / 2) * F.col("n")
    out = grid.withColumn("at", at).groupBy("at").agg(F.sum(weight).alias("_w"), F.sum("n").alias("_n"))
    return out.select("at", (F.col("_w") / (F.col("_n") * bandwidth * 2.5066282746310002)).alias("density"))


def _spread_along(counts: DataFrame, axis: str, keep: Sequence[str], width: float, bandwidth: float, step: float, reach: float) -> DataFrame:
    """Kernel sums of counted cells at multiples of `step` along one axis, up to `reach` bandwidths away."""
    at = F.col(axis) * width
    to = F.explode(F.sequence(F.ceil((at - reach * bandwidth) / step), F.floor((at + reach * bandwidth) / step))).alias("_to")
    z = (F.col("_to") * step - at) / bandwidth
    out = counts.where(F.floor((at + reach * bandwidth) / step) >= F.ceil((at - reach * bandwidth) / step)).select(*keep, axis, "n", to)
    return out.groupBy(*keep, F.col("_to").alias(f"{axis}_to")).agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("n"))


def density_grid(df: DataFrame, x: str, y: str, bandwidth: tuple[float, float], step: tuple[float, float], resolution: int = 8, reach: float = 5.0) -> DataFrame:
    """i, j, x, y and Gaussian density at the multiples of `step`.

    Points are counted on a lattice of 1/resolution bandwidths; the kernel is a product, so counts are spread along one axis and summed, then along
    the other: the work follows occupied cells and not rows, and no pairs of points are formed. Beyond `reach` bandwidths a point counts as none.
    """
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    width = [b / resolution for b in bandwidth]
    counts = own.groupBy(F.floor(F.col(x) / width[0] + 0.5).alias("i"), F.floor(F.col(y) / width[1] + 0.5).alias("j")).agg(F.count("*").alias("n"))
    total = own.agg(F.count("*").alias("_all"))
    along_x = _spread_along(counts, "i", ["j"], width[0], bandwidth[0], step[0], reach)
    both = _spread_along(along_x, "j", ["i_to"], width[1], bandwidth[1], step[1], reach).join(F.broadcast(total))  # one row
    density = F.col("n") / (F.col("_all") * 2 * math.pi * bandwidth[0] * bandwidth[1])
    return both.select(F.col("i_to").alias("i"), F.col("j_to").alias("j"), (F.col("i_to") * step[0]).alias("x"), (F.col("j_to") * step[1]).alias("y"), density.alias("density"))


def bandwidth_likelihoods(df: DataFrame, columns: Sequence[str], bandwidths: Sequence[Sequence[float]], resolution: int | None = None, reach: float = 5.0) -> DataFrame:
    """candidate, and the leave-one-out log likelihood of a Gaussian density with each candidate's bandwidths, one a column.

    One job for all candidates: rows are counted on each one's lattice of 1/resolution bandwidths, counts are spread along one axis after the other, to
    occupied places only, and each cell's own point is taken off its sum. A point with no other one in reach has the density of one at its edge.
    """
    d = len(columns)
    resolution = resolution or (32 if d == 1 else 8)
    steps = int(reach * resolution)
    rows = df.where(_all([F.col(c).isNotNull() for c in columns])).select(*columns)
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(h)).alias(f"h{i}") for i, h in enumerate(hs)]) for k, hs in enumerate(bandwidths)])).alias("c")
    cells = rows.select(*columns, named).groupBy(F.col("c.k").alias("candidate"), *[F.floor(F.col(c) * resolution / F.col(f"c.h{i}") + 0.5).alias(f"g{i}") for i, c in enumerate(columns)])
    cells = cells.agg(F.count("*").cast("double").alias("n"))
    offset = F.explode(F.sequence(F.lit(-steps), F.lit(steps))).alias("o")
    sums = cells
    for i in range(d):
        own = [c for c in sums.columns if c not in (f"g{i}", "n")]
        near = sums.select(*own, f"g{i}", "n", offset)
        near = near.select(*own, (F.col(f"g{i}") + F.col("o")).alias(f"g{i}"), (F.col("n") * F.exp(-F.pow(F.col("o") / resolution, 2) / 2)).alias("n"))
        seen = ["candidate", *[f"g{j}" for j in range(i + 1)]]  # places where no point shares these are never read
        sums = near.groupBy(*own, f"g{i}").agg(F.sum("n").alias("n")).join(cells.select(*seen).distinct(), seen, "left_semi")
    total = rows.agg(F.count("*").cast("double").alias("_all"))
    volume = F.element_at(F.array(*[F.lit(float(np.prod(hs)) * (2 * math.pi) ** (d / 2)) for hs in bandwidths]), F.col("candidate") + 1)
    key = ["candidate", *[f"g{i}" for i in range(d)]]
    each = cells.withColumnRenamed("n", "here").join(sums, key).join(F.broadcast(total))  # one row
    density = F.greatest(F.col("n") - 1, F.lit(math.exp(-reach * reach / 2))) / ((F.col("_all") - 1) * volume)
    return each.groupBy("candidate").agg(F.sum(F.col("here") * F.log(density)).alias("log_likelihood"))


def best_bandwidth(df: DataFrame, columns: Sequence[str], low: float = 0.1, high: float = 10.0, rounds: int = 3, ways: int = 9, **options) -> list[float]:
    """Bandwidths, the same share of each column's deviation, of the greatest leave-one-out likelihood (A29; `low` and `high` are such shares).

    `ways` shares, even in their logarithms, are tried in one job; the next round lies between the neighbours of the best. The driver holds `ways` numbers a round.
    """
    spread = df.agg(*[F.stddev(c).alias(c) for c in columns]).first()
    if any(not spread[c] for c in columns):
        raise ValueError("a bandwidth needs two different values in each column")
    best = low
    for _ in range(rounds):
        shares = np.geomspace(low, high, ways)
        found = {r.candidate: r.log_likelihood for r in bandwidth_likelihoods(df, columns, [[s * spread[c] for c in columns] for s in shares], **options).collect()}
        at = max(found, key=lambda k: (found[k], -k))
        best, low, high = shares[at], shares[max(at - 1, 0)], shares[min(at + 1, ways - 1)]
    return [float(best * spread[c]) for c in columns]


def quantile_items(df: DataFrame, columns: Sequence[str], key: str, bins: int = 4) -> DataFrame:
    """Item sets `feature=pLow - pHigh` of approximate quantile bins."""
    shares = [i / bins for i in range(1, bins)]
    cuts = df.agg(*[F.percentile_approx(c, F.array(*[F.lit(s) for s in shares])).alias(f"_{c}") for c in columns])
    own = df.join(F.broadcast(cuts))  # one row

    def item(c: str):
        code = F.size(F.filter(F.col(f"_{c}"), lambda e: F.col(c) > e))
        return F.when(F.col(c).isNotNull(), F.format_string(f"{c}=p%d - p%d", code * (100 // bins), (code + 1) * (100 // bins)))

    return own.select(key, F.array_compact(F.array(*[item(c) for c in columns])).alias("items"))


def rules(items: DataFrame, target: str, support: float = 0.05, confidence: float = 0.7, longest: int = 7) -> DataFrame:
    """Association rules with a fixed consequent, without those that add conditions to a rule already there."""
    from pyspark.ml.fpm import FPGrowth

    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items.select("items")).associationRules
    own = found.where((F.get("consequent", F.lit(0)) == target) & (F.size("antecedent") < longest)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support")
    return simplest(own)


def simplest(rules: DataFrame) -> DataFrame:
    """The rules (sorted antecedent and others) of which no part of the antecedent is a rule's antecedent too.

    Each part is looked up by equality, so an item that many rules share is no key; a rule of n conditions has 2 ** n parts, which `longest` bounds.
    """
    n = F.size("antecedent")
    masks = F.expr("explode(sequence(1L, shiftleft(1L, size(antecedent)) - 2L))")
    parts = rules.where(n > 1).select(F.col("antecedent").alias("_big"), masks.alias("_mask")).select("_big", F.expr("filter(_big, (e, i) -> getbit(_mask, i) = 1)").alias("_part"))
    longer = parts.join(rules.select(F.col("antecedent").alias("_part")), "_part", "left_semi").select(F.col("_big").alias("antecedent")).distinct()
    return rules.join(longer, "antecedent", "left_anti")


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information of two columns in equal-frequency bins."""
    cut = lambda c: F.percentile_approx(c, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias(f"_{c}")
    own = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    coded = own.join(F.broadcast(own.agg(cut(a), cut(b))))  # one row
    code = lambda c: F.size(F.filter(F.col(f"_{c}"), lambda e: F.col(c) > e))
    n = coded.groupBy(code(a).alias("i"), code(b).alias("j")).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    share = F.col("n") / total
    each = share * F.log(F.col("n") * total / (F.sum("n").over(Window.partitionBy("i")) * F.sum("n").over(Window.partitionBy("j"))))
    return n.select(each.alias("m")).agg(F.sum("m").alias("mi"))


def select_features(df: DataFrame, features: Sequence[str], target: str, most: int, bins: int = 10) -> list[str]:
    """Greedy choice of the most relevant and least redundant features (A28); the driver holds names and scores only."""
    mi = lambda a, b: mutual_information(df, a, b, bins).first().mi or 0.0
    relevance = {f: mi(f, target) for f in features}
    chosen: list[str] = []
    redundancy = dict.fromkeys(features, 0.0)
    while len(chosen) < min(most, len(features)):
        rest = [f for f in features if f not in chosen]
        best = max(rest, key=lambda f: (relevance[f] - redundancy[f] / max(1, len(chosen)), f))
        if chosen and relevance[best] - redundancy[best] / len(chosen) <= 0:
            break
        chosen.append(best)
        for f in [f for f in rest if f != best]:
            redundancy[f] += mi(f, best)
    return chosen


def folds(df: DataFrame, target: str, key: str, k: int = 5, bins: int = 10, seed: int = 0, buckets: int = 256) -> DataFrame:
    """`fold`: rows dealt over k folds within equal-frequency bins of the target.

    A bin is numbered in hash buckets side by side, each from where the ones before it end. The order is that of MD5
    hashes, which any engine can repeat.
    """
    cuts = df.agg(F.percentile_approx(target, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_cuts"))
    mixed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    part = F.floor(F.conv(F.substring(mixed, 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int")  # in the order of hashes
    coded = df.join(F.broadcast(cuts)).withColumns({"_bin": F.size(F.filter("_cuts", lambda e: F.col(target) > e)), "_part": part}).drop("_cuts")  # one row
    before = Window.partitionBy("_bin").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = coded.groupBy("_bin", "_part").agg(F.count("*").alias("_n")).select("_bin", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_bin", "_part").orderBy(mixed, key)
    numbered = coded.join(F.broadcast(sizes), ["_bin", "_part"]).withColumn("fold", ((F.row_number().over(w) - 1 + F.col("_before")) % k).cast("int"))  # bins x buckets rows
    return numbered.select(*df.columns, "fold")
