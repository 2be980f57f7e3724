"""Operators along a track: steps, gaps, chunks, runs, thinning, filters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import calendar, spatial
from wakeline.operators import joins


def along(ident: str = "id", order: str = "ts"):
    return Window.partitionBy(ident).orderBy(order)


def nearest_before(value: Column, window, upto: int = 0) -> Column:
    """The last value there is so far in a window's order. What lies ahead is sought in the descending order: a frame
    that runs to the end would be gone through again for every row."""
    return F.last(value, True).over(window.rowsBetween(Window.unboundedPreceding, upto))


def with_steps(fixes: DataFrame) -> DataFrame:
    """dt in days and step in km from the fix before; null on a track's first fix."""
    w = along()
    lat, lon = F.radians("lat"), F.radians("lon")
    out = fixes.withColumns({"_lat": F.lag(lat).over(w), "_lon": F.lag(lon).over(w), "dt": calendar.days_between(F.lag("ts").over(w), F.col("ts"))})
    step = spatial.great_circle(F.col("_lat"), F.col("_lon"), lat, lon) * spatial.EARTH_RADIUS
    return out.withColumn("step_km", step).drop("_lat", "_lon")


def replace_zero_dt(steps: DataFrame, by: str = "mean", threshold: float = 1e-8, fallback: float = 0.11) -> DataFrame:
    """Zero gaps become the track's mean positive gap, or the mean of the nearest positive ones (T5)."""
    good = F.when(F.col("dt") >= threshold, F.col("dt"))
    every = Window.partitionBy("id")
    if by == "mean":
        other = F.avg(good).over(every)
    else:
        back, ahead = nearest_before(good, along(), -1), nearest_before(good, Window.partitionBy("id").orderBy(F.desc("ts")), -1)
        other = F.when(back.isNull() | ahead.isNull(), F.coalesce(back, ahead)).otherwise((back + ahead) / 2)
    return steps.withColumn("dt", F.when(F.col("dt").isNull() | (F.col("dt") >= threshold), F.col("dt")).otherwise(F.coalesce(other, F.lit(fallback))))


def with_speed(steps: DataFrame) -> DataFrame:
    """km an hour of each step."""
    return steps.withColumn("speed", F.try_divide(F.col("step_km"), F.col("dt") * 24))


def fill_last(df: DataFrame, column: str, delta: int = 10, order: str = "ts") -> DataFrame:
    """A track's last value, where missing, becomes the mean of the `delta` before it."""
    w = along(order=order)
    before = F.avg(column).over(w.rowsBetween(-delta, -1))
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn(column, F.when(last & F.col(column).isNull(), before).otherwise(F.col(column)))


def chunks(fixes: DataFrame, max_dt: float = 7.0) -> DataFrame:
    """`section`: a new one starts after a gap over `max_dt` days; null on tracks without such a gap."""
    w = along()
    gap = F.coalesce(calendar.days_between(F.lag("ts").over(w), F.col("ts")), F.lit(0.0)) > max_dt
    section = F.sum(gap.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = fixes.withColumn("section", section)
    split = F.max("section").over(Window.partitionBy("id")) > 0
    return out.withColumn("section", F.when(split, F.col("section")).cast("int"))


def time_steps(rows: DataFrame, hours: float = 6.0, most: int = 28, order: str = "ts") -> DataFrame:
    """`chunk_num` and `time_step` within a chunk; a chunk ends at a gap over most / 2 days, later steps go."""
    w = along(order=order)
    gap = F.coalesce(calendar.days_between(F.lag(order).over(w), F.col(order)), F.lit(0.0))
    out = rows.withColumn("_gap", gap).withColumn("chunk_num", F.sum((F.col("_gap") > most / 2).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("id", "chunk_num").orderBy(order)
    start = F.first(order).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    steps = calendar.days_between(start, F.col(order)) * 24 / hours
    return out.withColumn("time_step", steps).where(F.col("time_step") < most).withColumn("time_step", F.col("time_step").cast("int")).drop("_gap")


def densify(binned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for every time_idx up to the next one, carrying the values, `missing` on the added rows."""
    w = along(order="time_idx")
    ahead = F.coalesce(F.lead("time_idx").over(w) - 1, F.col("time_idx"))
    spread = binned.select("id", F.col("time_idx").alias("_from"), *columns, ahead.alias("_to")).withColumn("time_idx", F.explode(F.sequence("_from", "_to")))
    return spread.select("id", "time_idx", *columns, (F.col("time_idx") != F.col("_from")).alias("missing"))


def fill_both_ways(df: DataFrame, columns: Sequence[str], ident: Sequence[str] = ("id",), order: str = "time_idx") -> DataFrame:
    """Nulls take the value before them, or else the one after."""
    up, down = Window.partitionBy(*ident).orderBy(order), Window.partitionBy(*ident).orderBy(F.desc(order))
    fill = lambda c: F.coalesce(nearest_before(F.col(c), up), nearest_before(F.col(c), down))
    return df.select([fill(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def repeated_flags(df: DataFrame, columns: Sequence[str], order: str = "time_idx") -> DataFrame:
    """`repeated`: equal to the row before in all columns."""
    w = along(order=order)
    same = F.lag(F.lit(1)).over(w).isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("repeated", same)


def trailing_run(df: DataFrame, flag: str, order: str = "time_idx") -> DataFrame:
    """Length of the run of `flag` at each track's end and the flag's share."""
    last_clear = F.max(F.when(~F.col(flag), F.col("_n")))
    numbered = df.withColumn("_n", F.row_number().over(along(order=order)))
    return numbered.groupBy("id").agg((F.max("_n") - F.coalesce(last_clear, F.lit(0))).cast("int").alias("trailing"), F.avg(F.col(flag).cast("int")).alias("share"), F.count("*").alias("length"))


def longest_run(df: DataFrame, flag: str, order: str = "ts", compat: bool = False) -> DataFrame:
    """The rows of the longest run of `flag` of each track, the first of equals; `compat` keeps the row before it."""
    w = along(order=order)
    rows = df.withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_g", F.col("_n") - F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.where(flag).groupBy("id", "_g").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    best = islands.groupBy("id").agg(F.max(F.struct((F.col("_hi") - F.col("_lo")).alias("size"), (-F.col("_lo")).alias("first"), "_hi")).alias("m"))
    best = best.select("id", (-F.col("m.first") - (1 if compat else 0)).alias("_lo"), F.col("m._hi").alias("_hi"))
    return rows.join(best, "id").where("_n between _lo and _hi").drop("_n", "_g", "_lo", "_hi")


def inside_polygon_run(fixes: DataFrame, vertices: Sequence[tuple[float, float]], compat: bool = False) -> DataFrame:
    """The longest stay of each track inside a polygon of (lon, lat) vertices."""
    flagged = fixes.withColumn("_in", spatial.point_in_polygon(F.col("lon"), F.col("lat"), vertices) > 0)
    return longest_run(flagged, "_in", compat=compat).drop("_in")


def _each_track(fixes: DataFrame, keep: Callable[[np.ndarray], np.ndarray], of: str) -> DataFrame:
    """Rows that a sequential rule over one sorted column keeps; a task holds one track at a time."""

    def rule(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values(of, kind="stable")
        return track[keep(track[of].to_numpy())]

    return fixes.groupBy("id").applyInPandas(rule, fixes.schema)


def thin(fixes: DataFrame, threshold: float) -> DataFrame:
    """Keep the first fix, then each next one `threshold` days or more after the last kept."""

    def keep(ts: np.ndarray) -> np.ndarray:
        days = (ts - ts[0]) / np.timedelta64(1, "D")
        mask, last = np.zeros(len(days), bool), -np.inf
        for i, t in enumerate(days):
            if t - last >= threshold:
                mask[i], last = True, t
        return mask

    return _each_track(fixes, keep, "ts")


def thin_native(fixes: DataFrame, threshold: float) -> DataFrame:
    """`thin` as a fold over each track's sorted times, without Python."""
    t = F.unix_micros("ts")
    times = fixes.groupBy("id").agg(F.array_sort(F.collect_list(t)).alias("times"))
    gap = F.lit(int(threshold * calendar.DAY_US))
    step = lambda kept, now: F.when((F.size(kept) == 0) | (now - F.element_at(kept, -1) >= gap), F.concat(kept, F.array(now))).otherwise(kept)
    kept = times.select("id", F.explode(F.aggregate("times", F.array().cast("array<bigint>"), step)).alias("_t"))
    return fixes.withColumn("_t", t).join(kept, ["id", "_t"]).drop("_t")


def starts(index: DataFrame, shift: float, order: str = "time_idx", compat: bool = False) -> DataFrame:
    """Greedy window starts over `shift` steps apart; `compat` skips one more."""

    def keep(t: np.ndarray) -> np.ndarray:
        mask, at = np.zeros(len(t), bool), 0
        while at < len(t):
            mask[at] = True
            after = np.flatnonzero(t[at:] - t[at] > shift)
            if not len(after):
                break
            at += int(after[0]) + (1 if compat else 0)
        return mask

    return _each_track(index, keep, order)


def prune(fixes: DataFrame, meta: DataFrame, values: Iterable | None = None, min_len: int = 50, min_days: float = 5, min_tracks: int = 10, apply: Callable[[DataFrame], DataFrame] | None = None, mapping: dict | None = None, null_as: str | None = None, vertices: Sequence | None = None) -> DataFrame:
    """Species and track filters in their fixed order (W1, A8): nulls, own function, values, length and span
    (both strict), relabelling, polygon, species with enough tracks."""
    labels = meta.select("id", (F.coalesce("species", F.lit(null_as)) if null_as is not None else F.col("species")).alias("species"))
    out = fixes.join(labels, "id")
    if apply:
        out = out.transform(apply)
    out = out.where(F.col("species").isin(list(values))) if values else out.where("species is not null")
    own = Window.partitionBy("id")
    span = calendar.days_between(F.min("ts").over(own), F.max("ts").over(own))
    out = out.withColumns({"_n": F.count("*").over(own), "_days": span}).where((F.col("_n") > min_len) & (F.col("_days") > min_days))
    if mapping:
        out = out.replace(mapping, subset=["species"])
    if vertices:
        out = inside_polygon_run(out, vertices)
    out = out.drop("_n", "_days")
    if min_tracks <= 1:  # every species that is there has a track
        return out.where("species is not null")
    common = out.select("id", "species").distinct().groupBy("species").agg(F.count("*").alias("_tracks")).where(F.col("_tracks") >= min_tracks).select("species")
    # A few labels are all the keys there are: fixes are not shuffled by them where the metadata bound their number.
    few = apply is None and joins.estimated_bytes(meta) <= joins.SMALL_BYTES
    return out.join(F.broadcast(common) if few else common, "species", "left_semi")


def duplicate_times(fixes: DataFrame, min_seconds: float = 60) -> DataFrame:
    """`keep`: false for fixes at most so long after the one before."""
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(along()))) / 1e6
    return fixes.withColumn("keep", F.coalesce(gap > min_seconds, F.lit(True)))


def observation_type(lc: Column, smaj: Column, smin: Column, eor: Column, x_sd: Column, y_sd: Column) -> Column:
    """KF, LS, GPS or GL of a location with its error ellipse; an axis of zero is no ellipse."""
    has = smaj.isNotNull() & smin.isNotNull() & eor.isNotNull() & (smaj != 0) & (smin != 0)
    sd = x_sd.isNotNull() & y_sd.isNotNull()
    return F.when(has, "KF").when(lc == "G", "GPS").when((lc == "GL") & sd, "GL").when(lc.isin("3", "2", "1", "0", "A", "B", "Z") | smaj.isNotNull(), "LS")


def speed_outliers(fixes: DataFrame, v_max: float = 10.0, angles: Sequence[float] = (15.0, 25.0), distances: Sequence[float] = (2.5, 5.0), passes: int = 3) -> DataFrame:
    """`keep`: false for fixes too fast from both neighbours (km/h), or at the tip of a sharp spike.

    Each pass looks at the fixes kept so far; a spike has an inner angle under angles[i] degrees with
    both sides over distances[i] km.
    """
    out = fixes.withColumn("keep", F.lit(True))
    for _ in range(passes):
        w = Window.partitionBy("id", "keep").orderBy("ts")
        lat, lon = F.radians("lat"), F.radians("lon")
        side = lambda f: spatial.great_circle(lat, lon, f(lat).over(w), f(lon).over(w)) * spatial.EARTH_RADIUS
        hours = lambda f: F.abs(F.unix_micros("ts") - F.unix_micros(f(F.col("ts")).over(w))) / 3.6e9
        back, ahead = side(F.lag), side(F.lead)
        across = spatial.great_circle(F.lag(lat).over(w), F.lag(lon).over(w), F.lead(lat).over(w), F.lead(lon).over(w)) * spatial.EARTH_RADIUS
        cosine = spatial.clamp(F.try_divide(back * back + ahead * ahead - across * across, 2 * back * ahead))
        bad = (F.try_divide(back, hours(F.lag)) > v_max) & (F.try_divide(ahead, hours(F.lead)) > v_max)
        for angle, distance in zip(angles, distances):
            bad = bad | ((F.degrees(F.acos(cosine)) < angle) & (F.least(back, ahead) > distance))
        out = out.withColumn("keep", F.col("keep") & ~F.coalesce(bad, F.lit(False)))
    return out


def shape(points: DataFrame, keys: Sequence[str] = ("id",), order: str = "ts", x: str = "x", y: str = "y") -> DataFrame:
    """Net movement, path length by axis, mean direction and mean turning angle of each group."""
    w = Window.partitionBy(*keys).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    moved = points.withColumns({"_dx": dx, "_dy": dy})
    px, py = F.lag("_dx").over(w), F.lag("_dy").over(w)
    size = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    cosine = F.try_divide(F.col("_dx") * px + F.col("_dy") * py, size * F.sqrt(px * px + py * py))
    turned = moved.withColumn("_turn", F.when(cosine.isNotNull(), F.acos(spatial.clamp(cosine))))  # the clamp takes a null for a number
    return turned.groupBy(*keys).agg(
        (F.max_by(x, order) - F.min_by(x, order)).alias("net_x"), (F.max_by(y, order) - F.min_by(y, order)).alias("net_y"),
        F.sum(F.abs("_dx")).alias("path_x"), F.sum(F.abs("_dy")).alias("path_y"), F.avg(F.atan2("_dy", "_dx")).alias("direction"), F.avg("_turn").alias("turning"), F.count("*").alias("length"),
    )


def hurst(values: np.ndarray, min_size: int = 10) -> float:
    """Rescaled-range exponent of a series, with the Anis-Lloyd correction, within [0, 1]; NaN for short ones."""
    from math import lgamma, pi, sqrt

    x = values[np.isfinite(values)]
    if len(x) < min_size:
        return float("nan")
    sizes, found, expected = [], [], []
    n = len(x)
    while n >= 4:
        parts = x[: len(x) // n * n].reshape(-1, n)
        deviation = np.cumsum(parts - parts.mean(1, keepdims=True), 1)
        spread = parts.std(1, ddof=1)
        ratio = (deviation.max(1) - deviation.min(1))[spread > 0] / spread[spread > 0]
        if len(ratio):
            i = np.arange(1, n)
            front = np.exp(lgamma((n - 1) / 2) - lgamma(n / 2)) / sqrt(pi) if n <= 340 else 1 / sqrt(n * pi / 2)
            sizes.append(n)
            found.append(ratio.mean())
            expected.append(front * np.sqrt((n - i) / i).sum())
        n //= 2
    if len(sizes) < 2:
        return float("nan")
    slope = np.polyfit(np.log(sizes), np.log(found) - np.log(expected), 1)[0] + 0.5
    return float(np.clip(slope, 0, 1))


def hurst_by(points: DataFrame, value: str, order: str = "ts") -> DataFrame:
    """`hurst` of each track's ordered values."""
    lists = points.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("v"))
    lists = lists.repartition(points.sparkSession.sparkContext.defaultParallelism, F.xxhash64("id"))  # lists are small but dear

    @F.pandas_udf("double")
    def of(v: pd.Series) -> pd.Series:
        return v.map(lambda a: hurst(np.asarray(a, float)))

    return lists.select("id", of("v").alias("hurst"))


def reanchor(points: DataFrame, order: str = "ts") -> DataFrame:
    """Tracks rebuilt from their first point's frame at the origin: each step keeps its local components."""

    # Rows come by track in order, marked where a track begins; what is carried from one batch to the next is one place.
    own = points.withColumn("_first", F.row_number().over(along(order=order)) == 1)

    def local(lat, lon):
        """Components to the south and the east of the step to each place from the one before."""
        lat1, lat2, turn = lat[:-1], lat[1:], np.diff(lon)
        east, north = np.cos(lat2) * np.sin(turn), np.sin(lat2) * np.cos(lat1) - np.cos(lat2) * np.sin(lat1) * np.cos(turn)
        size = np.hypot(east, north)
        angle = np.arctan2(size, np.sin(lat1) * np.sin(lat2) + np.cos(lat1) * np.cos(lat2) * np.cos(turn))
        grow = np.where(size > 0, angle / np.where(size > 0, size, 1.0), np.where(np.isnan(size), np.nan, 0.0))
        return (-grow * north).tolist(), (grow * east).tolist()

    def move(lat, lon, s, w):
        size = math.hypot(s, w)
        if not size > 0:
            return (lat, lon) if size == 0 else (math.nan, math.nan)
        sin_lat, cos_lat, ahead, turn = math.sin(lat), math.cos(lat), math.cos(size), math.sin(size) / size
        # In the frame of the place: along its radius and to the south and east of it.
        out, z = cos_lat * ahead + sin_lat * s * turn, sin_lat * ahead - cos_lat * s * turn
        east = w * turn
        x, y = math.cos(lon) * out - math.sin(lon) * east, math.sin(lon) * out + math.cos(lon) * east
        return math.atan2(z, math.hypot(x, y)), math.atan2(y, x)

    def work(frames):
        before, at = (math.nan, math.nan), (0.0, 0.0)
        for f in frames:
            lat, lon = np.radians(f["lat"].to_numpy(float)), np.radians(f["lon"].to_numpy(float))
            if not len(f):
                continue
            out = []
            for first, s, w in zip(f["_first"].tolist(), *local(np.append(before[0], lat), np.append(before[1], lon))):
                at = (0.0, 0.0) if first else move(*at, s, w)
                out.append(at)
            before = lat[-1], lon[-1]
            moved = np.degrees(np.array(out))
            yield f.drop(columns="_first").assign(lat=moved[:, 0], lon=moved[:, 1])

    return own.mapInPandas(work, points.schema)


#: Powers of two into which latitudes and longitudes are cut, coarse to fine, before points meet.
CELL_LEVELS = (3, 5, 7, 9, 11, 13)


def _cells(points: DataFrame, side: str, level: int) -> DataFrame:
    """The occupied cells of each track at the finest level, or their parents at a coarser one."""
    shift = CELL_LEVELS[-1] - level
    return points.select(f"id_{side}", *[F.shiftright(f"{c}_{side}", shift).alias(f"{c}_{side}") for c in "ij"]).distinct()


def _located(points: DataFrame, side: str) -> DataFrame:
    """id, i and j of the finest cell, and radians."""
    n = 1 << CELL_LEVELS[-1]
    i = F.least(F.floor((F.col("lat") + 90) / 180 * n), F.lit(n - 1)).cast("int")
    j = F.least(F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / 360 * n), F.lit(n - 1)).cast("int")
    own = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return own.select(F.col("id").alias(f"id_{side}"), i.alias(f"i_{side}"), j.alias(f"j_{side}"), F.radians("lat").alias(f"lat_{side}"), F.radians("lon").alias(f"lon_{side}"))


def _cap(side: str, level: int) -> tuple[Column, Column, Column]:
    """Centre and radius, in radians, of a cap about a cell: along the centre's parallel and then a meridian no point of it is further."""
    step = math.pi / (1 << level)
    lat = -math.pi / 2 + (F.col(f"i_{side}") + 0.5) * step
    return lat, -math.pi + (F.col(f"j_{side}") + 0.5) * 2 * step, step / 2 + F.cos(lat) * step


def distance_candidates(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of finest cells (i_a, j_a, i_b, j_b) of each stated pair of tracks that may hold its least distance.

    Level by level, a pair of cells whose caps are further apart than the least that any other pair of the same tracks can be is left out, and
    only the occupied children of the rest meet at the next level.
    """
    left, right = _located(a, "a"), _located(b, "b")
    front = pairs.join(_cells(left, "a", CELL_LEVELS[0]), "id_a").join(_cells(right, "b", CELL_LEVELS[0]), "id_b")
    for level, finer in zip(CELL_LEVELS, (*CELL_LEVELS[1:], None)):
        (lat_a, lon_a, r_a), (lat_b, lon_b, r_b) = _cap("a", level), _cap("b", level)
        between = spatial.great_circle(lat_a, lon_a, lat_b, lon_b)
        least = F.min("_hi").over(Window.partitionBy("id_a", "id_b"))
        front = front.withColumns({"_lo": between - r_a - r_b, "_hi": between + r_a + r_b}).withColumn("_least", least)
        front = front.where(F.col("_lo") <= F.col("_least") + 1e-9).drop("_lo", "_hi", "_least")
        if finer is not None:
            for side, cells in (("a", left), ("b", right)):
                child = _cells(cells, side, finer)
                up = [F.shiftright(f"{c}_{side}", finer - level).alias(f"_{c}") for c in "ij"]
                front = front.withColumnsRenamed({f"{c}_{side}": f"_{c}" for c in "ij"}).join(child.select("*", *up), [f"id_{side}", "_i", "_j"]).drop("_i", "_j")
    return front


#: Pairs of points up to which two tracks meet as they are; cells would cost more exchanges than they save distances.
DIRECT_PAIRS = 100_000


def least_distances(a: DataFrame, b: DataFrame, pairs: DataFrame, direct: int = DIRECT_PAIRS) -> DataFrame:
    """least_km between the tracks of each stated pair (id_a, id_b).

    All points of two tracks meet if that makes up to `direct` pairs, which go into the least distance where they are made. Those of longer tracks meet
    only in pairs of cells of a hierarchy on the sphere that can hold the least distance, so their work does not follow the square of their length.
    """
    size = lambda d, side: _located(d, side).groupBy(f"id_{side}").agg(F.count("*").alias(f"_n_{side}"))
    sized = pairs.join(size(a, "a"), "id_a").join(size(b, "b"), "id_b").withColumn("_few", F.col("_n_a") * F.col("_n_b") <= direct)
    few, many = (sized.where(c).select(*pairs.columns) for c in (F.col("_few"), ~F.col("_few")))
    point = lambda d, side: _located(d, side).select(f"id_{side}", f"lat_{side}", f"lon_{side}")
    own = _least(few.join(point(a, "a"), "id_a").join(point(b, "b"), "id_b"))
    front = distance_candidates(a, b, many)
    return own.unionByName(_least(front.join(_located(a, "a"), ["id_a", "i_a", "j_a"]).join(_located(b, "b"), ["id_b", "i_b", "j_b"])))


def _least(met: DataFrame) -> DataFrame:
    """least_km of the pairs of points that met."""
    d = spatial.great_circle(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) * spatial.EARTH_RADIUS
    return met.groupBy("id_a", "id_b").agg(F.min(d).alias("least_km"))


def mean_distances(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """mean_km over all pairs of points of the tracks of each stated pair (id_a, id_b), which is a product by definition.

    Points that fall on one place count once with their number; the product is aggregated on the map side, a partial row a pair and task.
    """
    side = lambda d, s: d.groupBy(F.col("id").alias(f"id_{s}"), F.radians("lat").alias(f"lat_{s}"), F.radians("lon").alias(f"lon_{s}")).agg(F.count("*").alias(f"n_{s}"))
    d = spatial.great_circle(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) * spatial.EARTH_RADIUS
    n = F.col("n_a") * F.col("n_b")
    return pairs.join(side(a, "a"), "id_a").join(side(b, "b"), "id_b").groupBy("id_a", "id_b").agg((F.sum(d * n) / F.sum(n)).alias("mean_km"))


def geodesics(pairs: DataFrame, steps: int) -> DataFrame:
    """`steps` inner points of the geodesic from (lat1, lon1) to (lat2, lon2), degrees."""
    out = pairs.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    lat, lon = spatial.straight_point(F.radians("lat1"), F.radians("lon1"), F.radians("lat2"), F.radians("lon2"), F.col("step") / (steps + 1))
    return out.withColumns({"lat": F.degrees(lat), "lon": F.degrees(lon)})


def local_steps(fixes: DataFrame) -> DataFrame:
    """south_north and west_east of the next fix in each fix's frame, radians; null on a track's last one (P20)."""
    w = along()
    lat, lon = F.radians("lat"), F.radians("lon")
    ahead = fixes.withColumns({"_lat": F.lead(lat).over(w), "_lon": F.lead(lon).over(w)})
    north, east = spatial.step_between(lat, lon, F.col("_lat"), F.col("_lon"))
    return ahead.withColumns({"south_north": -north, "west_east": east}).drop("_lat", "_lon")


def leap_segments(fixes: DataFrame, compat: bool = False) -> DataFrame:
    """`leap`: whether a fix's year is a leap year; `compat` gives each later year of a track the flag of the one before."""
    year = F.year("ts")
    leap = spatial.is_leap(year)
    if not compat:
        return fixes.withColumn("leap", leap)
    years = fixes.select("id", year.alias("_y")).distinct()
    before = F.coalesce(F.lag("_y").over(Window.partitionBy("id").orderBy("_y")), F.col("_y"))
    return fixes.withColumn("_y", year).join(years.select("id", "_y", spatial.is_leap(before).alias("leap")), ["id", "_y"]).drop("_y")


def sampling_step(fixes: DataFrame, unit_minutes: int = 60) -> DataFrame:
    """`dt_mode`: the commonest step of each track in whole units, the least of equals."""
    dt = F.round(calendar.days_between(F.lag("ts").over(along()), F.col("ts")) * (1440 / unit_minutes)).cast("int")
    n = fixes.select("id", dt.alias("dt")).where("dt is not null").groupBy("id", "dt").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.max(F.struct("n", (-F.col("dt")).alias("d"))).alias("m")).select("id", (-F.col("m.d")).alias("dt_mode"))
