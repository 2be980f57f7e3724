"""Joins of tracks with metadata, context grids and other tracks; time joins get an equi key by bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast; the optimizer's estimate decides.
SMALL_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Broadcast a side whose estimated size is within the limit, else leave the choice to the optimizer."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def with_static(df: DataFrame, meta: DataFrame, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Static features of a row's id."""
    return df.join(small(meta.select("id", *columns)), "id", how)


def lookup(df: DataFrame, values: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A table of few rows by key: error factors, calibration multipliers."""
    return df.join(small(values), list(keys), how)


def only_with(df: DataFrame, index: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return df.join(index.select(*keys), list(keys), "left_semi")


def only_without(df: DataFrame, index: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return df.join(index.select(*keys), list(keys), "left_anti")


def aligned(*frames: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Frames of one row a key side by side; of columns that repeat, the first one stays."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f.select(*keys, *[c for c in f.columns if c not in out.columns]), list(keys), how)
    return out


def asof(left: DataFrame, right: DataFrame, values: Sequence[str], hours: float, forward: bool = False, on: str = "id", ts: str = "ts") -> DataFrame:
    """Mean of the right rows strictly before (or after) a left row and less than hours + 1 away; where there is
    none, the nearest right row before (or after) at any distance (J6, J7).

    Both sides are merged in time order and summed by range frames over the track, so no pair of rows is formed.
    """
    span = int((hours + 1) * 3_600_000_000)
    sign = -1 if forward else 1
    t = F.unix_micros(ts) * sign
    l = left.select("*", t.alias("_t"), F.lit(True).alias("_left"), *[F.lit(None).cast("double").alias(f"_{v}") for v in values])
    r = right.select(F.col(on), t.alias("_t"), F.lit(False).alias("_left"), *[F.col(v).cast("double").alias(f"_{v}") for v in values])
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(on).orderBy("_t")
    near = w.rangeBetween(-span + 1, -1)
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    last_time = F.max(F.when(~F.col("_left"), F.col("_t"))).over(before)
    out = both.withColumn("_last", last_time)
    for v in values:
        latest = F.max(F.when(~F.col("_left"), F.struct("_t", f"_{v}"))).over(before)[f"_{v}"]
        out = out.withColumn(f"{v}_base", F.coalesce(F.avg(F.when(~F.col("_left"), F.col(f"_{v}"))).over(near), latest))
    out = out.withColumn("base_gap_hours", (F.col("_t") - F.col("_last")) / F.lit(3.6e9))
    return out.where("_left").select(*left.columns, *[f"{v}_base" for v in values], "base_gap_hours")


def nearest_grid(fixes: DataFrame, grid: DataFrame, cell: float = 0.25, value: str | Sequence[str] = "value") -> DataFrame:
    """The grid value, or several ones, of the nearest hour and cell, ties to the lower latitude and longitude index.

    Both sides round to the same hour and cell, which makes an equi join of what is a nearest-neighbour search. Of a finer grid, the value
    nearest to the middle of the cell and hour counts, and of equally near ones the least.
    """
    key = lambda d: {"_h": F.round(F.unix_timestamp("ts") / 3600).cast("long"), "_i": F.round(d["lat"] / cell).cast("int"), "_j": F.pmod(F.round(d["lon"] / cell).cast("int"), F.lit(int(360 / cell)))}
    off = F.abs(F.col("lat") / cell - F.round(F.col("lat") / cell)) + F.abs(F.col("lon") / cell - F.round(F.col("lon") / cell)) + F.abs(F.unix_timestamp("ts") / 3600 - F.col("_h"))
    best = lambda v: F.min(F.when(F.col(v).isNotNull(), F.struct(off.alias("off"), F.col(v).alias("v"))))["v"].alias(v)
    g = grid.withColumns(key(grid)).groupBy("_h", "_i", "_j").agg(*[best(v) for v in ([value] if isinstance(value, str) else value)])
    return fixes.withColumns(key(fixes)).join(g, ["_h", "_i", "_j"], "left").drop("_h", "_i", "_j")


def nearest_cell(points: DataFrame, cells: DataFrame, x: str, y: str, width_x: float, width_y: float) -> DataFrame:
    """The value of the cell, named by its centre on a regular grid, that a point falls nearest to."""
    key = lambda d: {"_i": F.round(d[x] / width_x).cast("int"), "_j": F.round(d[y] / width_y).cast("int")}
    return points.withColumns(key(points)).join(small(cells.withColumns(key(cells)).drop(x, y)), ["_i", "_j"], "left").drop("_i", "_j")


def by_edges(df: DataFrame, edges: Sequence[float], column: str, out: str) -> DataFrame:
    """Bin number by right-closed edges fitted elsewhere, the lowest included; null outside."""
    code = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        lower = (F.col(column) >= edges[i]) if i == 0 else (F.col(column) > edges[i])
        code = F.when(lower & (F.col(column) <= edges[i + 1]), i).otherwise(code)
    return df.withColumn(out, code)


def aligned_predictions(model: DataFrame, real: DataFrame, base: DataFrame, keys: Sequence[str] = ("id", "time_idx")) -> DataFrame:
    """Rows that model and reality share, columns of reality and of the baseline suffixed, with the baseline where it has the key."""
    def named(d, suffix):
        return d.select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in d.columns if c not in keys])

    return model.join(named(real, "real"), list(keys)).join(named(base, "base"), list(keys), "left")


def side_by_side(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The columns of both tables, rows met by a key instead of by position (J9); the same name on both sides is an error."""
    if twice := {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {on.lower()}:
        raise ValueError(f"columns on both sides: {sorted(twice)}")
    return left.join(right, on, "left")
