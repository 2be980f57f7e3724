"""Raster grids in tiles: points meet the tile they fall in and look their value up inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiles(grid: DataFrame, cell: float, size: int = 64, value: str = "value") -> DataFrame:
    """tile_i, tile_j and `cells` of a raster of (lat, lon, value), rows from south to north.

    A tile is an array of (size + 1) squared values, row by row, null where the raster has none. Its last row and column are the first ones of
    the tiles beyond, round the globe, so that the four cells about a point are always in one tile. Two values of one cell give
    the greater one. A raster is made of tiles by a shuffle of its cells; no task holds more than tiles.
    """
    around, s = round(360 / cell), size + 1
    own = grid.where(F.col(value).isNotNull()).select(F.floor((F.col("lat") + 90) / cell).cast("int").alias("i"), F.pmod(F.floor((F.col("lon") + 180) / cell), F.lit(around)).cast("int").alias("j"), F.col(value).cast("double").alias("v"))
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    at = lambda t, a: F.struct(t.alias("t"), a.cast("int").alias("a"))
    inner = lambda c: at(tile(c), F.col(c) % size)
    rows = F.when((F.col("i") % size == 0) & (F.col("i") > 0), F.array(inner("i"), at(tile("i") - 1, F.lit(size)))).otherwise(F.array(inner("i")))
    last = (around - 1) // size
    wrapped = F.when(F.col("j") == 0, F.array(inner("j"), at(F.lit(last), F.lit(around - last * size))))
    columns = wrapped.when(F.col("j") % size == 0, F.array(inner("j"), at(tile("j") - 1, F.lit(size)))).otherwise(F.array(inner("j")))
    placed = own.withColumn("r", F.explode(rows)).withColumn("c", F.explode(columns)).select(F.col("r.t").alias("tile_i"), F.col("c.t").alias("tile_j"), (F.col("r.a") * s + F.col("c.a")).alias("p"), "v")
    empty = placed.select("tile_i", "tile_j").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(s * s - 1))).alias("p")).withColumn("v", F.lit(None).cast("double"))
    dense = placed.unionByName(empty).groupBy("tile_i", "tile_j", "p").agg(F.max("v").alias("v"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda e: e["v"])
    return dense.groupBy("tile_i", "tile_j").agg(cells.alias("cells"))


def value_at(points: DataFrame, tiled: DataFrame, cell: float, out: str, size: int = 64, how: str = "bilinear") -> DataFrame:
    """The points with the raster's value: that of the nearest cell, or bilinear between the four about it.

    Where one of the four is missing the nearest cell counts. Null where there is none, or no position. Points and tiles meet by tile; a
    tile that many points fall in is a join key like any other, which adaptive execution splits on the points' side.
    """
    around, up, s = round(360 / cell), round(180 / cell), size + 1
    i = F.least(F.greatest((F.col("lat") + 90) / cell - 0.5, F.lit(0.0)), F.lit(float(up - 1)))
    j = F.pmod((F.col("lon") + 180) / cell - 0.5, F.lit(float(around)))
    own = points.withColumns({"_i": i, "_j": j}).withColumns({"_i0": F.least(F.floor("_i"), F.lit(up - 2)).cast("int"), "_j0": F.floor("_j").cast("int")})
    own = own.withColumns({"_a": (F.col("_i0") % size).cast("int"), "_b": (F.col("_j0") % size).cast("int"), "_ti": F.floor(F.col("_i0") / size).cast("int"), "_tj": F.floor(F.col("_j0") / size).cast("int")})
    named = tiled.select(F.col("tile_i").alias("_ti"), F.col("tile_j").alias("_tj"), F.col("cells").alias("_cells"))
    met = own.join(named, ["_ti", "_tj"], "left")
    at = lambda a, b: F.get("_cells", (F.col("_a") + a) * s + F.col("_b") + b)
    fi, fj = F.col("_i") - F.col("_i0"), F.col("_j") - F.col("_j0")
    nearest = F.get("_cells", (F.col("_a") + F.when(fi >= 0.5, 1).otherwise(0)) * s + F.col("_b") + F.when(fj >= 0.5, 1).otherwise(0))
    value: Column = nearest
    if how == "bilinear":
        value = F.coalesce((at(0, 0) * (1 - fj) + at(0, 1) * fj) * (1 - fi) + (at(1, 0) * (1 - fj) + at(1, 1) * fj) * fi, nearest)
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()  # bounds take a null for a number
    return met.withColumn(out, F.when(placed, value)).select(*points.columns, out)
