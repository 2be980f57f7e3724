"""Readers and writers of fixes, metadata, model output and context grids."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("ID", "DATE_TIME", "LATITUDE", "LONGITUDE")


def read_fixes(spark: SparkSession, path: str, covariates: tuple[str, ...] = ()) -> DataFrame:
    """Raw fixes from CSV with an explicit schema; missing columns fail at once, NaN becomes null."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := set(REQUIRED) - set(header):
        raise ValueError(f"columns missing: {sorted(missing)}")
    kinds = {"ID": T.StringType(), "DATE_TIME": T.TimestampType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in header])
    raw = spark.read.option("header", True).schema(schema).csv(path)
    keep = covariates or [c for c in header if c not in REQUIRED]
    return raw.select(F.col("ID").alias("id"), F.col("DATE_TIME").alias("ts"), F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lon"), *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in keep])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per id; species is empty where the column is missing."""
    raw = spark.read.option("header", True).csv(path)
    species = F.col("Species") if "Species" in raw.columns else F.lit("")
    rest = [c for c in raw.columns if c not in ("ID", "Species")]
    return raw.select(F.col("ID").alias("id"), species.alias("species"), *[(F.col(c).cast("double") if c in ("Weight", "Length") else F.col(c)).alias(c.lower()) for c in rest])


def read_folder(spark: SparkSession, folder: str, *parts: str, token: int = 3) -> DataFrame:
    """All CSV files of a folder whose names hold every part; the id comes from the file name."""
    df = spark.read.option("header", True).csv(folder).withColumn("file", F.col("_metadata.file_name"))
    for part in parts:
        df = df.where(F.col("file").contains(part))
    return df.withColumn("file_id", F.get(F.split(F.regexp_replace("file", r"\.[^.]*$", ""), "_"), F.lit(token - 1)))


def valid_ids(files: DataFrame) -> DataFrame:
    """Ids whose file has more than one row."""
    return files.groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1").select("file_id")


def union_parts(*parts: DataFrame) -> DataFrame:
    """Union by name of partitions, without repeated rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates()


def read_year(spark: SparkSession, path: str, year: int, ts: str = "ts") -> DataFrame:
    """Rows of one year; the file layout by year prunes the scan."""
    df = spark.read.parquet(path)
    return df.where(F.col("year") == year) if "year" in df.columns else df.where(F.year(ts) == year)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line and row of one text file, numbered from 0: a file's blocks are numbered side by side, each from where those before it end."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_at", F.monotonically_increasing_id())
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("_block").agg(F.count("*").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy("_at")) - 1
    return lines.join(F.broadcast(blocks), "_block").select("line", (own + F.col("_before")).cast("int").alias("row"))  # a row a block


def read_text_grid(spark: SparkSession, path: str, cell: float = 0.25, north: float = 90.0, west: float = -180.0) -> DataFrame:
    """A white-space matrix of a grid from north to south as (lat, lon, value); land, above zero, is zero (S14). Empty lines count for nothing."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    cells = lines.select("row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    return cells.select((F.lit(north) - (F.col("row") + 0.5) * cell).alias("lat"), (F.lit(west) + (F.col("col") + 0.5) * cell).alias("lon"), F.least(F.col("v").cast("double"), F.lit(0.0)).alias("value"))


def bounding_boxes(fixes: DataFrame, margin: float = 0.25) -> DataFrame:
    """The box of the fixes of each month, widened and clamped to the globe."""
    lo = lambda c, least: F.greatest(F.min(c) - margin, F.lit(least))
    hi = lambda c, most: F.least(F.max(c) + margin, F.lit(most))
    return fixes.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month")).agg(lo("lat", -90.0).alias("south"), hi("lat", 90.0).alias("north"), lo("lon", -180.0).alias("west"), hi("lon", 180.0).alias("east"))


def reference_point(fixes: DataFrame) -> DataFrame:
    """Mean latitude and longitude of all fixes, in radians."""
    return fixes.agg(F.avg(F.radians("lat")).alias("lat0"), F.avg(F.radians("lon")).alias("lon0"))


def write_parts(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by columns, committed as a whole (K1 to K4)."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def cached_table(df_of, spark: SparkSession, folder: str, **params) -> DataFrame:
    """The result of `df_of(**params)`, kept under a key of the function, by module and name, and its arguments, defaults among them (K5)."""
    if "<lambda>" in df_of.__qualname__:
        raise ValueError("a function without a name of its own cannot be told from others")
    bound = inspect.signature(df_of).bind(**params)
    bound.apply_defaults()
    key = hashlib.sha256(json.dumps({"of": f"{df_of.__module__}.{df_of.__qualname__}", **bound.arguments}, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # only a missing table is computed
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df_of(**params).write.parquet(path)
    return spark.read.parquet(path)


def batch_table(df: DataFrame, key: Sequence[str], length: str, size: int = 128, width: int = 8, seed: int = 0, parts: int = 256) -> DataFrame:
    """The rows with bucket, batch and slot: batches of `size` rows whose lengths lie within `width` of each other.

    A bucket's rows are numbered without gaps in the order of a seeded MD5 hash, in `parts` ranges of it side by side, so the same seed gives the same
    batches whatever the partitions are, no task sees a whole bucket, and each bucket ends in one batch that may be smaller. Padding to
    the longest of a batch adds less than `width` steps a row. Rows are named by `key`; repeated ones stay apart by their order.
    """
    mixed = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    part = F.floor(F.conv(F.substring("_mixed", 1, 4), 16, 10).cast("int") * parts / 65536).cast("int")
    coded = df.withColumns({"bucket": F.floor(F.col(length) / width).cast("int"), "_mixed": mixed}).withColumn("_part", part)
    before = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = coded.groupBy("bucket", "_part").agg(F.count("*").alias("_n")).select("bucket", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("bucket", "_part").orderBy("_mixed", *key)
    place = F.row_number().over(w) - 1 + F.col("_before")
    numbered = coded.join(sizes, ["bucket", "_part"]).withColumn("_place", place)
    return numbered.select(*df.columns, "bucket", F.floor(F.col("_place") / size).cast("long").alias("batch"), (F.col("_place") % size).cast("int").alias("slot"))


def write_batches(batched: DataFrame, path: str, shards: int = 64, seed: int = 0) -> None:
    """A folder a shard, each with whole batches in a seeded order: what a reader goes through from front to back."""
    own = batched.withColumn("_turn", F.md5(F.concat_ws(":", F.col("bucket"), F.col("batch"), F.lit(str(seed)))))
    own = own.withColumn("shard", F.pmod(F.xxhash64("_turn"), F.lit(shards)).cast("int"))
    own.repartition(shards, "shard").sortWithinPartitions("shard", "_turn", "slot").drop("_turn").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_batches(spark: SparkSession, path: str, shards: Sequence[int] | None = None) -> DataFrame:
    """The batches of some shards, or of all; a shard's rows are those of its folder only, which the scan is pruned to."""
    out = spark.read.parquet(path)
    return out if shards is None else out.where(F.col("shard").isin(list(shards)))


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    real = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.select([clean(c).alias(c) if c in real else F.col(c) for c in df.columns])


def name_matches(column: Column, *parts: str) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & column.contains(p)
    return out
