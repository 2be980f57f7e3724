"""Stand-ins for tracks, metadata and predictions on the driver's tables; the mapping is frozen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.operators import stats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.expr("-75 + cast((event_id * 37) % 5000 as double) / cast(100 as double)").alias("lat"),
        F.expr("-180 + cast((event_id * 101) % 36000 as double) / cast(100 as double)").alias("lon"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("event_type").alias("lc"),
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("species"), F.col("c_acctbal").alias("weight"))


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean position and covariates by id and six-hour bin since the epoch, added in the order of events."""
    bin_of = F.floor(F.unix_timestamp("ts") / 21600).cast("int")
    return stats.ordered_means(fixes(spark, sf_dir).withColumn("time_idx", bin_of), ["id", "time_idx"], ["lat", "lon", "value", "k"], "event_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile stand-ins: the bin before as the median, 10, 20 and 30 to either side as six more."""
    w = Window.partitionBy("id").orderBy("time_idx")
    b = binned(spark, sf_dir).select("id", "time_idx", F.col("value").alias("actual"), F.lag("value").over(w).alias("centre"), (F.row_number().over(w) % 28).alias("time_step"))
    spread = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.lit(d).cast("double").alias("d")) for q, d in ((0.025, -30), (0.05, -20), (0.25, -10), (0.5, 0), (0.75, 10), (0.95, 20), (0.975, 30))]))
    return b.where("centre is not null").withColumn("s", spread).select("id", "time_idx", "time_step", "actual", F.col("s.quantile").alias("quantile"), (F.col("centre") + F.col("s.d")).alias("prediction"))
