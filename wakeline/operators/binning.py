"""Time bins, splits, eligibility and data set statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import calendar


def year_bins(fixes: DataFrame, bins: int = 1460) -> DataFrame:
    """`time_idx`: equal bins over the data's range of days of the year, right-closed, counted on through the years from 0 (A1)."""
    day = fixes.withColumns({"_day": calendar.day_of_year(F.col("ts")), "_year": F.year("ts")})
    ends = day.agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi"), F.min("_year").alias("_first"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    code = F.greatest(F.ceil(F.try_divide(F.col("_day") - F.col("_lo"), width)) - 1, F.lit(0))
    coded = day.join(F.broadcast(ends)).withColumn("time_idx", (code + (F.col("_year") - F.col("_first")) * bins).cast("int"))
    least = coded.agg(F.min("time_idx").alias("_least"))
    return coded.join(F.broadcast(least)).withColumn("time_idx", F.col("time_idx") - F.col("_least")).drop("_day", "_year", "_lo", "_hi", "_first", "_least")


def mean_by_bin(df: DataFrame, columns: Sequence[str], circular: Sequence[str] = ()) -> DataFrame:
    """Mean of each column by id and time_idx, bins with a null left out; circular ones, in radians, on the
    circle where they cross the date line (A2, A3)."""
    def mean(c):
        if c not in circular:
            return F.avg(c)
        return F.when((F.max(c) > 2) & (F.min(c) < -2), calendar.circular_mean(F.col(c))).otherwise(F.avg(c))

    return df.groupBy("id", "time_idx").agg(*[mean(c).alias(c) for c in columns]).na.drop("any")


def calendar_bins(fixes: DataFrame, hours: int = 6) -> DataFrame:
    """Bins of whole hours: mean lat, lon's mean, or its median where signs differ, and the first lc (A4)."""
    lon = F.when((F.min("lon") < 0) & (F.max("lon") > 0), F.expr("percentile(lon, 0.5)")).otherwise(F.avg("lon"))
    out = fixes.groupBy("id", F.window("ts", f"{hours} hours").alias("w")).agg(F.avg("lat").alias("lat"), lon.alias("lon"), F.min_by("lc", F.struct("ts", "lc")).alias("lc"), F.count("*").alias("n"))
    return out.select("id", F.col("w.start").alias("bin"), "lat", "lon", "lc", "n")


def cutoffs(df: DataFrame, shares: Sequence[float] = (0.8, 0.9, 1.0), column: str = "time_idx") -> DataFrame:
    """Linear percentiles, cut to whole numbers, in one row (A5)."""
    p = df.agg(F.percentile(column, F.array(*[F.lit(s) for s in shares])).alias("p"))
    return p.select(*[F.get("p", F.lit(i)).cast("int").alias(f"cut{i}") for i in range(len(shares))])


def split(df: DataFrame, shares: Sequence[float] = (0.8, 0.9, 1.0), column: str = "time_idx", distinct: bool = False) -> DataFrame:
    """`split`: train, val or test by the percentiles of the rows, or of the distinct (id, time)."""
    base = df.select("id", column).distinct() if distinct else df
    cut = F.broadcast(cutoffs(base, shares, column))
    label = F.when(F.col(column) <= F.col("cut0"), "train").when(F.col(column) <= F.col("cut1"), "val").otherwise("test")
    return df.join(cut).withColumn("split", label).drop(*[f"cut{i}" for i in range(len(shares))])


def split_counts(df: DataFrame) -> DataFrame:
    """Rows of each split by id."""
    n = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(s)
    return df.groupBy("id").agg(n("train"), n("val"), n("test"))


def eligible(df: DataFrame, minima: dict[str, int], min_days: float = 0, hours: float = 6.0) -> DataFrame:
    """Ids with enough rows in each split and a long enough span."""
    span = (F.max("time_idx") - F.min("time_idx")) * hours / 24
    spans = df.groupBy("id").agg(span.alias("days"), *[F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}") for s in minima])
    keep = F.col("days") >= min_days
    for s, n in minima.items():
        keep = keep & (F.col(f"n_{s}") >= n)
    return spans.where(keep).select("id")


def commonest_year(fixes: DataFrame) -> DataFrame:
    """The year most of a track's rows are of, the earliest of equals."""
    n = fixes.groupBy("id", F.year("ts").alias("year")).agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.max(F.struct("n", (-F.col("year")).alias("y"))).alias("m")).select("id", (-F.col("m.y")).alias("year"))


def subsample(fixes: DataFrame, delete: float, seed: int = 0) -> DataFrame:
    """Drop a share of the ids of each commonest year, by a seeded hash."""
    years = commonest_year(fixes)
    n = F.row_number().over(Window.partitionBy("year").orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id"))
    total = F.count("*").over(Window.partitionBy("year"))
    kept = years.withColumn("_n", n).withColumn("_keep", F.greatest(F.lit(1), F.round(total * (1 - delete)))).where("_n <= _keep").select("id")
    return fixes.join(kept, "id", "left_semi")


def calendar_features(binned: DataFrame, day: str = "t") -> DataFrame:
    """month, season, cos_t and sin_t of a mean day of the year."""
    month = calendar.month_index(F.col(day))
    cos_t, sin_t = calendar.year_turn(F.col(day))
    return binned.withColumns({"month": month.cast("string"), "season": calendar.season(month), "cos_t": cos_t, "sin_t": sin_t})


def dataset_stats(fixes: DataFrame) -> DataFrame:
    """Tracks and the means over tracks of fixes, days and sampling hours."""
    per = fixes.groupBy("id").agg(F.count("*").alias("n"), calendar.days_between(F.min("ts"), F.max("ts")).alias("days"))
    per = per.withColumn("hours", F.try_divide(F.col("days") * 24, F.col("n") - 1))
    return per.agg(F.count("*").alias("tracks"), F.avg("n").alias("mean_fixes"), F.avg("days").alias("mean_days"), F.avg("hours").alias("mean_hours"))


def holdout(fixes: DataFrame, test_days: float = 7) -> DataFrame:
    """`split`: the last days of each track are test."""
    end = F.max("ts").over(Window.partitionBy("id"))
    return fixes.withColumn("split", F.when(calendar.days_between(F.col("ts"), end) < test_days, "test").otherwise("train"))


def alternating_blocks(fixes: DataFrame, train_days: float = 28, test_days: float = 7, least: int = 8) -> DataFrame:
    """`split` by turns of training and test days from a track's start; test blocks of too few fixes train."""
    first = F.min("ts").over(Window.partitionBy("id"))
    at = calendar.days_between(first, F.col("ts"))
    block = F.floor(at / (train_days + test_days)).cast("int")
    test = (at - block * (train_days + test_days)) >= train_days
    out = fixes.withColumns({"block": block, "_test": test})
    n = F.count("*").over(Window.partitionBy("id", "block", "_test"))
    return out.withColumn("split", F.when(F.col("_test") & (n >= least), "test").otherwise("train")).drop("_test")


def prediction_times(train: DataFrame, test: DataFrame) -> DataFrame:
    """Times to predict: those of the test set, and four and eight hours past the end of tracks without one."""
    rest = train.join(test.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.max("ts").alias("end"))
    more = rest.select("id", F.explode(F.array(F.col("end") + F.expr("interval 4 hours"), F.col("end") + F.expr("interval 8 hours"))).alias("ts"))
    return test.select("id", "ts").unionByName(more)
