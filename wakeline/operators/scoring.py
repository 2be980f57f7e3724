"""Coverage, area, quality, calibration and comparison of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import scores, spatial


def quantile_coverage(predictions: DataFrame, keys: Sequence[str] = ("time_step",)) -> DataFrame:
    """Share of actual values at or below each quantile."""
    return predictions.groupBy(*keys, "quantile").agg(F.avg((F.col("actual") <= F.col("prediction")).cast("int")).alias("coverage"), F.count("actual").alias("n"))


def intervals(predictions: DataFrame, keys: Sequence[str], confidences: Sequence[float] = scores.CONFIDENCES, exact: bool = False) -> DataFrame:
    """lo, hi and length of each confidence from the quantiles around it, in one pass.

    The bounds are the quantiles (1 -+ c) / 2, or with `exact` those of c's square root.
    """
    level = lambda c: c**0.5 if exact else c
    at = lambda q: F.max(F.when(F.abs(F.col("quantile") - q) < 1e-9, F.col("prediction")))
    wide = predictions.groupBy(*keys).agg(F.max("actual").alias("actual"), *[at((1 - level(c)) / 2).alias(f"lo_{i}") for i, c in enumerate(confidences)], *[at((1 + level(c)) / 2).alias(f"hi_{i}") for i, c in enumerate(confidences)])
    each = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("confidence"), F.col(f"lo_{i}").alias("lo"), F.col(f"hi_{i}").alias("hi")) for i, c in enumerate(confidences)])).alias("c")
    long = wide.select(*keys, "actual", each).select(*keys, "actual", "c.*")
    return long.withColumns({"length": F.col("hi") - F.col("lo"), "covered": scores.covered(F.col("actual"), F.col("lo"), F.col("hi"))})


def regions(x: DataFrame, y: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joint rectangles of two intervals: coverage of both and km2 on the sphere."""
    own = lambda d, n: d.select(*keys, "confidence", F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi"), F.col("covered").alias(f"{n}_covered"))
    both = own(x, "x").join(own(y, "y"), [*keys, "confidence"])
    area = spatial.mercator_rectangle_area(F.col("x_lo"), F.col("x_hi"), F.col("y_lo"), F.col("y_hi"))
    return both.withColumns({"covered": F.col("x_covered") * F.col("y_covered"), "area": area})


def mask_missing(df: DataFrame, columns: Sequence[str], missing: str = "missing", length: str | None = None) -> DataFrame:
    """Null scores of missing steps and of steps past the decoder's length."""
    bad = F.col(missing)
    if length:
        bad = bad | (F.col("time_step") >= F.col(length))
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in columns})


def by_step(scored: DataFrame, columns: Sequence[str] = ("covered", "area")) -> DataFrame:
    """Means by step and confidence."""
    return scored.groupBy("time_step", "confidence").agg(*[F.avg(c).alias(c) for c in columns])


def macro(df: DataFrame, value: str, inner: Sequence[str], outer: Sequence[str] = ()) -> DataFrame:
    """Mean of the groups' means."""
    per = df.groupBy(*inner).agg(F.avg(value).alias(value))
    return per.groupBy(*outer).agg(F.avg(value).alias(value)) if outer else per.agg(F.avg(value).alias(value))


def nested_mean(df: DataFrame, value: str, levels: Sequence[str]) -> DataFrame:
    """Mean over the last key, then over the one before it, and so on."""
    for i in reversed(range(len(levels) + 1)):
        df = df.groupBy(*levels[:i]).agg(F.avg(value).alias(value)) if i else df.agg(F.avg(value).alias(value))
    return df


def normalised_mean(df: DataFrame, value: str, step: str = "time_step") -> DataFrame:
    """Step means as shares of their sum, and the running share."""
    per = df.groupBy(step).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))
    every, upto = Window.partitionBy(), Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)  # a row a step
    share = F.try_divide(F.col("mean"), F.sum("mean").over(every))
    return per.withColumn("share", share).withColumn("running", F.sum("share").over(upto))


def coverage_rmse(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Root mean square over steps of coverage less its confidence."""
    per = scored.groupBy(*keys, "time_step", "confidence").agg(F.avg("covered").alias("c"))
    return per.groupBy(*keys, "confidence").agg(F.sqrt(F.avg(F.pow(F.col("c") - F.col("confidence"), 2))).alias("rmse"))


def with_quality(scored: DataFrame) -> DataFrame:
    """q_area from area, area_ref and area_max."""
    return scored.withColumn("q_area", scores.area_quality(F.col("area"), F.col("area_ref"), F.col("area_max")))


def quality(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """q_coverage, q_area and their product by some keys: means by confidence first, then over confidences."""
    per = scored.groupBy(*by, "confidence").agg(F.avg("covered").alias("c"), F.avg("q_area").alias("q_area"))
    per = per.withColumn("q_coverage", scores.coverage_quality(F.col("c"), F.col("confidence")))
    out = per.groupBy(*by) if by else per.groupBy()
    return out.agg(F.avg("q_coverage").alias("q_coverage"), F.avg("q_area").alias("q_area")).withColumn("quality", F.col("q_coverage") * F.col("q_area"))


def calibration_grid(bounds: DataFrame, factors: Sequence[float]) -> DataFrame:
    """RMSE of coverage for every factor and confidence, bounds widened by the factor, open when calibrating."""
    grid = F.explode(F.array(*[F.lit(float(f)) for f in factors]))
    wide = bounds.withColumn("factor", grid)
    lo, hi = scores.widen(F.col("lo"), F.col("hi"), F.col("factor"))
    return coverage_rmse(wide.withColumn("covered", scores.covered(F.col("actual"), lo, hi, closed=False)), ["factor"])


def best_factor(grid: DataFrame) -> DataFrame:
    """The factor of least RMSE at three decimals, of equals the smallest in size."""
    rank = F.struct(F.round("rmse", 3).alias("r"), F.abs("factor").alias("a"), "factor")
    return grid.groupBy("confidence").agg(F.min(rank).alias("m")).select("confidence", F.col("m.factor").alias("factor"), F.col("m.r").alias("rmse"))


def best_model(summary: DataFrame, value: str = "value", spread: str = "std", highest: bool = True) -> DataFrame:
    """The best value at four decimals, of equals the least spread."""
    v = F.round(value, 4)
    return summary.orderBy(v.desc() if highest else v.asc(), spread, *[c for c in summary.columns if c not in (value, spread)]).limit(1)


def top(df: DataFrame, column: Column, k: int) -> DataFrame:
    """The k largest, ties by all columns."""
    return df.orderBy(column.desc(), *df.columns).limit(k)


def tied_with_best(summary: DataFrame, value: str, lo: str, hi: str, group: Sequence[str] = (), highest: bool = True) -> DataFrame:
    """`best`: the best of each group, `tied`: its interval meets the best one's."""
    rank = F.struct(value, lo, hi)
    w = Window.partitionBy(*group)
    top_row = (F.max if highest else F.min)(rank).over(w)
    out = summary.withColumn("_top", top_row)
    return out.withColumns({"best": F.col(value) == F.col(f"_top.{value}"), "tied": (F.col(lo) <= F.col(f"_top.{hi}")) & (F.col(hi) >= F.col(f"_top.{lo}"))}).drop("_top")


def point_errors(df: DataFrame) -> DataFrame:
    """Great-circle km, MAE and RMSE of predicted (px, py) against (x, y) on the Mercator plane."""
    ll, pp = spatial.mercator_inverse(F.col("x"), F.col("y")), spatial.mercator_inverse(F.col("px"), F.col("py"))
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    return df.withColumns({"km": spatial.great_circle(*ll, *pp) * spatial.EARTH_RADIUS, "mae": (F.abs(dx) + F.abs(dy)) / 2, "rmse": F.sqrt((dx * dx + dy * dy) / 2)})


def relative_improvement(errors: DataFrame, baseline: DataFrame, keys: Sequence[str], value: str = "km") -> DataFrame:
    """Median by step of the share by which an error is below the baseline's."""
    own = errors.select(*keys, F.col(value).alias("_e")).join(baseline.select(*keys, F.col(value).alias("_b")), list(keys))
    return own.groupBy("time_step").agg(F.percentile(F.try_divide(F.col("_b") - F.col("_e"), F.col("_b")), 0.5).alias("improvement"))


def quantile_loss(predictions: DataFrame, keys: Sequence[str] = (), missing: str | None = None) -> DataFrame:
    """Mean pinball loss, missing steps left out."""
    loss = scores.pinball(F.col("actual"), F.col("prediction"), F.col("quantile"))
    own = predictions.where(~F.col(missing)) if missing else predictions
    return own.groupBy(*keys).agg(F.avg(loss).alias("loss"))


def criterion(scored: DataFrame, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """Coverage against its target by one of rae, arae, diff, adiff, ae, std."""
    c, t = F.col("covered"), F.col("confidence")
    per = scored.groupBy(*keys, "confidence", "time_step").agg(F.avg(c).alias("covered"))
    d = {"rae": F.avg((t - c) / t), "arae": F.avg(F.abs(t - c) / t), "diff": F.avg(c - t), "adiff": F.abs(F.avg(c - t)), "ae": F.avg(F.abs(c - t)), "std": F.stddev_samp(c)}[kind]
    return per.groupBy(*keys, "confidence").agg(d.alias(kind))


def asymmetry(bounds: DataFrame) -> DataFrame:
    """Ratio of the longer to the shorter side about the median, and which side is longer."""
    up, down = F.col("hi") - F.col("median"), F.col("median") - F.col("lo")
    return bounds.withColumns({"asymmetry": F.when(up > down, F.try_divide(up, down)).otherwise(F.try_divide(down, up)), "right_tail": up > down})


def area_growth(scored: DataFrame, keys: Sequence[str], low: float = 0.5, high: float = 0.95) -> DataFrame:
    """Area at the high over that at the low confidence."""
    at = lambda c: F.max(F.when(F.abs(F.col("confidence") - c) < 1e-9, F.col("area")))
    return scored.groupBy(*keys).agg(F.try_divide(at(high), at(low)).alias("growth"))


def joint_error(c1: Column, exact: bool = True) -> Column:
    """Error of a rectangle of two intervals of confidence c1."""
    return 1 - c1 * c1 if exact else 2 * (1 - c1)


def variable_response(df: DataFrame, variables: Sequence[str], actual: str, predicted: str, bins: int = 95) -> DataFrame:
    """Mean actual and predicted value by variable and standardised bin, with its count."""
    p = (bins - 1) // 2
    sd = df.agg(*[F.stddev_samp(v).alias(f"_sd_{v}") for v in variables])
    own = df.join(F.broadcast(sd))  # one row
    code = lambda v: F.greatest(F.lit(-p), F.least(F.lit(p), F.round(F.try_divide(F.col(v) * p, F.col(f"_sd_{v}"))))).cast("int") + p
    flat = own.select(actual, predicted, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), code(v).alias("bin")) for v in variables])).alias("s"))
    return flat.groupBy("s.variable", "s.bin").agg(F.avg(actual).alias("actual"), F.avg(predicted).alias("predicted"), F.count("*").alias("n"))


def learning_curve(scores: DataFrame, value: str, size: str = "n_deleted", seed: str = "seed") -> DataFrame:
    """Mean over seeds of each cohort size's macro mean, with its normal interval and the seeds' range.

    A seed's score is the mean over animals of each animal's mean.
    """
    animals = scores.groupBy(size, seed, "id").agg(F.avg(value).alias("_v"))
    seeds = animals.groupBy(size, seed).agg(F.avg("_v").alias("_v"))
    half = 1.959963984540054 * F.stddev_samp("_v") / F.sqrt(F.count("*"))
    return seeds.groupBy(size).agg(F.avg("_v").alias("mean"), (F.avg("_v") - half).alias("lo"), (F.avg("_v") + half).alias("hi"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.count("*").alias("seeds"))


def summary_table(scores: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("model",), unit: str = "id") -> DataFrame:
    """model, metric, mean, lo and hi: every metric averaged by unit, then over units with a normal interval."""
    per = scores.groupBy(*keys, unit).agg(*[F.avg(m).alias(m) for m in metrics])
    long = per.unpivot([*keys, unit], list(metrics), "metric", "_v")
    half = 1.959963984540054 * F.stddev_samp("_v") / F.sqrt(F.count("_v"))
    return long.groupBy(*keys, "metric").agg(F.avg("_v").alias("mean"), (F.avg("_v") - half).alias("lo"), (F.avg("_v") + half).alias("hi"))
