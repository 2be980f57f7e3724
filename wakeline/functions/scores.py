"""Scores of intervals, regions and point predictions as Column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joint confidences reported by default.
CONFIDENCES = (0.5, 0.9, 0.95)


def alpha_1d(alpha: Column) -> Column:
    """Error of each of two independent intervals whose product has error alpha (Q1)."""
    return 1 - F.sqrt(1 - alpha)


def exact_quantiles(confidence: float) -> tuple[float, float]:
    """Lower and upper quantile of either axis for a joint confidence (Q2)."""
    half = (1 - confidence**0.5) / 2
    return half, 1 - half


def quantile_grid(step_percent: float = 1.0) -> list[float]:
    """Evenly spaced quantiles with the median among them."""
    n = int(100 / step_percent)
    grid = [i / (n - 1) for i in range(1, n - 1)] if step_percent <= 1 else [0.01 + 0.98 * i / (n - 1) for i in range(n)]
    return grid if any(abs(q - 0.5) < 1e-12 for q in grid) else sorted([*grid, 0.5])


def relative_error(x: Column, target: Column) -> Column:
    """(target - x) / target; null for a zero target (Q3)."""
    return F.try_divide(target - x, target)


def area_quality(area: Column, least: Column, most: Column) -> Column:
    """1 at the reference area, 0 at the largest, logarithmic between; null where the two are equal (Q4)."""
    within = F.when(area < least, least).when(area > most, most).otherwise(area)
    return 1 - F.try_divide(F.log(F.try_divide(within, least)), F.log(F.try_divide(most, least)))


def coverage_quality(coverage: Column, target: Column) -> Column:
    """1 - |ln(alpha / alpha*) / ln alpha*| of the errors, and 1 where the error is below its target (Q5)."""
    error, goal = 1 - coverage, 1 - target
    return F.when(error < goal, 1.0).otherwise(1 - F.abs(F.try_divide(F.log(error / goal), F.log(goal))))


def coverage_quality_symmetric(coverage: Column, target: Column) -> Column:
    """The same, also falling below the target error, and 0 from its square on (Q5)."""
    error, goal = 1 - coverage, 1 - target
    inner = 1 - F.abs(F.try_divide(F.log(F.when(error > 0, error) / goal), F.log(goal)))
    return F.when(error <= goal * goal, 0.0).otherwise(F.greatest(F.lit(0.0), inner))


def pinball(value: Column, prediction: Column, quantile: Column) -> Column:
    """Twice the quantile loss (Q6)."""
    e = value - prediction
    return 2 * F.greatest((quantile - 1) * e, quantile * e)


def widen(lo: Column, hi: Column, factor: Column) -> tuple[Column, Column]:
    """Bounds moved outward by a share of their size (Q14)."""
    return lo - F.abs(lo) * factor, hi + F.abs(hi) * factor


def expand_about(value: Column, centre: Column, factor: Column) -> Column:
    """A quantile moved away from the median by a factor (Q15)."""
    return centre + (value - centre) * (1 + factor)


def covered(value: Column, lo: Column, hi: Column, closed: bool = True) -> Column:
    """1 or 0, null where a bound is missing (Q16)."""
    inside = value.between(lo, hi) if closed else (value > lo) & (value < hi)
    return inside.cast("int")


def ellipse_axis(se: Column, alpha: float) -> Column:
    """Half-axis of the confidence ellipse of two normals (Q17)."""
    return se * F.sqrt(F.lit(-2.0) * F.log(F.lit(alpha)))


def normal_halfwidth(se: Column, alpha: float) -> Column:
    """Half-width of a normal interval (Q18)."""
    return se * F.lit(NormalDist().inv_cdf(1 - alpha / 2))


def in_ellipse(x: Column, y: Column, cx: Column, cy: Column, a: Column, b: Column) -> Column:
    """1 inside or on an ellipse, else 0; null without an extent (Q19)."""
    return (F.pow(F.try_divide(x - cx, a), 2) + F.pow(F.try_divide(y - cy, b), 2) <= 1).cast("int")


def ellipse_area(a: Column, b: Column) -> Column:
    return F.pi() * a * b


def monotone(values: Column) -> Column:
    """Quantiles in increasing order (Q20)."""
    return F.array_sort(values)


def rectangle(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Ring of a rectangle's vertices (Q21)."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def expand_ring(ring: Column, factor: Column) -> Column:
    """A ring scaled about the mean of its vertices (Q22)."""
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / F.size(ring)
    return F.transform(ring, lambda p: F.struct((mean("x") + (p["x"] - mean("x")) * (1 + factor)).alias("x"), (mean("y") + (p["y"] - mean("y")) * (1 + factor)).alias("y")))


def widening_quantiles(median: Column, gaps_below: list[Column], gaps_above: list[Column]) -> list[Column]:
    """Monotone quantiles: the median less and plus cumulative softplus gaps (Q13)."""
    soft = lambda c: F.log1p(F.exp(c))
    below, above, at = [], [], median
    for g in reversed(gaps_below):
        at = at - soft(g)
        below.insert(0, at)
    at = median
    for g in gaps_above:
        at = at + soft(g)
        above.append(at)
    return [*below, median, *above]


def gcd_pinball(lat: Column, lon: Column, lat_q: Column, lon_q: Column, distance: Column, quantile: Column) -> Column:
    """Pinball loss of both axes, at the median with the great-circle distance in place of the error (Q7)."""
    loss = pinball(lat, lat_q, quantile) + pinball(lon, lon_q, quantile)
    return F.when(F.abs(quantile - 0.5) < 1e-9, loss + distance).otherwise(loss)


def ellipse_pinball(dx: Column, dy: Column, sxx: Column, syy: Column, sxy: Column, quantile: Column) -> Column:
    """Pinball loss of an error (dx, dy) along the axes of the ellipse of a covariance, in closed form (Q12).

    The error is turned into the frame of the eigenvectors; either coordinate's size meets the semi-axis there.
    """
    half, mean = F.sqrt(F.pow((sxx - syy) / 2, 2) + sxy * sxy), (sxx + syy) / 2
    turn = 0.5 * F.atan2(2 * sxy, sxx - syy)
    u, v = F.abs(F.cos(turn) * dx + F.sin(turn) * dy), F.abs(-F.sin(turn) * dx + F.cos(turn) * dy)
    a, b = F.sqrt(F.greatest(mean + half, F.lit(0.0))), F.sqrt(F.greatest(mean - half, F.lit(0.0)))
    return pinball(u, a, quantile) + pinball(v, b, quantile)
