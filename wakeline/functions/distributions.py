"""Distributions from quantiles and mixtures, and the regions they give, in numpy; for grouped Arrow functions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

R = 6378.137


def increasing(q: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Sorted quantiles without repeats: inner repeats are interpolated, a last one moves up by eps (Q20)."""
    q = np.sort(np.asarray(q, float))
    if q[0] == q[-1]:
        return q
    first = np.concatenate([[True], np.diff(q) > 0])
    if not first[-1]:
        q = q.copy()
        q[-1] += eps
        first = np.concatenate([[True], np.diff(q) > 0])
    at = np.flatnonzero(first)
    return np.interp(np.arange(len(q)), at, q[at])


class MonotoneCubic:
    """Distribution function through (value, level) points by monotone cubic Hermite pieces (D30; Fritsch and Carlson 1980)."""

    def __init__(self, values: np.ndarray, levels: np.ndarray):
        self.x, self.p = increasing(values), np.asarray(levels, float)
        h, d = np.diff(self.x), np.diff(self.p) / np.diff(self.x)
        slope = np.zeros(len(self.x))
        if len(h) > 1:
            w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
            slope[1:-1] = (w1 + w2) / (w1 / d[:-1] + w2 / d[1:])
        for end, (h0, h1, d0, d1) in ((0, (h[0], h[min(1, len(h) - 1)], d[0], d[min(1, len(d) - 1)])), (-1, (h[-1], h[max(-2, -len(h))], d[-1], d[max(-2, -len(d))]))):
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            slope[end] = min(max(s, 0.0), 3 * d0)
        self.slope = slope

    def _at(self, x: np.ndarray):
        i = np.clip(np.searchsorted(self.x, x, "right") - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        return i, h, (x - self.x[i]) / h

    def cdf(self, x) -> np.ndarray:
        x = np.clip(np.asarray(x, float), self.x[0], self.x[-1])
        i, h, t = self._at(x)
        return (1 + 2 * t) * (1 - t) ** 2 * self.p[i] + t * (1 - t) ** 2 * h * self.slope[i] + t * t * (3 - 2 * t) * self.p[i + 1] + t * t * (t - 1) * h * self.slope[i + 1]

    def pdf(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        i, h, t = self._at(np.clip(x, self.x[0], self.x[-1]))
        d = (self.p[i + 1] - self.p[i]) / h
        out = 6 * t * (1 - t) * d + (1 - 4 * t + 3 * t * t) * self.slope[i] + (3 * t * t - 2 * t) * self.slope[i + 1]
        return np.where((x < self.x[0]) | (x > self.x[-1]), 0.0, np.maximum(out, 0.0))

    def inverse(self, p) -> np.ndarray:
        """Values of levels, by Newton steps within brackets that are halved where a step would leave them; levels outside the points give the ends."""
        p = np.clip(np.asarray(p, float), self.p[0], self.p[-1])
        i = np.clip(np.searchsorted(self.p, p, "right") - 1, 0, len(self.p) - 2)
        h, d = self.x[i + 1] - self.x[i], self.p[i + 1] - self.p[i]
        s0, s1, under = self.slope[i] * h, self.slope[i + 1] * h, p - self.p[i]
        a, b = s0 + s1 - 2 * d, 3 * d - 2 * s0 - s1  # the level over the piece's first one is ((a t + b) t + s0) t
        t, lo, hi = under / d, np.zeros(p.shape), np.ones(p.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(60):
                f = ((a * t + b) * t + s0) * t - under
                low = f < 0
                lo, hi = np.where(low, t, lo), np.where(low, hi, t)
                step = t - f / ((3 * a * t + 2 * b) * t + s0)
                step = np.where(f == 0, t, np.where((step >= lo) & (step <= hi), step, (lo + hi) / 2))
                far = np.abs(step - t).max(initial=0.0)
                t = step
                if far < 1e-15:
                    break
        return self.x[i] + t * h


def cubic_points(q: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """(mean, median, mode) of the monotone cubic through each row of quantiles: the integral of the distribution function, its
    inverse and the greatest of its pieces' parabolas, in closed form but for the inverse (D32, D53). What lies beyond the levels is at the ends."""
    out = np.repeat(q[:, :1].astype(float), 3, 1)
    at = np.flatnonzero(np.ptp(q, axis=1) > 0)
    if not len(at):
        return out
    x = np.sort(q[at].astype(float), 1)
    for k in np.flatnonzero((np.diff(x, axis=1) <= 0).any(1)):
        x[k] = increasing(x[k])
    rows = [MonotoneCubic(v, levels) for v in x]
    p, slope = levels, np.stack([r.slope for r in rows])
    h, d = np.diff(x, axis=1), np.diff(p) / np.diff(x, axis=1)
    under = (h * (p[1:] + p[:-1]) / 2 + h * h * (slope[:, :-1] - slope[:, 1:]) / 12).sum(1)
    out[at, 0] = x[:, -1] - under  # the mass under the first level lies at the first value, that over the last one at the last
    lo, hi = (x[:, i : len(p) - 1 + i][:, min(max(int(np.searchsorted(p, 0.5, "right")) - 1, 0), len(p) - 2)] for i in (0, 1))
    k = min(max(int(np.searchsorted(p, 0.5, "right")) - 1, 0), len(p) - 2)
    if p[k] >= 0.5:
        out[at, 1] = lo
    else:
        begin, length, lo, hi = lo, hi - lo, lo.copy(), hi.copy()
        for _ in range(60):
            mid = (lo + hi) / 2
            t = (mid - begin) / length
            f = (1 + 2 * t) * (1 - t) ** 2 * p[k] + t * (1 - t) ** 2 * length * slope[:, k] + t * t * (3 - 2 * t) * p[k + 1] + t * t * (t - 1) * length * slope[:, k + 1]
            lo, hi = np.where(f < 0.5, mid, lo), np.where(f < 0.5, hi, mid)
        out[at, 1] = (lo + hi) / 2
    s0, s1 = slope[:, :-1], slope[:, 1:]
    a, b = 3 * s0 + 3 * s1 - 6 * d, 6 * d - 4 * s0 - 2 * s1  # density a t^2 + b t + s0 on a piece
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(a < 0, np.clip(-b / (2 * a), 0, 1), 0.0)
    at_t = np.stack([np.zeros_like(t), t, np.ones_like(t)], -1)
    dense = a[..., None] * at_t**2 + b[..., None] * at_t + s0[..., None]
    dense = dense.reshape(len(x), -1)
    best = (dense >= dense.max(1, keepdims=True) * (1 - 1e-9)).argmax(1)  # the first of equal ones
    out[at, 2] = (x[:, :-1, None] + at_t * h[..., None]).reshape(len(x), -1)[np.arange(len(x)), best]
    return out


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    x = np.asarray(x, float)

    def fraction(x: np.ndarray, a: float, b: float) -> np.ndarray:
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        out = d.copy()
        for m in range(1, 300):
            for k in (m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + k * x * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + k * x / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                out = out * d * c
            if np.all(np.abs(d * c - 1) < 1e-13):
                break
        return out

    with np.errstate(divide="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(np.clip(x, 1e-300, 1)) + b * np.log1p(-np.clip(x, 0, 1 - 1e-16)))
    low = x < (a + 1) / (a + b + 2)
    out = np.where(low, front * fraction(np.where(low, x, 0.0), a, b) / a, 1 - front * fraction(np.where(low, 0.0, 1 - x), b, a) / b)
    return np.clip(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out)), 0, 1)


def harrell_davis_weights(n: int, levels: np.ndarray) -> np.ndarray:
    """Weights of n ordered values for each level (D31; Harrell and Davis 1982)."""
    edges = np.arange(n + 1) / n
    return np.stack([np.diff(beta_cdf(edges, (n + 1) * p, (n + 1) * (1 - p))) for p in levels])


@lru_cache(maxsize=64)
def even_weights(n: int, bins: int) -> np.ndarray:
    """Harrell-Davis weights of n ordered values for evenly spaced inner levels, one matrix for each n."""
    return harrell_davis_weights(n, np.arange(1, bins) / bins)


def plausible_ends(x: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of quantiles, a value below and one above: steps between the outer three are followed along a line to levels 0 and 1; a step
    shorter than the last one, which would raise the density outwards, becomes the last two together (D31)."""
    def beyond(steps: np.ndarray, at: np.ndarray, to: float) -> np.ndarray:
        off = at - at.mean()
        slope = ((steps - steps.mean(1, keepdims=True)) * off).sum(1) / (off * off).sum()
        step = steps.mean(1) + slope * (to - at.mean())
        return step

    d = np.diff(x, axis=1)
    k = min(3, d.shape[1])
    two = min(2, d.shape[1])
    low = beyond(d[:, :k], levels[:k], 0.0) if k > 1 else d[:, 0]
    high = beyond(d[:, -k:], levels[-k:], 1.0) if k > 1 else d[:, -1]
    low = np.where(low < d[:, 0] * (1 - 1e-9), d[:, :two].sum(1), low)
    high = np.where(high < d[:, -1] * (1 - 1e-9), d[:, -two:].sum(1), high)
    return x[:, 0] - low, x[:, -1] + high


def tailed_density(x: np.ndarray, levels: np.ndarray, bins: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(edges, cdf) of the step density through Harrell-Davis estimates of each row of quantiles (D31; Akinshin 2024).

    Rows are padded by plausible ends, which the estimates lean on, then cut to their own range; what mass is left is made one.
    """
    x = np.sort(np.asarray(x, float), 1)
    low, high = plausible_ends(x, levels)
    wide = np.concatenate([low[:, None], x, high[:, None]], 1)
    inner = wide @ even_weights(wide.shape[1], bins).T
    at = np.concatenate([wide[:, :1], inner, wide[:, -1:]], 1)
    p, out = np.linspace(0, 1, bins + 1), []
    for row, own in zip(at, x):
        if own[0] == own[-1]:
            out.append((own[[0, -1]], np.array([0.0, 1.0])))
            continue
        ends = np.interp(own[[0, -1]], row, p)
        keep = (row > own[0]) & (row < own[-1])
        cdf = (np.concatenate([ends[:1], p[keep], ends[1:]]) - ends[0]) / (ends[1] - ends[0])
        out.append((np.concatenate([own[:1], row[keep], own[-1:]]), cdf))
    return out


def step_quantiles(edges: np.ndarray, cdf: np.ndarray, p: Sequence[float]) -> np.ndarray:
    """Values of levels; of a level that a flat part has, the value where it ends."""
    p = np.asarray(p, float)
    k = np.clip(np.searchsorted(cdf, p, "right"), 1, len(cdf) - 1)
    rise = cdf[k] - cdf[k - 1]
    share = np.where(rise > 0, p - cdf[k - 1], 0.0) / np.where(rise > 0, rise, 1.0)
    return edges[k - 1] + share * (edges[k] - edges[k - 1])


def step_density(edges: np.ndarray, cdf: np.ndarray, x: float) -> float:
    """The density at a value, zero outside and nan at a step without width; the last edge belongs to the last step."""
    if not edges[0] <= x <= edges[-1]:
        return 0.0
    k = min(int(np.searchsorted(edges, x, "right")), len(edges) - 1)
    width = edges[k] - edges[k - 1]
    return float((cdf[k] - cdf[k - 1]) / width) if width else math.nan


class SmoothedQuantiles:
    """Step density through Harrell-Davis estimates of evenly spaced levels."""

    def __init__(self, values: np.ndarray, bins: int = 50):
        v = np.sort(np.asarray(values, float))
        levels = np.arange(1, bins) / bins
        self.x = increasing(np.concatenate([[v[0]], harrell_davis_weights(len(v), levels) @ v, [v[-1]]]))
        self.p = np.linspace(0, 1, bins + 1)

    def cdf(self, x) -> np.ndarray:
        return np.interp(x, self.x, self.p)

    def inverse(self, p) -> np.ndarray:
        return np.interp(p, self.p, self.x)

    def pdf(self, x) -> np.ndarray:
        i = np.clip(np.searchsorted(self.x, x, "right") - 1, 0, len(self.x) - 2)
        inside = (np.asarray(x) >= self.x[0]) & (np.asarray(x) <= self.x[-1])
        return np.where(inside, (self.p[i + 1] - self.p[i]) / (self.x[i + 1] - self.x[i]), 0.0)


def mode(dist, grid: int = 512) -> float:
    """The value of highest density on a grid."""
    x = np.linspace(dist.x[0], dist.x[-1], grid)
    return float(x[np.argmax(dist.pdf(x))])


def highest_density_interval(dist, alpha: float, n: int = 2001, compat: bool = False) -> tuple[float, float]:
    """Ends of the densest (1 - alpha) of an even sample of levels; `compat` gives the first and last by density."""
    x = dist.inverse((np.arange(n) + 0.5) / n)
    kept = x[np.argsort(-dist.pdf(x), kind="stable")][: max(1, int((1 - alpha) * n))]
    return (float(kept[0]), float(kept[-1])) if compat else (float(kept.min()), float(kept.max()))


def outer(p: np.ndarray, ways: int = 64) -> np.ndarray:
    """Points without those well inside the polygon of the outermost ones in some directions; no vertex of the hull goes."""
    turn = 2 * np.pi * np.arange(ways) / ways
    size = np.maximum(np.ptp(p, axis=0), 1e-300)
    unit = (p - p.min(0)) / size - 0.5
    sides = np.stack([np.cos(turn), np.sin(turn)])
    ring = unit[np.unique([np.argmax(unit @ sides[:, k]) for k in range(ways)])]
    ring = convex_hull(ring)
    if len(ring) < 3:
        return p
    inside = np.ones(len(p), bool)
    for a, b in zip(ring, np.roll(ring, -1, 0)):
        inside &= (b[0] - a[0]) * (unit[:, 1] - a[1]) - (b[1] - a[1]) * (unit[:, 0] - a[0]) > 1e-9
    return p[~inside]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull, the first vertex not repeated (monotone chain)."""
    p = np.asarray(points, float)
    if len(p) > 1000:
        p = outer(p)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    p = p[np.concatenate([[True], (np.diff(p, axis=0) != 0).any(1)])] if len(p) else p
    if len(p) < 3:
        return p

    def half(rows):
        out: list[tuple[float, float]] = []
        for x, y in rows:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                out.pop()
            out.append((x, y))
        return out

    rows = p.tolist()
    low, high = half(rows), half(rows[::-1])
    return np.array(low[:-1] + high[:-1])


def hull_of_columns(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """`convex_hull` of the points (x, low) and (x, high), x in ascending order."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(x) > 0]))
    x, low, high = x[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)

    def outside(y: np.ndarray) -> np.ndarray:
        """The points that lie under the lines between their neighbours; others are on no lower chain."""
        p = np.stack([x, y], 1)
        for _ in range(20):
            d = np.diff(p, axis=0)
            keep = np.ones(len(p), bool)
            keep[1:-1] = d[:-1, 0] * d[1:, 1] > d[:-1, 1] * d[1:, 0]
            if keep.all():
                break
            p = p[keep]
        return p

    return convex_hull(np.concatenate([outside(low), outside(-high) * [1, -1]]))


def product_ranks(a: np.ndarray, b: np.ndarray, ranks) -> list[float]:
    """Values of some ranks, from 0 upwards, among all products of two lists of numbers not below zero; only those next to a rank are formed."""
    a, b, out = np.sort(a), np.sort(b), []
    at = lambda t, side: np.searchsorted(b, t / a, side)
    for rank in ranks:
        lo, hi = 0.0, float(a[-1] * b[-1]) * (1 + 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(12):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if at(mid, "left").sum() <= rank else (lo, mid)
            # A hair wider, since a quotient is not the product to the last digit.
            begin = at(lo * (1 - 1e-9), "left") if lo > 0 else np.zeros(len(a), int)
            end = at(hi * (1 + 1e-9), "right") if hi > 0 else np.full(len(a), len(b))
        n = end - begin
        first = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        near, k = np.repeat(a, n) * b[first], rank - int(begin.sum())
        out.append(float(np.partition(near, k)[k]))
    return out


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a counter-clockwise convex one (P34; Sutherland and Hodgman 1974)."""
    out = [np.asarray(p, float) for p in subject]
    for a, b in zip(clip, np.roll(clip, -1, 0)):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        rows, out = out, []
        for p, q in zip(rows, rows[1:] + rows[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp >= 0) != (sq >= 0):
                out.append(p + (q - p) * sp / (sp - sq))
    return np.array(out)


def area_on_sphere(ring: np.ndarray) -> float:
    """km2 on the sphere of a simple ring of the Mercator plane."""
    if len(ring) < 3:
        return 0.0
    a = np.asarray(ring, float)
    return float(abs(strips_on_sphere(a, np.concatenate([a[1:], a[:1]])).sum()))


def strips_on_sphere(a: np.ndarray, b: np.ndarray, up: np.ndarray | float = 0.0) -> np.ndarray:
    """What each edge from a to b gives to the area on the sphere of the ring it belongs to, which may be moved up."""
    y, (dx, dy) = a[:, 1] + up, (b - a).T
    g = lambda v: -2 * R / (1 + np.exp(2 * v / R))
    f = lambda v: -R * R * (2 * v / R - np.log1p(np.exp(2 * v / R)))
    flat = np.abs(dy) < 1e-6
    return np.where(flat, g(y + dy / 2) * dx, dx * (f(y + dy) - f(y)) / np.where(flat, 1.0, dy))


def ring_of_lines(lines: list[np.ndarray]) -> np.ndarray:
    """A closed ring of lines in no order: the first one, then always the line left that starts nearest to where the last ends."""
    first, left, ring = np.array([l[0] for l in lines], float), np.ones(len(lines), bool), []
    at = 0
    while left.any():
        ring.append(lines[at])
        left[at] = False
        at = int(np.where(left, np.hypot(*(first - lines[at][-1]).T), np.inf).argmin())
    return np.concatenate([*ring, ring[0][:1]])


def inside_ring(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether points lie inside a ring, by crossings."""
    a = np.asarray(ring, float)
    return crossings(points, a, np.concatenate([a[1:], a[:1]])) % 2 == 1


def crossings(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many edges from a to b a ray to the right of each point meets."""
    x, y = points[:, :1], points[:, 1:]
    (ax, ay), (bx, by) = a.T, b.T
    with np.errstate(divide="ignore", invalid="ignore"):
        at = ax + (y - ay) * (bx - ax) / (by - ay)
    return (((y < ay) != (y < by)) & (x < at)).sum(1)


class Bivariate:
    """Two marginal distributions joined by a Gaussian copula (D33); an axis of one value is a narrow uniform."""

    def __init__(self, qx: np.ndarray, qy: np.ndarray, levels: np.ndarray, rho: float = 0.0, margin: float = 10.0):
        def marginal(q):
            q = np.asarray(q, float)
            if np.ptp(q) == 0:
                return MonotoneCubic(q[0] + np.linspace(-margin, margin, len(q)), np.linspace(0, 1, len(q)))
            return MonotoneCubic(q, levels)

        self.x = marginal(qx)
        self.y = self.x if np.array_equal(qx, qy) else marginal(qy)
        self.rho = float(np.clip(rho, -0.999, 0.999))

    def sample(self, n: int, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        z = rng.normal(size=(n, 2))
        z[:, 1] = self.rho * z[:, 0] + math.sqrt(1 - self.rho**2) * z[:, 1]
        u = normal_cdf(z)
        return np.stack([self.x.inverse(u[:, 0]), self.y.inverse(u[:, 1])], 1)

    def pdf(self, points: np.ndarray) -> np.ndarray:
        px, py = self.x.pdf(points[:, 0]), self.y.pdf(points[:, 1])
        if not self.rho:
            return px * py
        u, v = (normal_ppf(np.clip(d.cdf(points[:, i]), 1e-6, 1 - 1e-6)) for i, d in enumerate((self.x, self.y)))
        r = self.rho
        copula = np.exp(-(r * r * (u * u + v * v) - 2 * r * u * v) / (2 * (1 - r * r))) / math.sqrt(1 - r * r)
        return px * py * copula

    def even(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, density) of n points or a few more that hold equal shares of the mass: m values of x by m of y given x.

        They stand for a sample of as many draws, without its noise.
        """
        m = math.ceil(math.sqrt(n))
        u = (np.arange(m) + 0.5) / m
        x = self.x.inverse(u)
        if not self.rho:
            y = self.y.inverse(u)
            return np.broadcast_to(x[:, None], (m, m)), np.broadcast_to(y, (m, m)), self.x.pdf(x)[:, None] * self.y.pdf(y)
        z = normal_ppf(u)
        y = self.y.inverse(normal_cdf(self.rho * z[:, None] + math.sqrt(1 - self.rho**2) * z).ravel()).reshape(m, m)
        x = np.broadcast_to(x[:, None], (m, m))
        return x, y, self.pdf(np.stack([x, y], -1).reshape(-1, 2)).reshape(m, m)

    def hull(self, confidence: float, n: int = 1000) -> np.ndarray:
        """Hull of the densest part."""
        return self.hulls([confidence], n)[0]

    def hulls(self, confidences, n: int = 1000) -> list[np.ndarray]:
        """Hulls of the densest parts."""
        if not self.rho:
            return self._product_hulls(confidences, n)
        x, y, density = self.even(n)
        flat, out = density.ravel(), []
        kept = [max(3, int(c * flat.size)) for c in confidences]
        ranked = np.partition(flat, [flat.size - k for k in kept])
        for k in kept:
            dense = density >= ranked[flat.size - k]
            rows = np.flatnonzero(dense.any(1))  # a column of x needs its least and greatest y only
            low = np.where(dense, y, np.inf)[rows].min(1)
            high = np.where(dense, y, -np.inf)[rows].max(1)
            at = x[rows, 0]
            out.append(convex_hull(np.concatenate([np.stack([at, low], 1), np.stack([at, high], 1)])))
        return out

    def _even_sides(self, n: int):
        """x, their densities, y and theirs, of `even` for independent axes."""
        m = math.ceil(math.sqrt(n))
        u = (np.arange(m) + 0.5) / m
        x = self.x.inverse(u)
        px = self.x.pdf(x)
        if self.y is self.x:
            return x, px, x, px
        y = self.y.inverse(u)
        return x, px, y, self.y.pdf(y)

    def _product_hulls(self, confidences, n: int) -> list[np.ndarray]:
        """`hulls` of independent axes, whose density is a product: for each x the dense y are the first ones by their own density."""
        x, px, y, py = self._even_sides(n)
        size, order, out = len(x) * len(y), np.argsort(-py, kind="stable"), []
        down = py[order]
        least, most = np.minimum.accumulate(y[order]), np.maximum.accumulate(y[order])
        up = np.append(down, -np.inf)
        for level in product_ranks(px, py, [size - max(3, int(c * size)) for c in confidences]):
            if level > 0:
                with np.errstate(divide="ignore"):
                    count = np.searchsorted(-down, -level / px, "right")
                while (more := (px > 0) & (px * up[count] >= level)).any():  # a quotient may be off by a last digit
                    count = count + more
                while (less := (count > 0) & (px * down[count - 1] < level)).any():
                    count = count - less
            else:
                count = np.full(len(x), len(y))
            rows = count > 0
            at, last = x[rows], count[rows] - 1
            out.append(hull_of_columns(at, least[last], most[last]))
        return out

    def levels(self, confidences, n: int = 1000) -> list[float]:
        """Densities of the contours that hold shares of the mass: quantiles of those of an even sample, interpolated."""
        if self.rho:
            return np.quantile(self.even(n)[2], 1 - np.array(confidences)).tolist()
        _, px, _, py = self._even_sides(n)
        at = (1 - np.array(confidences, float)) * (len(px) * len(py) - 1)
        low = np.floor(at).astype(int)
        ranked = product_ranks(px, py, np.stack([low, np.minimum(low + 1, len(px) * len(py) - 1)], 1).ravel().tolist())
        return [a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t) for a, b, t in zip(ranked[::2], ranked[1::2], (at - low).tolist())]

    def level(self, confidence: float, n: int = 1000) -> float:
        """Density of the contour that holds a share of the mass."""
        return float(np.quantile(self.even(n)[2], 1 - confidence))

    def contour_area(self, confidence: float, cells: int = 120, n: int = 1000) -> float:
        """km2 on the sphere of the cells denser than the contour."""
        x, y = (np.linspace(d.x[0], d.x[-1], cells + 1) for d in (self.x, self.y))
        cx, cy = (x[1:] + x[:-1]) / 2, (y[1:] + y[:-1]) / 2
        dense = self.pdf(np.stack(np.meshgrid(cx, cy, indexing="ij"), -1).reshape(-1, 2)).reshape(cells, cells) >= self.level(confidence, n)
        band = -2 * R * np.diff(x)[:, None] * np.diff(1 / (1 + np.exp(2 * y / R)))[None]
        return float((band * dense).sum())


class Mixture:
    """Gaussian mixture of rows (weight, mx, my, l11, l22, l21), the factor's diagonal positive."""

    def __init__(self, parts: np.ndarray):
        self.w, self.mean = parts[:, 0] / parts[:, 0].sum(), parts[:, 1:3]
        self.l11, self.l22, self.l21 = parts[:, 3:].T

    def sample(self, n: int, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        k, z = rng.choice(len(self.w), n, p=self.w), rng.normal(size=(n, 2))
        return self.mean[k] + np.stack([self.l11[k] * z[:, 0], self.l21[k] * z[:, 0] + self.l22[k] * z[:, 1]], 1)

    def pdf(self, points: np.ndarray) -> np.ndarray:
        d = points[:, None] - self.mean
        a = d[..., 0] / self.l11
        b = (d[..., 1] - self.l21 * a) / self.l22
        return (self.w * np.exp(-(a * a + b * b) / 2) / (2 * math.pi * self.l11 * self.l22)).sum(1)

    def hull(self, confidence: float, n: int = 1000, seed: int = 0) -> np.ndarray:
        s = self.sample(n, seed)
        return convex_hull(s[np.argsort(-self.pdf(s), kind="stable")][: max(3, int(confidence * n))])

    def confidence_of(self, point: np.ndarray, n: int = 1000, seed: int = 0) -> float:
        """Mass of the part denser than a point."""
        return float((self.pdf(self.sample(n, seed)) > self.pdf(point[None])[0]).mean())

    def negative_log_likelihood(self, point: np.ndarray) -> float:
        return -math.log(max(float(self.pdf(point[None])[0]), 1e-300))

    def energy_score(self, point: np.ndarray, beta: float = 1.0, n: int = 100, seed: int = 0) -> float:
        a, b = self.sample(n, seed), self.sample(n, seed + 1)
        size = lambda v: (np.sqrt((v * v).sum(-1)) ** beta).mean()
        return float(size(a - point) - size(a - b) / 2)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(z, float) / math.sqrt(2))


def normal_ppf(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.vectorize(NormalDist().inv_cdf, otypes=[float])(p)


@lru_cache(maxsize=4)
def resampled_places(n: int, horizon: int, draws: int, seed: int, replace: bool) -> np.ndarray:
    """Which of n steps each draw takes, a row a horizon; tracks of one length take the same."""
    rng = np.random.default_rng(seed)
    picks = rng.integers(0, n, (draws, horizon)) if replace else np.stack([rng.permutation(n)[:horizon] for _ in range(draws)])
    return np.ascontiguousarray(picks.T)


def reference_box(steps: np.ndarray, horizon: int, alpha: float | np.ndarray, draws: int = 10000, seed: int = 0, replace: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Percentile boxes of resampled, summed steps: (lo, hi) of each horizon (D23), first by alpha if that is an array."""
    picks = resampled_places(len(steps), horizon, draws, seed, replace)
    paths = np.stack([np.cumsum(np.ascontiguousarray(axis).take(picks), axis=0) for axis in np.asarray(steps, float).T], 1)
    side = 1 - np.sqrt(1 - np.asarray(alpha))
    at = np.stack([side / 2, 1 - side / 2]) * (draws - 1)
    low = np.minimum(np.floor(at).astype(int), draws - 2)
    ranked = np.sort(paths, axis=-1)  # once for all levels, and sooner done than a partition at each
    lo, hi = (np.moveaxis(ranked[..., i] + (ranked[..., i + 1] - ranked[..., i]) * (t - i), (0, 1), (-2, -1)) for i, t in zip(low, at))
    return lo, hi
