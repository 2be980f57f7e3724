"""Spherical and planar geometry as Column expressions. Angles in radians, lengths in km unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS = 6378.137
MAX_KM_PER_DAY = 240.0
MAX_DAILY_KM = 100.0

Vector = tuple[Column, Column, Column]


def clamp(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)  # null stays null


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine angle."""
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.asin(F.sqrt(clamp(a, 0.0)))


def great_circle_atan(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine angle in its arctangent form."""
    a = clamp(F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2), 0.0)
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def to_cartesian(lat: Column, lon: Column) -> Vector:
    """Unit vector."""
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def to_spherical(r: Vector) -> tuple[Column, Column]:
    """(lat, lon) of a vector."""
    x, y, z = r
    return F.atan2(z, F.sqrt(x * x + y * y)), F.atan2(y, x)


def great_circle_cartesian(a: Vector, b: Vector) -> Column:
    """Angle between two vectors by way of their coordinates on the sphere."""
    return great_circle(*to_spherical(a), *to_spherical(b))


def mercator(lat: Column, lon: Column, radius: float = EARTH_RADIUS) -> tuple[Column, Column]:
    """(x, y) in km."""
    return radius * lon, radius * F.log(F.tan(F.lit(0.7853981633974483) + lat / 2))


def mercator_inverse(x: Column, y: Column, radius: float = EARTH_RADIUS) -> tuple[Column, Column]:
    """(lat, lon) (P10)."""
    return 2 * F.atan(F.exp(y / radius)) - F.lit(1.5707963267948966), x / radius


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def scale(a: Vector, k: Column) -> Vector:
    return a[0] * k, a[1] * k, a[2] * k


def plus(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def basis(lat: Column, lon: Column) -> tuple[Vector, Vector, Vector]:
    """Rows radial, latitude (pointing south) and longitude of the local frame."""
    zero = F.lit(0.0)
    return to_cartesian(lat, lon), (F.sin(lat) * F.cos(lon), F.sin(lat) * F.sin(lon), -F.cos(lat)), (-F.sin(lon), F.cos(lon), zero)


def to_local(v: Vector, lat: Column, lon: Column) -> Vector:
    """Components of a vector in the frame at a point."""
    r, s, w = basis(lat, lon)
    return dot(r, v), dot(s, v), dot(w, v)


def from_local(c: Vector, lat: Column, lon: Column) -> Vector:
    r, s, w = basis(lat, lon)
    return plus(plus(scale(r, c[0]), scale(s, c[1])), scale(w, c[2]))


def log_map(p: Vector, q: Vector) -> Vector:
    """Tangent vector at p that points to q, its length the angle; zero for equal points."""
    along = dot(p, q)
    u = tuple(b - along * a for a, b in zip(p, q))
    size = F.sqrt(dot(u, u))
    angle = F.atan2(size, along)
    return tuple(F.when(size > 0, angle * c / F.when(size > 0, size)).otherwise(0.0) for c in u)


def exponential_map(p: Vector, v: Vector) -> Vector:
    """The point reached from p along tangent vector v."""
    size = F.sqrt(dot(v, v))
    turn = F.when(size > 0, F.sin(size) / F.when(size > 0, size)).otherwise(1.0)
    return plus(scale(p, F.cos(size)), scale(v, turn))


def log_map_from(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(sn, we) of a point seen from a reference point; sn lies along the frame's south row."""
    _, s, w = to_local(log_map(to_cartesian(lat0, lon0), to_cartesian(lat, lon)), lat0, lon0)
    return s, w


def step_between(lat: Column, lon: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """(north, east) components of the tangent vector from a point to another, as `log_map_from` without vectors: one short expression for
    steps along tracks (P12, P15). Equal points give zero, a missing one null."""
    turn = lon2 - lon
    east, north = F.cos(lat2) * F.sin(turn), F.sin(lat2) * F.cos(lat) - F.cos(lat2) * F.sin(lat) * F.cos(turn)
    size = F.hypot(east, north)
    grow = F.when(size > 0, F.atan2(size, F.sin(lat) * F.sin(lat2) + F.cos(lat) * F.cos(lat2) * F.cos(turn)) / size).when(size == 0, 0.0)
    return grow * north, grow * east


def exp_map_from(lat0: Column, lon0: Column, sn: Column, we: Column) -> tuple[Column, Column]:
    """(lat, lon) from (sn, we) about a reference point, the inverse of `log_map_from`."""
    v = from_local((F.lit(0.0), sn, we), lat0, lon0)
    return to_spherical(exponential_map(to_cartesian(lat0, lon0), v))


def local_to_mercator(lat0: Column, lon0: Column, sn: Column, we: Column) -> tuple[Column, Column]:
    """(x, y) of a point given about a reference point."""
    return mercator(*exp_map_from(lat0, lon0, sn, we))


def spherical_velocity(lat: Column, lon: Column, lat2: Column, lon2: Column, dt: Column, north_positive: bool = True) -> tuple[Column, Column]:
    """(v_sn, v_we) in radians per unit of dt towards the next point; the sign of sn is selectable."""
    s, w = log_map_from(lat, lon, lat2, lon2)
    return F.try_divide(-s if north_positive else s, dt), F.try_divide(w, dt)


def transport(lat: Column, lon: Column, lat2: Column, lon2: Column, v: Vector) -> Vector:
    """A tangent vector with the same components in another point's frame."""
    return from_local(to_local(v, lat, lon), lat2, lon2)


def straight_point(lat1: Column, lon1: Column, lat2: Column, lon2: Column, share: Column) -> tuple[Column, Column]:
    """(lat, lon) at a share of the geodesic between two points."""
    p = to_cartesian(lat1, lon1)
    return to_spherical(exponential_map(p, scale(log_map(p, to_cartesian(lat2, lon2)), share)))


def shift_to_origin(r: Vector, lat0: Column, lon0: Column) -> Vector:
    """The vector rotated so that (lat0, lon0) goes to (1, 0, 0)."""
    x, y, z = r
    a, b = x * F.cos(lon0) + y * F.sin(lon0), -x * F.sin(lon0) + y * F.cos(lon0)
    return a * F.cos(lat0) + z * F.sin(lat0), b, -a * F.sin(lat0) + z * F.cos(lat0)


def periodic(lat: Column, lon: Column, day: Column, year: Column) -> tuple[Column, ...]:
    """(x, y, z, sin t, cos t), the day over the year's length."""
    turn = 2 * F.pi() * day / F.when(is_leap(year), 366.0).otherwise(365.0)
    return (*to_cartesian(lat, lon), F.sin(turn), F.cos(turn))


def undo_periodic(r: Vector, sin_t: Column, cos_t: Column, year: Column) -> tuple[Column, Column, Column]:
    """(lat, lon) in degrees and day, the inverse of `periodic`."""
    lat, lon = to_spherical(r)
    turn = F.atan2(sin_t, cos_t)
    turn = F.when(turn < 0, turn + 2 * F.pi()).otherwise(turn)
    return F.degrees(lat), F.degrees(lon), turn / (2 * F.pi()) * F.when(is_leap(year), 366.0).otherwise(365.0)


def is_leap(year: Column) -> Column:
    """Gregorian rule."""
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def mercator_rectangle_area(x0: Column, x1: Column, y0: Column, y1: Column, radius: float = EARTH_RADIUS) -> Column:
    """km2 on the sphere of a rectangle of the Mercator plane."""
    g = lambda y: 1 / (1 + F.exp(2 * y / radius))
    return -2 * radius * (x1 - x0) * (g(y1) - g(y0))


def area_density(y: Column, radius: float = EARTH_RADIUS) -> Column:
    """Share of the sphere's area per unit of the Mercator plane, up to a factor of four."""
    e = F.exp(2 * y / radius)
    return e / ((1 + e) * (1 + e))


def ellipse_slice(y: Column, a: Column, b: Column, centre_y: Column, radius: float = EARTH_RADIUS) -> Column:
    """Width of an ellipse at height y over its centre times the density there."""
    return 2 * a * F.sqrt(F.greatest(F.lit(0.0), 1 - (y / b) * (y / b))) * 4 * area_density(y + centre_y, radius)


def ellipse_area_km(a: Column, b: Column, centre_y: Column, steps: int = 64, radius: float = EARTH_RADIUS) -> Column:
    """km2 on the sphere of an ellipse of the Mercator plane, half-axes a and b, by Gauss-Chebyshev quadrature."""
    total = F.lit(0.0)
    import math

    for i in range(1, steps + 1):
        t = i * math.pi / (steps + 1)
        total = total + math.sin(t) ** 2 * 4 * area_density(centre_y + b * math.cos(t), radius)
    return 2 * a * b * (math.pi / (steps + 1)) * total


def lens_area(r1: Column, r2: Column, d: Column, compat: bool = False) -> Column:
    """Intersection of two circles; `compat` adds the last term instead of taking it off."""
    inside = clamp(F.try_divide(d * d + r1 * r1 - r2 * r2, 2 * d * r1)), clamp(F.try_divide(d * d + r2 * r2 - r1 * r1, 2 * d * r2))
    root = F.sqrt(F.greatest(F.lit(0.0), (-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)))
    cut = r1 * r1 * F.acos(inside[0]) + r2 * r2 * F.acos(inside[1]) + (0.5 if compat else -0.5) * root
    small = F.least(r1, r2)
    return F.when(d >= r1 + r2, 0.0).when(d <= F.abs(r1 - r2), F.pi() * small * small).otherwise(cut)


def max_distance(days: Column) -> Column:
    """km at top speed."""
    return MAX_KM_PER_DAY * days


def max_daily_distance(days: Column) -> Column:
    return MAX_DAILY_KM * days


def max_area_forecast(days: Column) -> Column:
    """km2 within reach after some days."""
    return F.pi() * F.pow(max_distance(days), 2)


def max_area_imputation(step: Column, steps: Column, distance_km: Column, hours: float = 6.0, compat: bool = False) -> Column:
    """km2 within reach of both ends of a gap at its step-th of `steps` points, counted from 1."""
    days = hours / 24
    return lens_area(max_distance(step * days), max_distance((steps - step + 1) * days), distance_km, compat)


def wrap_lon(lon: Column, least: float = -180.0) -> Column:
    """Degrees within [least, least + 360)."""
    return F.pmod(lon - least, F.lit(360.0)) + least


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y) structs, closed or not."""
    n = F.size(ring)
    pairs = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)) / 2


def ring_area_on_sphere(ring: Column, radius: float = EARTH_RADIUS) -> Column:
    """km2 on the sphere of a simple ring of the Mercator plane, in closed form edge by edge.

    With G(y) = -2 R / (1 + e^(2y/R)) the area is |sum of the integrals of G dx along the edges|; the
    integral along a sloping edge is dx/dy (f(y1) - f(y0)) with f' = G.
    """
    n = F.size(ring)
    g = lambda y: -2 * radius / (1 + F.exp(2 * y / radius))
    f = lambda y: -radius * radius * (2 * y / radius - F.log1p(F.exp(2 * y / radius)))

    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        middle = g((p["y"] + q["y"]) / 2) * dx
        return F.when(F.abs(dy) < 1e-6, middle).otherwise(dx * (f(q["y"]) - f(p["y"])) / F.when(F.abs(dy) < 1e-6, 1.0).otherwise(dy))

    return F.abs(F.aggregate(F.transform(ring, edge), F.lit(0.0), lambda a, b: a + b))


def point_in_polygon(x: Column, y: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """0 outside, 1 inside, 2 on an edge of a literal polygon, by ray casting (P25)."""
    edges = list(zip(vertices, [*vertices[1:], vertices[0]]))
    on, crossings = F.lit(False), F.lit(0)
    for (ax, ay), (bx, by) in edges:
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        within = x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))
        on = on | ((cross == 0) & within)
        if ay != by:
            at = ax + (y - ay) * ((bx - ax) / (by - ay))
            crossings = crossings + F.when(((y < ay) != (y < by)) & (x < at), 1).otherwise(0)
    return F.when(on, 2).otherwise(crossings % 2).cast("int")


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring column of (x, y) structs, edges by the crossing rule."""
    n = F.size(ring)

    def hit(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        return F.when(((y < p["y"]) != (y < q["y"])) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, hit), F.lit(0), lambda a, b: a + b) % 2 == 1
