"""Rings of level sets and of alpha shapes, in numpy; small helpers for Arrow batches."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from wakeline.functions import distributions as D

#: For each code of a cell's corners over the level (1: low x and y, 2: high x, 4: both high, 8: high y) the sides a line leaves from and
#: goes to, what is over the level on its left. Sides: 0 low y, 1 high x, 2 high y, 3 low x. Codes 5 and 10 depend on the cell's middle.
TURNS = {1: [(0, 3)], 2: [(1, 0)], 3: [(1, 3)], 4: [(2, 1)], 6: [(2, 0)], 7: [(2, 3)], 8: [(3, 2)], 9: [(0, 2)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)]}
SADDLES = {(5, True): [(0, 1), (2, 3)], (5, False): [(0, 3), (2, 1)], (10, True): [(3, 0), (1, 2)], (10, False): [(1, 0), (3, 2)]}


def level_lines(z: np.ndarray, x: np.ndarray, y: np.ndarray, level: float) -> list[np.ndarray]:
    """Lines where a grid z[i, j] over (x[i], y[j]) crosses the level, by marching squares; what is over the level lies on the left.

    Lines that meet the edge of the grid are open, all others end where they begin.
    """
    up, (nx, ny) = z >= level, z.shape
    code = up[:-1, :-1] + 2 * up[1:, :-1] + 4 * up[1:, 1:] + 8 * up[:-1, 1:]
    middle = (z[:-1, :-1] + z[1:, :-1] + z[1:, 1:] + z[:-1, 1:]) / 4 >= level
    flat = (nx - 1) * ny  # edges along x come first
    i, j = np.nonzero((code > 0) & (code < 15))
    sides = np.stack([i * ny + j, flat + (i + 1) * (ny - 1) + j, i * ny + j + 1, flat + i * (ny - 1) + j], 1)
    follows: dict[int, int] = {}
    for edges, c, m in zip(sides.tolist(), code[i, j].tolist(), middle[i, j].tolist()):
        for a, b in TURNS.get(c) or SADDLES[c, m]:
            follows[edges[a]] = edges[b]

    def points(edges: list[int]) -> np.ndarray:
        e = np.array(edges)
        along = e < flat
        a = np.where(along, e // ny, (e - flat) // (ny - 1))
        b = np.where(along, e % ny, (e - flat) % (ny - 1))
        a1, b1 = a + along, b + ~along
        t = (level - z[a, b]) / (z[a1, b1] - z[a, b])
        return np.stack([x[a] + t * (x[a1] - x[a]), y[b] + t * (y[b1] - y[b])], 1)

    into = set(follows.values())
    lines, starts = [], [e for e in follows if e not in into]
    while follows:  # open lines first, from where they enter
        at = starts.pop() if starts else next(iter(follows))
        line = [at]
        while at in follows:
            at = follows.pop(at)
            line.append(at)
        lines.append(line)
    return np.split(points(sum(lines, [])), np.cumsum([len(l) for l in lines])[:-1]) if lines else []


def padded(z: np.ndarray, x: np.ndarray, y: np.ndarray, border: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid with a border of zeros, or lower, a hair outside, so that all lines close."""
    edge = lambda v: np.concatenate([[v[0] - (v[1] - v[0]) * 1e-6], v, [v[-1] + (v[-1] - v[-2]) * 1e-6]])
    return np.pad(z, 1, constant_values=border), edge(x), edge(y)


def signed_area(ring: np.ndarray) -> float:
    return float(signed_areas([ring])[0])


def edges_of(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the edges of all rings begin and end, and where in them each ring begins."""
    begin = np.concatenate(rings)
    first = np.cumsum([0] + [len(r) for r in rings])
    follow = np.arange(1, len(begin) + 1)
    follow[first[1:] - 1] = first[:-1]
    return begin, begin[follow], first[:-1]


def signed_areas(rings: list[np.ndarray]) -> np.ndarray:
    a, b, first = edges_of(rings)
    return np.add.reduceat(a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], first) / 2


def rings_of(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Closed lines as rings; open ones are joined into one, each next one starting nearest to where the last ends."""
    ends = np.array([[l[0], l[-1]] for l in lines]).reshape(-1, 2, 2)
    meet = np.isclose(ends[:, 0], ends[:, 1]).all(1)
    closed = [l for l, m in zip(lines, meet) if m]
    open_ = [l for l, m in zip(lines, meet) if not m]
    joined = [D.ring_of_lines(open_)] if open_ else []
    return [r[:-1] for r in closed + joined if len(r) > 3]


def nested(rings: list[np.ndarray]) -> list[tuple[int, bool, np.ndarray]]:
    """(part, hole, ring): rings run round their inside are exteriors, largest first, the others holes of the smallest exterior about them."""
    areas = signed_areas(rings).tolist() if rings else []
    order = sorted((k for k, a in enumerate(areas) if a > 0), key=lambda k: -areas[k])
    out = [(part, False, rings[k]) for part, k in enumerate(order)]
    for k in (k for k, a in enumerate(areas) if a < 0):
        # The middle of an edge, as a corner may lie on an exterior that a hole meets in a point.
        about = [part for part, _, ring in out[: len(order)] if D.inside_ring(rings[k][:2].mean(0)[None], ring)[0]]
        if about:
            out.append((about[-1], True, rings[k]))
    return out


def level_region(z: np.ndarray, x: np.ndarray, y: np.ndarray, level: float) -> list[tuple[int, bool, np.ndarray]]:
    """Exteriors and holes of the part of a grid at or over a level; at a level of zero that is all of it."""
    return nested(rings_of(level_lines(*padded(z, x, y, 0.0 if level > 0 else level - 1), level)))


def mass_level(z: np.ndarray, x: np.ndarray, y: np.ndarray, share: float) -> float:
    """The density over which lies a share of the mass of a grid, each point standing for the cell about it."""
    weight = lambda v: np.concatenate([[v[1] - v[0]], v[2:] - v[:-2], [v[-1] - v[-2]]]) / 2
    mass = (z * weight(x)[:, None] * weight(y)).ravel()
    order = np.argsort(-z, axis=None, kind="stable")
    total = np.cumsum(mass[order])
    return float(z.ravel()[order[min(np.searchsorted(total, share * total[-1]), len(order) - 1)]])


def region_area(region: list[tuple[int, bool, np.ndarray]]) -> float:
    """km2 on the sphere of exteriors without their holes, from rings of the Mercator plane."""
    kept = [(hole, ring) for _, hole, ring in region if len(ring) > 2]
    if not kept:
        return 0.0
    a, b, first = edges_of([np.asarray(ring, float) for _, ring in kept])
    areas = np.abs(np.add.reduceat(D.strips_on_sphere(a, b), first))
    return float(np.where([hole for hole, _ in kept], -areas, areas).sum())


def region_areas(region: list[tuple[int, bool, np.ndarray]], up: np.ndarray) -> np.ndarray:
    """`region_area` of a region moved along y by each of some distances."""
    kept = [(hole, np.asarray(ring, float)) for _, hole, ring in region if len(ring) > 2]
    out = np.zeros(len(up))
    if not kept:
        return out
    a, b, first = edges_of([ring for _, ring in kept])
    sign = np.where([hole for hole, _ in kept], -1.0, 1.0)
    step = max(1, 400_000 // len(a))
    for at in range(0, len(up), step):
        strips = D.strips_on_sphere(a, b, up[at : at + step, None])
        out[at : at + step] = (np.abs(np.add.reduceat(strips, first, axis=1)) * sign).sum(1)
    return out


def in_region(points: np.ndarray, region: list[tuple[int, bool, np.ndarray]]) -> np.ndarray:
    """In an exterior and in no hole of it (D27); a part within a hole counts."""
    if not region:
        return np.zeros(len(points), bool)
    a, b, _ = edges_of([np.asarray(ring, float) for _, _, ring in region])
    return D.crossings(points, a, b) % 2 == 1


def circles(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Centre and squared radius of the circles through three points each."""
    d, e = b - a, c - a
    det = 2 * (d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0])
    d2, e2 = (d * d).sum(1), (e * e).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.stack([e[:, 1] * d2 - d[:, 1] * e2, d[:, 0] * e2 - e[:, 0] * d2], 1) / det[:, None]
    return np.concatenate([a + u, (u * u).sum(1)[:, None]], 1)


def triangles(points: np.ndarray, size: float = 0.0, outer: bool = False) -> np.ndarray:
    """Delaunay triangles, counter-clockwise, of distinct points: each new point takes the place of the triangles whose circle holds it (Bowyer, Watson 1981).

    Those with circles many times as wide as the points, or as `size`, may be missing at the rim. With `outer`, triangles with a corner far outside, a number past the points', stay.
    """
    p = np.asarray(points, float)
    n, mid, size = len(p), p.mean(0), max(np.ptp(p, axis=0).max(), size, 1e-300)
    q = np.concatenate([(p - mid) / size, 50.0 * np.array([[-np.sqrt(3), -1], [np.sqrt(3), -1], [0, 2]])])
    tri = np.array([[n, n + 1, n + 2]])
    ring = circles(*(q[tri[:, k]] for k in range(3)))
    for k in range(n):
        inside = ((ring[:, :2] - q[k]) ** 2).sum(1) < ring[:, 2] * (1 + 1e-12)
        bad = tri[inside]
        edges = np.concatenate([bad[:, [0, 1]], bad[:, [1, 2]], bad[:, [2, 0]]])
        key = edges[:, 0] * (n + 3) + edges[:, 1]
        rim = edges[~np.isin(key, edges[:, 1] * (n + 3) + edges[:, 0])]
        new = np.concatenate([rim, np.full((len(rim), 1), k)], 1)
        tri, ring = np.concatenate([tri[~inside], new]), np.concatenate([ring[~inside], circles(*(q[new[:, k]] for k in range(3)))])
    return tri if outer else tri[(tri < n).all(1)]


def radii(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Radius of the circle about each triangle."""
    a, b, c = (p[tri[:, k]] for k in range(3))
    sides = [np.hypot(*(u - v).T) for u, v in ((a, b), (b, c), (c, a))]
    area = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return sides[0] * sides[1] * sides[2] / (4 * area)


def least_radii(n: int, tri: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The least radius of a triangle that each of n points is a corner of, infinite without one."""
    least = np.full(n, np.inf)
    np.minimum.at(least, tri.ravel(), np.repeat(r, 3))
    return least


def touched(p: np.ndarray, radius: float) -> np.ndarray:
    """Which points a circle of a radius with no point inside may touch: all but those in the middle of a fan of smaller circles."""
    tri = triangles(p, radius, outer=True)
    out = np.zeros(len(p) + 3, bool)
    real = (tri < len(p)).all(1)
    out[tri[~real]] = True
    kept = tri[real]
    out[kept[~(radii(p, kept) < radius * (1 - 1e-9))]] = True
    return out[: len(p)]


def rim(tri: np.ndarray, n: int) -> np.ndarray:
    """Edges, directed, that only one of the triangles has."""
    edges = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
    return edges[~np.isin(edges[:, 0] * n + edges[:, 1], edges[:, 1] * n + edges[:, 0])]


def region_of_edges(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, bool, np.ndarray]]:
    """Exteriors and holes of directed edges that run round them, in any order."""
    if not len(begin):
        return []
    p, at = np.unique(np.concatenate([begin, end]), axis=0, return_inverse=True)
    at = at.reshape(2, -1)
    follows: dict[int, list[int]] = defaultdict(list)
    for u, v in sorted(at.T.tolist()):
        follows[u].append(v)
    rings = []
    while follows:
        at = next(iter(follows))
        line, seen = [at], {at: 0}
        while at in follows:
            nxt = follows[at].pop()
            if not follows[at]:
                del follows[at]
            at = nxt
            if at in seen:  # a ring closes, also where shapes meet in a point
                rings.append(p[line[seen[at] :]])
                for v in line[seen[at] + 1 :]:
                    del seen[v]
                del line[seen[at] + 1 :]
            else:
                seen[at] = len(line)
                line.append(at)
    return nested([r for r in rings if len(r) > 2])


#: Radii are alike up to this share, so that a triangle of just the radius belongs to a shape however its numbers fall.
ALIKE = 1 + 1e-9


def alpha_region(points: np.ndarray, radius: float | None = None) -> list[tuple[int, bool, np.ndarray]]:
    """Exteriors and holes of the alpha shape (D33, D35): the Delaunay triangles of circumradius up to `radius`, by default half as much again as the least one with
    which every point is a corner of a triangle. Equal points count once; fewer than three, or points of one line, have no region."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return []
    p = np.random.default_rng(0).permutation(p)  # points in order would make long thin triangles on the way
    # Axes of unlike scale are brought to one, so that circles mean the same along both.
    scale = np.where(np.ptp(p, axis=0) > 0, np.ptp(p, axis=0), 1.0)
    tri = triangles(p / scale)
    if not len(tri):
        return []
    r = radii(p / scale, tri)
    if radius is None:
        least = least_radii(len(p), tri, r)
        radius = 1.5 * least[np.isfinite(least)].max()
    edges = rim(tri[r <= radius * ALIKE], len(p))
    return region_of_edges(p[edges[:, 0]], p[edges[:, 1]])
