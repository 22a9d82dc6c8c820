"""Polygon algorithms in numpy. A shape is a list of rings, each an array of (x, y); what lies in an odd number of
rings is inside, which gives holes, multipolygons and repaired self-crossings one meaning."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np

Rings = list[np.ndarray]
SNAP = 1e-9


def open_ring(ring) -> np.ndarray:
    """A ring as an array without its repeated last point."""
    r = np.asarray(ring, float).reshape(-1, 2)
    return r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r


def box_rings(x0: float, y0: float, x1: float, y1: float) -> Rings:
    return [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)]


def edges(shape: Rings) -> np.ndarray:
    """Segments (x0, y0, x1, y1) of all rings."""
    parts = [np.hstack([r, np.roll(r, -1, axis=0)]) for r in map(open_ring, shape) if len(r) >= 3]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def bounds(shape: Rings) -> tuple[float, float, float, float]:
    points = np.concatenate([open_ring(r) for r in shape])
    return (*points.min(axis=0), *points.max(axis=0))


def ring_area(ring: np.ndarray) -> float:
    r = open_ring(ring)
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return 0.5 * float(x @ np.roll(y, -1) - y @ np.roll(x, -1))


def _crossing_heights(e: np.ndarray) -> np.ndarray:
    """Heights at which two segments cross."""
    d = e[:, 2:] - e[:, :2]
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = e[None, :, :2] - e[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / cross
        u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / cross
        hit = (np.abs(cross) > 1e-14) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    i, j = np.nonzero(np.triu(hit, 1))
    return e[i, 1] + t[i, j] * d[i, 1]


def slabs(shapes: list[Rings], inside: Callable[[np.ndarray], bool]):
    """The region where inside(flags of the shapes) holds, as trapezoids (y0, y1, left and right x at either height).

    Between neighbouring heights of corners and crossings no two segments cross, so each slab is cut into trapezoids.
    """
    sets = [edges(s) for s in shapes]
    every = np.concatenate(sets) if sets else np.zeros((0, 4))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    steep = every[:, 1] != every[:, 3]
    heights = np.unique(np.concatenate([every[:, 1], every[:, 3], _crossing_heights(every)])) if len(every) else np.zeros(0)
    every, owner = every[steep], owner[steep]
    low, high = np.minimum(every[:, 1], every[:, 3]), np.maximum(every[:, 1], every[:, 3])
    out = []
    for y0, y1 in zip(heights[:-1], heights[1:], strict=True):
        if y1 - y0 < SNAP:
            continue
        here = np.flatnonzero((low <= y0 + SNAP / 2) & (high >= y1 - SNAP / 2))
        at = lambda y, here=here: every[here, 0] + (y - every[here, 1]) / (every[here, 3] - every[here, 1]) * (every[here, 2] - every[here, 0])
        middle, bottom, top = at((y0 + y1) / 2), at(y0), at(y1)
        flags, start, within = np.zeros(len(sets), bool), -1, False
        for k in np.argsort(middle, kind="stable"):
            flags[owner[here[k]]] ^= True
            now = inside(flags)
            if now and not within:
                start = k
            elif within and not now and middle[k] > middle[start]:
                out.append((y0, y1, bottom[start], bottom[k], top[start], top[k]))
            within = now
    return out


def region_area(shapes: list[Rings], inside: Callable[[np.ndarray], bool]) -> float:
    """Area where inside(flags) holds; flags say which shapes a place lies in."""
    return float(sum((y1 - y0) * (b1 - b0 + t1 - t0) / 2 for y0, y1, b0, b1, t0, t1 in slabs(shapes, inside)))


def area(shape: Rings) -> float:
    return region_area([shape], lambda f: f[0])


def union_area(shapes: list[Rings]) -> float:
    return region_area(shapes, lambda f: f.any())


def overlap_area(one: Rings, others: list[Rings]) -> float:
    """Area of one that lies in any of others."""
    return region_area([one, *others], lambda f: f[0] and f[1:].any())


def trace(shapes: list[Rings], inside: Callable[[np.ndarray], bool], digits: int = 6) -> Rings:
    """Outline rings of the region, corners on straight lines left out."""
    sides: set[tuple] = set()
    flat: dict[float, list[tuple[float, int]]] = defaultdict(list)
    point = lambda x, y: (round(float(x), digits), round(float(y), digits))
    for y0, y1, b0, b1, t0, t1 in slabs(shapes, inside):
        sides.add((point(t0, y1), point(b0, y0)))
        sides.add((point(b1, y0), point(t1, y1)))
        # the floor of a trapezoid runs right, its roof left; where slabs meet the two cancel
        flat[round(y0, digits)] += [(b0, 1), (b1, -1)]
        flat[round(y1, digits)] += [(t0, -1), (t1, 1)]
    for y, ends in flat.items():
        ends.sort()
        level = 0
        for (x, step), (nxt, _) in zip(ends, [*ends[1:], (None, 0)], strict=True):
            level += step
            if nxt is not None and level and nxt - x > 10**-digits:
                a, b = point(x, y), point(nxt, y)
                sides.add((a, b) if level > 0 else (b, a))
    ahead: dict[tuple, list[tuple]] = defaultdict(list)
    for a, b in sides:
        if a != b:
            ahead[a].append(b)
    rings = []
    while ahead:
        first = min(ahead)
        ring, now, last = [], first, None
        while True:
            ring.append(now)
            nexts = ahead[now]
            if len(nexts) > 1 and last is not None:  # at a touching corner turn left as far as can be
                d = np.subtract(now, last)
                turn = lambda n, now=now, d=d: np.arctan2(d[0] * (n[1] - now[1]) - d[1] * (n[0] - now[0]), d @ np.subtract(n, now))
                nexts.sort(key=turn)
            nxt = nexts.pop()
            if not nexts:
                del ahead[now]
            last, now = now, nxt
            if now == first or now not in ahead:
                break
        r = np.array(ring)
        before, after = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
        bend = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > 10.0**-digits
        if bend.sum() >= 3:
            rings.append(r[bend])
    return rings


def dissolve(shapes: list[Rings]) -> Rings:
    """The union of shapes as outline rings."""
    return trace(shapes, lambda f: f.any())


def repair(shape: Rings) -> Rings:
    """The even-odd region of a shape as clean rings."""
    return trace([shape], lambda f: f[0])


def contains(shape: Rings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie inside."""
    e = edges(shape)
    odd = np.zeros(np.shape(x), bool)
    for x0, y0, x1, y1 in e:
        if y0 != y1:
            odd ^= ((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) / (y1 - y0) * (x1 - x0))
    return odd


def _to_segments(points: np.ndarray, e: np.ndarray) -> float:
    d = e[:, 2:] - e[:, :2]
    long = (d * d).sum(axis=1)
    t = np.clip(((points[:, None] - e[None, :, :2]) * d).sum(axis=2) / np.where(long > 0, long, 1), 0, 1)
    return float(np.sqrt((((e[None, :, :2] + t[..., None] * d) - points[:, None]) ** 2).sum(axis=2).min()))


def distance(one: Rings, other: Rings) -> float:
    """Least distance of two shapes; 0 where they touch or overlap."""
    a, b = edges(one), edges(other)
    if contains(other, a[:1, 0], a[:1, 1])[0] or contains(one, b[:1, 0], b[:1, 1])[0]:
        return 0.0
    d, c = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
    cross = d[:, None, 0] * c[None, :, 1] - d[:, None, 1] * c[None, :, 0]
    gap = b[None, :, :2] - a[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * c[None, :, 1] - gap[..., 1] * c[None, :, 0]) / cross
        u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / cross
    if ((cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any():
        return 0.0
    return min(_to_segments(a[:, :2], b), _to_segments(b[:, :2], a))


def cross(a: np.ndarray, b: np.ndarray) -> float:
    return a[0] * b[1] - a[1] * b[0]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(points):
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and cross(out[-1] - out[-2], q - out[-1]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def rotated_box_area(shape: Rings) -> float:
    """Area of the least rotated box around a shape; one of its sides lies on the hull."""
    h = hull(np.concatenate([open_ring(r) for r in shape]))
    if len(h) < 3:
        return 0.0
    d = np.roll(h, -1, axis=0) - h
    turn = np.arctan2(d[:, 1], d[:, 0])
    u = np.outer(np.cos(turn), h[:, 0]) + np.outer(np.sin(turn), h[:, 1])
    v = np.outer(np.cos(turn), h[:, 1]) - np.outer(np.sin(turn), h[:, 0])
    return float((np.ptp(u, axis=1) * np.ptp(v, axis=1)).min())


def rectangularity(shape: Rings) -> float:
    """Share of the least rotated box that the shape fills, 1 at most, 0 if degenerate."""
    whole = rotated_box_area(shape)
    return min(1.0, area(shape) / whole) if whole > 0 else 0.0


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, from its two farthest corners; three corners stay at least."""
    r = open_ring(ring)
    if len(r) <= 4:
        return r
    far = int(((r - r[0]) ** 2).sum(axis=1).argmax())
    keep = np.zeros(len(r) + 1, bool)
    keep[[0, far, len(r)]] = True
    line = np.vstack([r, r[:1]])
    stack = [(0, far), (far, len(r))]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = line[b] - line[a]
        long = np.hypot(*d)
        gap = line[a + 1 : b] - line[a]
        off = np.abs(d[0] * gap[:, 1] - d[1] * gap[:, 0]) / long if long else np.hypot(*gap.T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    out = r[keep[:-1]]
    return out if len(out) >= 3 else r


def simplify(shape: Rings, tolerance: float) -> Rings:
    """Every ring simplified; a ring whose area would turn over or vanish stays as it is."""
    out = []
    for ring in shape:
        s = simplify_ring(ring, tolerance)
        out.append(s if ring_area(s) * ring_area(ring) > 0 else open_ring(ring))
    return out


def polygonise(mask: np.ndarray) -> list[Rings]:
    """Shapes of the 4-connected regions of a mask, in pixel corners (column, row), holes as rings of their own."""
    m = np.pad(np.asarray(mask, bool), 1)
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    up = np.argwhere(m[1:, :] & ~m[:-1, :])  # sides with the region below, on its right hand walking right
    down = np.argwhere(~m[1:, :] & m[:-1, :])
    left = np.argwhere(m[:, 1:] & ~m[:, :-1])
    right = np.argwhere(~m[:, 1:] & m[:, :-1])
    for r, c in up:
        ahead[(c - 1, r)].append((c, r))
    for r, c in down:
        ahead[(c, r)].append((c - 1, r))
    for r, c in left:
        ahead[(c, r)].append((c, r - 1))
    for r, c in right:
        ahead[(c, r - 1)].append((c, r))
    outer: list[np.ndarray] = []
    holes: list[np.ndarray] = []
    while ahead:
        first = next(iter(ahead))
        ring, now, last = [], first, None
        while True:
            ring.append(now)
            nexts = ahead[now]
            if len(nexts) > 1 and last is not None:  # at a corner where regions touch stay with this one: turn right
                d = (now[0] - last[0], now[1] - last[1])
                nexts.sort(key=lambda n, now=now, d=d: d[0] * (n[1] - now[1]) - d[1] * (n[0] - now[0]))
            nxt = nexts.pop()
            if not nexts:
                del ahead[now]
            last, now = now, nxt
            if now == first:
                break
        r = np.array(ring, float)
        before, after = r - np.roll(r, 1, axis=0), np.roll(r, -1, axis=0) - r
        r = r[(before != after).any(axis=1)]
        (outer if ring_area(r) > 0 else holes).append(r)
    shapes = [[o] for o in outer]
    for hole in holes:
        inside = hole[0] + (0.0, 0.0)
        x, y = inside[0], inside[1]
        fits = [s for s in shapes if contains([s[0]], np.array([x]), np.array([y]))[0] or any((s[0] == inside).all(axis=1))]
        min(fits or shapes, key=lambda s: abs(ring_area(s[0]))).append(hole)
    return shapes


def dominant_angle(ring: np.ndarray) -> float:
    """The direction, modulo a quarter turn, in which the sides of a ring run, by length."""
    r = open_ring(ring)
    d = np.roll(r, -1, axis=0) - r
    z = (np.hypot(*d.T) * np.exp(4j * np.arctan2(d[:, 1], d[:, 0]))).sum()
    return float(np.angle(z) / 4)


def regularise_ring(ring: np.ndarray, tolerance: float, angle: float | None = None, diagonals: bool = True) -> np.ndarray:
    """A ring with sides along the dominant angle (and, if allowed, midway between): simplified, then each side turned
    about its middle to the nearest allowed direction and met with the next."""
    r = simplify_ring(ring, tolerance)
    if len(r) < 4:
        return r
    angle = dominant_angle(r) if angle is None else angle
    d = np.roll(r, -1, axis=0) - r
    step = np.pi / 4 if diagonals else np.pi / 2
    turn = angle + np.round((np.arctan2(d[:, 1], d[:, 0]) - angle) / step) * step
    middle = r + d / 2
    sides: list[tuple[np.ndarray, float, float]] = []
    for m, t, long in zip(middle, turn, np.hypot(*d.T), strict=True):
        if sides and abs(np.sin(sides[-1][1] - t)) < 1e-9:  # runs on with the side before: one side, by length
            pm, pt, pl = sides[-1]
            sides[-1] = ((pm * pl + m * long) / (pl + long), pt, pl + long)
        else:
            sides.append((m, t, long))
    if len(sides) > 1 and abs(np.sin(sides[0][1] - sides[-1][1])) < 1e-9:
        (am, at, al), (bm, _, bl) = sides[0], sides.pop()
        sides[0] = ((am * al + bm * bl) / (al + bl), at, al + bl)
    if len(sides) < 3:
        return r
    out = []
    for (am, at, _), (bm, bt, _) in zip([sides[-1], *sides[:-1]], sides, strict=True):
        u, v = np.array([np.cos(at), np.sin(at)]), np.array([np.cos(bt), np.sin(bt)])
        k = cross(bm - am, v) / cross(u, v)
        out.append(am + k * u)
    return np.array(out)


def regularise(shapes: list[Rings | None], pixel_m: float, projected: bool = True, factor: float = 2.5, neighbour_m: float = 100.0, most_change: float = 0.1) -> list[Rings | None]:
    """Outlines with straight, mostly right-angled sides, in the order given. Neighbours within neighbour_m share the
    angle of the larger one's surroundings where theirs differs by less than ten degrees; an outline whose area would change by
    more than most_change, and anything on an unprojected grid, stays as it is."""
    if pixel_m <= 0:
        raise ValueError("the pixel size must be positive")
    if not projected:
        return shapes
    found = [(i, dominant_angle(s[0]), abs(ring_area(s[0])), s[0].mean(axis=0)) for i, s in enumerate(shapes) if s]
    out: list[Rings | None] = list(shapes)
    for i, own, _, at in found:
        near = [(a, t) for _, t, a, p in found if np.hypot(*(p - at)) <= neighbour_m and abs(np.angle(np.exp(4j * (t - own))) / 4) < np.pi / 18]
        angle = float(np.angle(sum(a * np.exp(4j * t) for a, t in near)) / 4)
        rings = [regularise_ring(r, factor * pixel_m, angle) for r in shapes[i]]
        before, after = area(shapes[i]), area(rings)
        if before > 0 and abs(after - before) <= most_change * before:
            out[i] = rings
    return out
