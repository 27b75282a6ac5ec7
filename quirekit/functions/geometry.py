"""Points, boxes and polygons: array columns of (x, y) structs, and numpy functions for what columns can't express."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions.columns import let

POINTS = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0, y0, x1, y1) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def parsed_points(text: Column) -> Column:
    """'x,y x,y ...' as points, rounded half to even."""
    one = lambda p: F.struct(*(F.bround(F.split(p, ",")[i].cast("double"), 0).cast("int").alias(c) for i, c in enumerate("xy")))
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != ""), one)


def printed_points(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(F.bround(p["x"], 0).cast("int"), F.lit(","), F.bround(p["y"], 0).cast("int"))), " ")


def box(points: Column) -> Column:
    """(height, width, vpos, hpos) of a polygon."""
    x0, x1, y0, y1 = F.array_min(xs(points)), F.array_max(xs(points)), F.array_min(ys(points)), F.array_max(ys(points))
    return F.struct((y1 - y0).alias("height"), (x1 - x0).alias("width"), y0.alias("vpos"), x0.alias("hpos"))


def rotated(points: Column, degrees: float, x: float = 0.0, y: float = 0.0) -> Column:
    """Points turned about (x, y)."""
    c, s = float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))
    return F.transform(points, lambda p: F.struct((x + c * (p["x"] - x) - s * (p["y"] - y)).alias("x"), (y + s * (p["x"] - x) + c * (p["y"] - y)).alias("y")))


def quarter_turned(points: Column, turns: Column, width: Column, height: Column) -> Column:
    """Points of a page that was read after so many quarter turns, back in the page; width and height are the page's."""
    back = lambda p: F.when(turns == 1, point(width - p["y"], p["x"])).when(turns == 2, point(width - p["x"], height - p["y"])).when(turns == 3, point(p["y"], height - p["x"])).otherwise(point(p["x"], p["y"]))
    return F.transform(points, back)


def outline(baseline: Column, above: Column, below: Column) -> Column:
    """The polygon around a baseline: each point moved along the normal of its segment (the last segment's for the last point), heights 1 at least; upper points, then the lower ones reversed."""
    up, down = F.greatest(above, F.lit(1.0)), F.greatest(below, F.lit(1.0))

    def around(points: Column) -> Column:
        n = F.size(points)

        def angle(i: Column) -> Column:
            at = F.least(i, n - 2)
            return let(F.struct(F.get(points, at).alias("a"), F.get(points, at + 1).alias("b")), lambda s: F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"]))

        def moved(by: Column, sign: int) -> Column:
            return F.transform(points, lambda p, i: let(angle(i), lambda t: F.struct((p["x"] + sign * by * F.sin(t)).alias("x"), (p["y"] - sign * by * F.cos(t)).alias("y"))))

        return F.when(n > 1, F.concat(moved(up, 1), F.reverse(moved(down, -1))))

    return let(baseline, around)  # a baseline may be computed: once, and not for each point


def stretched(baseline: Column, by: float) -> Column:
    """A baseline with a point `by` to the left of its first and one to the right of its last."""
    first, last = F.get(baseline, F.lit(0)), F.element_at(baseline, -1)
    return F.when(F.size(baseline) > 0, F.concat(F.array(F.struct((first["x"] - by).alias("x"), first["y"].alias("y"))), baseline, F.array(F.struct((last["x"] + by).alias("x"), last["y"].alias("y"))))).otherwise(baseline)


def resampled_straight(baseline: Column, n: int = 10) -> Column:
    """n points evenly spaced from a baseline's first to its last."""
    a, b = F.get(baseline, F.lit(0)), F.element_at(baseline, -1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((a["x"] + (b["x"] - a["x"]) * i / (n - 1)).alias("x"), (a["y"] + (b["y"] - a["y"]) * i / (n - 1)).alias("y")))


def angle_difference(a: Column, b: Column) -> Column:
    """The angle between two directions in radians, at most pi."""
    d = F.abs(a - b) % (2 * np.pi)
    return F.least(d, 2 * np.pi - d)


def at_edge(points: Column, width: Column, margin: float = 20, ratio: float = 0.125) -> Column:
    """Whether a line hugs the page's left or right edge and is short: it begins within the margin and doesn't reach beyond `ratio` of the width."""
    x = xs(points)
    left = F.exists(x, lambda v: v < margin) & ~F.exists(x, lambda v: v > width * ratio)
    right = F.exists(x, lambda v: v > width - margin) & ~F.exists(x, lambda v: v < width * (1 - ratio))
    return left | right


# numpy


def resample(points: np.ndarray, n: int = 10) -> np.ndarray:
    """n points of a parabola (a straight line for 2 points) fitted to a baseline, evenly spaced along its longer axis."""
    p = np.asarray(points, float)
    swap = np.ptp(p[:, 1]) > np.ptp(p[:, 0])
    u, v = (p[:, 1], p[:, 0]) if swap else (p[:, 0], p[:, 1])
    if np.ptp(u) == 0:
        return np.repeat(p[:1], n, axis=0)
    centre, width = u.mean(), np.ptp(u)
    fit = np.polyfit((u - centre) / width, v, min(2, len(np.unique(u)) - 1))
    at = np.linspace(u[0], u[-1], n)
    value = np.polyval(fit, (at - centre) / width)
    return np.stack([value, at] if swap else [at, value], axis=1)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The corners of the hull, counterclockwise from the leftmost."""
    p = sorted({(float(x), float(y)) for x, y in points})
    if len(p) < 3:
        return np.array(p)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    half = []
    for order in (p, p[::-1]):
        out: list = []
        for q in order:
            while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        half += out[:-1]
    return np.array(half)


def area(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    x, y = np.asarray(points, float).T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def clipped(polygon: np.ndarray, region: np.ndarray) -> np.ndarray:
    """The part of a polygon that lies in a convex region; no points if there is none."""
    out = [tuple(map(float, p)) for p in polygon]
    edge = convex_hull(region)
    for a, b in zip(edge, np.roll(edge, -1, axis=0)):
        side = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        given, out = out, []
        for p, q in zip(given[-1:] + given[:-1], given):
            sp, sq = side(p), side(q)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if sq >= 0:
                out.append(q)
    return np.array(out).reshape(-1, 2)


def prior(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of polygons whose points lie one after another, count of them each: the polygon of each point, the point before it on the polygon, and where each polygon begins (and the last ends)."""
    first = np.concatenate([[0], np.cumsum(count)])
    before = np.arange(first[-1]) - 1
    some = count > 0
    before[first[:-1][some]] = first[1:][some] - 1
    return np.repeat(np.arange(len(count)), count), before, first


def clipped_many(points: np.ndarray, count: np.ndarray, hulls: np.ndarray, size: np.ndarray, hull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, count): clipped() of many polygons, whose points lie one after another. hulls are convex_hull()s, one after another and of `size` points each; hull says which is each polygon's."""
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    for e in range(int(size[hull].max(initial=0))):
        own, before, _ = prior(count)
        sides = size[hull][own]
        cut = e < sides
        start = at[hull][own]
        a, b = hulls[np.where(cut, start + e, 0)], hulls[np.where(cut, start + (e + 1) % np.maximum(sides, 1), 0)]
        side = (b[:, 0] - a[:, 0]) * (points[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (points[:, 0] - a[:, 0])
        inside = (side >= 0) | ~cut
        cross = cut & ((side[before] >= 0) != (side >= 0))
        n = cross.astype(np.int64) + inside
        place = np.cumsum(n) - n
        out = np.empty((int(n.sum()), 2))
        c = np.flatnonzero(cross)
        p, q, sp, sq = points[before[c]], points[c], side[before[c]], side[c]
        out[place[c]] = p + (sp / (sp - sq))[:, None] * (q - p)
        k = np.flatnonzero(inside)
        out[(place + cross)[k]] = points[k]
        points, count = out, np.bincount(own, n, minlength=len(count)).astype(np.int64)
    return points, count


def areas(points: np.ndarray, count: np.ndarray) -> np.ndarray:
    """area() of many polygons, whose points lie one after another."""
    own, before, _ = prior(count)
    (x, y), (u, v) = points[before].T, points.T
    twice = np.bincount(own, x * v - y * u, minlength=len(count))
    return np.where(count < 3, 0.0, np.abs(twice) / 2)


def resample_many(points: np.ndarray, n: int = 10) -> np.ndarray:
    """resample() of many baselines of equally many points."""
    p = np.asarray(points, float)
    out = np.repeat(p[:, :1], n, axis=1)
    swap = np.ptp(p[:, :, 1], axis=1) > np.ptp(p[:, :, 0], axis=1)
    u, v = np.where(swap[:, None], p[:, :, 1], p[:, :, 0]), np.where(swap[:, None], p[:, :, 0], p[:, :, 1])
    width = np.ptp(u, axis=1)
    degree = np.minimum(2, np.count_nonzero(np.diff(np.sort(u, axis=1), axis=1), axis=1))
    for d in (1, 2):
        own = np.flatnonzero(degree == d)
        if not len(own):
            continue
        w, centre = width[own, None], u[own].mean(axis=1, keepdims=True)
        x = (u[own] - centre) / w
        rows = np.stack([x**k for k in range(d, -1, -1)], axis=2)
        scale = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        fit = (np.linalg.pinv(rows / scale, rcond=p.shape[1] * np.finfo(float).eps) @ v[own][:, :, None])[:, :, 0] / scale[:, 0]
        to = np.linspace(u[own, 0], u[own, -1], n, axis=1)
        z, value = (to - centre) / w, np.zeros_like(to)
        for k in range(d + 1):
            value = value * z + fit[:, k : k + 1]
        s = swap[own, None]
        out[own] = np.stack([np.where(s, value, to), np.where(s, to, value)], axis=2)
    return out


def circumradius(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """The radius of the circle through three points; infinite if they are on a line."""
    x, y, z = np.linalg.norm(b - c), np.linalg.norm(c - a), np.linalg.norm(a - b)
    size = area(np.array([a, b, c]))
    return float(x * y * z / (4 * size)) if size > 1e-12 else float("inf")


def peaks(values: np.ndarray, distance: int, least: float = 0.05) -> list[tuple[float, float]]:
    """(place, height) of the local maxima above `least`, the highest first, none within `distance` of a higher one; each refined by the parabola through the values up to 2 around it."""
    v = np.asarray(values, float)
    inner = [i for i in range(1, len(v) - 1) if v[i] > v[i - 1] and v[i] >= v[i + 1] and v[i] > least]
    kept: list[int] = []
    for i in sorted(inner, key=lambda i: (-v[i], i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in kept:
        a, b = max(0, i - 2), min(len(v), i + 3)
        curve = np.polyfit(np.arange(a, b) - i, v[a:b], 2)
        at = float(np.clip(-curve[1] / (2 * curve[0]), -1, 1)) if curve[0] < 0 else 0.0
        out.append((i + at, float(np.polyval(curve, at))))
    return out


def components(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """The least member of each node's connected component."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
