"""Descriptors of footprints: Column functions where array functions do, and NumPy kernels for hulls, boxes and overlaps.

A ring is an array of points without the closing one. Kernels take one shape and
are called from a pandas UDF, as the plane has no functions in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = (
    "status string, valid boolean, parts int, holes int, area double, perimeter double, circularity double, convexity double, length double, width double, aspect double, theta double, vertices int, right_fraction double, "
    "rectangularity double, entropy double, vertex_density double, hole_fraction double, radial_cv double, fourier_1 double, fourier_2 double, fourier_3 double, fourier_4 double, "
    "reflect double, rot180 double, rot90 double, rot60 double, rot45 double, rot72 double, angles array<double>"
)


def corner_angles(xs: Column, ys: Column) -> Column:
    """Angle at each corner of a ring, 0 to 180 degrees, by array functions; null where a side has no length."""
    n = F.size(xs)
    at = lambda c, i: F.get(c, F.pmod(i, n))

    def angle(i):
        ax, ay = at(xs, i - 1) - at(xs, i), at(ys, i - 1) - at(ys, i)
        bx, by = at(xs, i + 1) - at(xs, i), at(ys, i + 1) - at(ys, i)
        size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, size)))))

    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), angle)


def signed_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def centroid(p: np.ndarray) -> np.ndarray:
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    total = cross.sum()
    return p.mean(axis=0) if abs(total) < 1e-12 else ((p + q) * cross[:, None]).sum(axis=0) / (3 * total)


def angles(p: np.ndarray) -> np.ndarray:
    """Angle at each vertex, 0 to 180 degrees; reflex ones fold."""
    a, b = np.roll(p, 1, axis=0) - p, np.roll(p, -1, axis=0) - p
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.degrees(np.arccos(np.clip((a * b).sum(axis=1) / np.where(size > 0, size, 1), -1, 1)))[size > 0]


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    pts = np.unique(p, axis=0)
    if len(pts) < 3:
        return pts

    def half(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def least_box(p: np.ndarray) -> tuple[float, float, float]:
    """Long side, short side and direction (degrees, of the long side, mod 180) of the rotated box of least area."""
    h = hull(p)
    if len(h) < 3:
        return 0.0, 0.0, 0.0
    edge = np.roll(h, -1, axis=0) - h
    turn = np.arctan2(edge[:, 1], edge[:, 0])
    c, s = np.cos(turn), np.sin(turn)
    u, v = np.outer(c, h[:, 0]) + np.outer(s, h[:, 1]), -np.outer(s, h[:, 0]) + np.outer(c, h[:, 1])
    a, b = np.ptp(u, axis=1), np.ptp(v, axis=1)
    i = int(np.argmin(a * b))
    theta = np.degrees(turn[i]) + (0 if a[i] >= b[i] else 90)
    return float(max(a[i], b[i])), float(min(a[i], b[i])), float(theta % 180)


def simple(p: np.ndarray) -> bool:
    """Whether no two edges that are not neighbours cross."""
    n = len(p)
    q = np.roll(p, -1, axis=0)
    side = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
    i, j = np.triu_indices(n, 2)
    keep = ~((i == 0) & (j == n - 1))
    i, j = i[keep], j[keep]
    return not bool(((side(p[i], q[i], p[j]) * side(p[i], q[i], q[j]) < 0) & (side(p[j], q[j], p[i]) * side(p[j], q[j], q[i]) < 0)).any())


def contains(p: np.ndarray, x: float, y: float) -> bool:
    """Whether a point is in a ring, by crossings."""
    q = np.roll(p, -1, axis=0)
    spans = (p[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
    return bool(np.count_nonzero(spans & (x < cut)) % 2)


def inner_point(p: np.ndarray) -> tuple[float, float]:
    """A point inside a ring: in the middle of the widest stretch, halfway between two of its corners' heights."""
    heights = np.unique(p[:, 1])
    gap = int(np.argmax(np.diff(heights))) if len(heights) > 1 else 0
    y = (heights[gap] + heights[min(gap + 1, len(heights) - 1)]) / 2
    q = np.roll(p, -1, axis=0)
    spans = (p[:, 1] > y) != (q[:, 1] > y)
    x = np.sort((p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / np.where(q[:, 1] == p[:, 1], 1, q[:, 1] - p[:, 1]))[spans])
    if len(x) < 2:
        return float(p[0, 0]), float(p[0, 1])
    i = 2 * int(np.argmax(x[1::2] - x[::2]))
    return float(x[i] + x[i + 1]) / 2, float(y)


class Shape:
    """Edges of the rings of a shape, outer ones counter-clockwise and holes clockwise: what is left of more edges than right is in it.

    So parts that overlap count once, and a ring that crosses itself has the loops that run the outer way.
    """

    def __init__(self, outers: list[np.ndarray], holes: list[np.ndarray]):
        rings = [p if signed_area(p) > 0 else p[::-1] for p in outers] + [p[::-1] if signed_area(p) > 0 else p for p in holes]
        self.p = np.concatenate(rings)
        self.q = np.concatenate([np.roll(p, -1, axis=0) for p in rings])


def _crossings(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges p-q and a-b cross, NaN where they do not."""
    r, s = q - p, b - a
    with np.errstate(divide="ignore", invalid="ignore"):
        across = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
        d = a - p
        t, u = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / across, (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / across
        return np.where((t > 0) & (t < 1) & (u > 0) & (u < 1), p[..., 1] + t * r[..., 1], np.nan)


def areas(shape: Shape, center: np.ndarray, matrices: np.ndarray, alone: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Area of the intersection and of the union of a shape and each of its images around a point, exactly.

    The plane is cut at the heights of all corners and crossings. Between two of
    these no edges cross, so what lies in both is as wide, on average, as halfway.
    alone: whether the shape's own edges do not cross each other.
    """
    p, q = np.broadcast_to(shape.p, (len(matrices), *shape.p.shape)), np.broadcast_to(shape.q, (len(matrices), *shape.q.shape))
    a, b = ((x - center) @ matrices.transpose(0, 2, 1) + center for x in (p, q))
    n = len(shape.p)
    heights = [p[..., 1], a[..., 1], _crossings(p[:, :, None], q[:, :, None], a[:, None], b[:, None]).reshape(len(p), -1)]
    if not alone:
        heights += [_crossings(x[:, :, None], y[:, :, None], x[:, None], y[:, None]).reshape(len(p), -1) for x, y in ((p, q), (a, b))]
    y = np.sort(np.concatenate(heights, axis=1), axis=1)
    y = y[:, : max(2, int((~np.isnan(y)).sum(axis=1).max()))]
    y = np.where(np.isnan(y), np.nanmax(y, axis=1, keepdims=True), y)
    middle, height = (y[:, 1:] + y[:, :-1]) / 2, np.diff(y, axis=1)
    start, stop = np.concatenate([p, a], axis=1)[:, None], np.concatenate([q, b], axis=1)[:, None]
    at = middle[..., None]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where((start[..., 1] > at) != (stop[..., 1] > at), start[..., 0] + (at - start[..., 1]) * (stop[..., 0] - start[..., 0]) / (stop[..., 1] - start[..., 1]), np.inf)
    sign = np.where(stop[..., 1] < start[..., 1], 1, -1) * np.where(np.arange(2 * n) < n, 1, np.sign(np.linalg.det(matrices))[:, None, None])
    order = np.argsort(x, axis=-1)
    x, sign = np.take_along_axis(x, order, -1), np.take_along_axis(np.broadcast_to(sign, x.shape), order, -1)
    own, image = (np.cumsum(np.where((order < n) == side, sign, 0), axis=-1)[..., :-1] > 0 for side in (True, False))
    with np.errstate(invalid="ignore"):
        wide = np.diff(x, axis=-1)
    wide = np.where(np.isfinite(wide), wide, 0) * height[..., None]
    return (wide * (own & image)).sum(axis=(1, 2)), (wide * (own | image)).sum(axis=(1, 2))


def overlaps(shape: Shape, center: np.ndarray, matrices: np.ndarray, alone: bool = True) -> np.ndarray:
    """Intersection over union of a shape and each of its images."""
    both, any_ = areas(shape, center, matrices, alone)
    return np.where(any_ > 0, both / np.where(any_ > 0, any_, 1), 0.0)


def rotation(degrees: float) -> np.ndarray:
    t = np.radians(degrees)
    return np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])


def reflection(theta: float) -> np.ndarray:
    """Mirror image in a line at theta degrees."""
    t = np.radians(2 * theta)
    return np.array([[np.cos(t), np.sin(t)], [np.sin(t), -np.cos(t)]])


def resampled(p: np.ndarray, n: int = 64) -> np.ndarray:
    """Points at equal steps along the outline."""
    closed = np.vstack([p, p[:1]])
    run = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(closed, axis=0), axis=1))])
    at = np.arange(n) / n * run[-1]
    return np.column_stack([np.interp(at, run, closed[:, k]) for k in (0, 1)])


def rings_of(xs, ys, starts=None, outer=None) -> tuple[list[np.ndarray], list[list[np.ndarray]], int]:
    """Outer rings, the holes of each, and the number of rings left out.

    A ring without an area is left out, an outer one with its holes; a hole belongs to
    the outer ring before it and counts only if it has a point inside that.
    """
    p = np.column_stack([np.asarray(xs, float), np.asarray(ys, float)])
    bounds = [*(starts if starts is not None and len(starts) else [0]), len(p)]
    kinds = outer if outer is not None and len(outer) else [True] * (len(bounds) - 1)
    outers, holes, lost, open_ = [], [], 0, False
    for low, high, is_outer in zip(bounds[:-1], bounds[1:], kinds):
        ring = p[low:high]
        if len(ring) > 1 and (ring[0] == ring[-1]).all():
            ring = ring[:-1]
        good = len(ring) > 2 and np.isfinite(ring).all()
        if is_outer:
            open_ = good
            if good:
                outers.append(ring)
                holes.append([])
        elif good and open_ and contains(outers[-1], *inner_point(ring)):
            holes[-1].append(ring)
        else:
            good = False
        lost += not good
    return outers, holes, lost


def describe_rings(xs, ys, starts=None, outer=None) -> dict:
    """All descriptors of a shape of one or more parts with holes.

    status is missing, empty (no ring of three points), valid, repaired (a ring
    crosses itself or rings are left out; areas are those of what is left) or
    degenerate (no area). Overlaps and area are of the whole shape; all else is of
    the outer ring of the largest part.
    """
    out = dict.fromkeys(_FIELDS)
    out |= {"valid": False, "angles": [], "parts": 0, "holes": 0, "vertices": 0, "status": "missing"}
    if xs is None or ys is None or len(xs) != len(ys):
        return out
    outers, holes, lost = rings_of(xs, ys, starts, outer)
    if not outers:
        return out | {"status": "empty"}
    inner = [h for own in holes for h in own]
    out |= {"parts": len(outers), "holes": len(inner)}
    plain = all(map(simple, [*outers, *inner]))
    sizes = [abs(signed_area(r)) - sum(abs(signed_area(h)) for h in own) for r, own in zip(outers, holes)]
    p = outers[int(np.argmax([abs(signed_area(r)) for r in outers]))]
    shape, alone = Shape(outers, inner), plain and len(outers) == 1
    area = sum(sizes) if alone else float(areas(shape, p.mean(axis=0), np.eye(2)[None], False)[0][0])
    if area <= 0 or abs(signed_area(p)) <= 0:
        return out | {"status": "degenerate", "vertices": len(p)}
    perimeter = float(np.linalg.norm(np.roll(p, -1, axis=0) - p, axis=1).sum())
    a = angles(p)
    length, width, theta = least_box(p)
    share = np.histogram(a, bins=18, range=(0, 180))[0] / max(1, len(a))
    share = share[share > 0]
    center = centroid(p)
    radius = np.linalg.norm(resampled(p) - center, axis=1)
    waves = np.abs(np.fft.fft(radius))[1:5] * 2 / (len(radius) * radius.mean())
    own = abs(signed_area(p))
    hulled = abs(signed_area(hull(p)))
    turns = (180, 90, 60, 45, 72)
    same = overlaps(shape, center, np.array([reflection(theta), reflection(theta + 90), *map(rotation, turns)]), alone)
    return out | {
        "status": "valid" if plain and not lost else "repaired", "valid": plain and not lost, "area": area, "perimeter": perimeter, "circularity": 4 * np.pi * own / perimeter**2, "convexity": own / hulled if hulled else None,
        "length": length, "width": width, "aspect": length / width if width else None, "theta": theta, "vertices": len(p), "right_fraction": float((np.abs(a - 90) <= 2).mean()) if len(a) else 0.0,
        "rectangularity": own / (length * width) if width else None, "entropy": float(-(share * np.log(share)).sum() / np.log(18)), "vertex_density": len(p) / area**0.5, "hole_fraction": sum(abs(signed_area(h)) for h in inner) / sum(abs(signed_area(r)) for r in outers),
        "radial_cv": float(radius.std() / radius.mean()), **{f"fourier_{i + 1}": float(w) for i, w in enumerate(waves)}, "reflect": float(same[:2].max()), **{f"rot{d}": float(x) for d, x in zip(turns, same[2:])}, "angles": a.tolist(),
    }


def describe(points) -> dict:
    """The descriptors of one ring."""
    p = np.asarray(points, float).reshape(-1, 2)
    return describe_rings(p[:, 0], p[:, 1])


_FIELDS = [f.strip().split()[0] for f in SCHEMA.split(", ")]


def _describe_all(xs: pd.Series, ys: pd.Series, starts: pd.Series, outer: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([describe_rings(*row) for row in zip(xs, ys, starts, outer)], columns=_FIELDS)


def descriptors(xs: str, ys: str, starts: str | None = None, outer: str | None = None) -> Column:
    """Struct of the descriptors of shapes given as two columns of coordinates and, if there are more rings than one, where each starts and whether it is an outer one."""
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    return F.pandas_udf(_describe_all, SCHEMA)(xs, ys, F.col(starts) if starts else none("int"), F.col(outer) if outer else none("boolean"))
