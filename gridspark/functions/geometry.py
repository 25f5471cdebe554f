"""Quadrilateral geometry on ``array<struct<x:double,y:double>>`` columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gridspark.functions.binding import let, total

# Outer and centre corners of the 16-point lattice (TL, TR, BR, BL).
OUTER_POINTS = [0, 3, 15, 12]
CENTRE_POINTS = [5, 6, 10, 9]
AREA_BAND = (0.01, 0.99)


def point(x, y) -> Column:
    x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(*points) -> Column:
    return F.array(*[point(*p) for p in points])


def lattice_corners(points16: Column, which: list[int]) -> Column:
    return F.array(*[points16[i] for i in which])


def order_points(corners: Column) -> Column:
    """TL, TR, BR, BL by the smallest/largest x+y and y-x; the first point wins ties."""
    def pick(s: Column) -> Column:
        at = lambda key, best: s["c"][(F.array_position(s[key], best) - 1).cast("int")]
        return F.array(
            at("plus", F.array_min(s["plus"])),
            at("minus", F.array_min(s["minus"])),
            at("plus", F.array_max(s["plus"])),
            at("minus", F.array_max(s["minus"])),
        )

    keys = F.struct(
        corners.alias("c"),
        F.transform(corners, lambda p: p["x"] + p["y"]).alias("plus"),
        F.transform(corners, lambda p: p["y"] - p["x"]).alias("minus"),
    )
    return let(keys, pick)


def polygon_area(corners: Column) -> Column:
    """Shoelace area of a polygon with any number of vertices."""
    def cross(c: Column) -> Column:
        following = F.concat(F.slice(c, F.lit(2), F.size(c) - 1), F.slice(c, 1, 1))
        return F.zip_with(c, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])

    return F.abs(total(let(corners, cross))) / 2.0


def _turns(c: Column) -> list[Column]:
    out = []
    for i in range(4):
        a, b, d = c[i], c[(i + 1) % 4], c[(i + 2) % 4]
        out.append(
            (b["x"] - a["x"]) * (d["y"] - b["y"]) - (b["y"] - a["y"]) * (d["x"] - b["x"])
        )
    return out


def is_convex(corners: Column) -> Column:
    """All four turns strictly in the same direction."""
    same_way = let(
        let(corners, lambda c: F.array(*_turns(c))),
        lambda turns: (F.array_min(turns) > 0) | (F.array_max(turns) < 0),
    )
    return F.when(F.size(corners) == 4, same_way).otherwise(F.lit(False))


def in_area_band(area: Column, image_area: Column) -> Column:
    ratio_low, ratio_high = AREA_BAND
    return (area >= image_area * ratio_low) & (area <= image_area * ratio_high)


def _axis(corners: Column, axis: str) -> list[Column]:
    """One coordinate of the four corners; plain field access stays in generated code."""
    return [F.get(corners, F.lit(i))[axis] for i in range(4)]


def squareness(corners: Column) -> Column:
    """Short over long side of the pixel-inclusive bounding box of a quad."""
    def side(axis: str) -> Column:
        values = [v.cast("int") for v in _axis(corners, axis)]
        return F.greatest(*values) - F.least(*values) + 1

    return F.least(side("x"), side("y")) / F.greatest(side("x"), side("y"))


def centroid(corners: Column) -> Column:
    """Mean of the four corners of a quad."""
    centre = lambda axis: sum(_axis(corners, axis), F.lit(0.0)) / 4
    return point(centre("x"), centre("y"))


def distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def centredness(corners: Column, width: Column, height: Column) -> Column:
    """1 - distance of the centroid from the image centre over the half diagonal."""
    middle = centroid(corners)
    half_w, half_h = width / 2.0, height / 2.0
    dx, dy = middle["x"] - half_w, middle["y"] - half_h
    return F.lit(1.0) - F.sqrt(dx * dx + dy * dy) / F.sqrt(half_w * half_w + half_h * half_h)


def score3(area_norm: Column, square: Column, centre: Column) -> Column:
    return area_norm * 0.4 + square * 0.3 + centre * 0.3


def score5(
    area_norm: Column, square: Column, centre: Column, structure: Column, cells: Column
) -> Column:
    return area_norm * 0.2 + square * 0.2 + centre * 0.1 + structure * 0.3 + cells * 0.2


def corner_errors(found: Column, truth: Column) -> Column:
    return F.zip_with(found, truth, distance)


def lerp(a: Column, b: Column, t: float) -> Column:
    return point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)


def box_quads(outer: Column, centre: Column) -> Column:
    """Nine source quads, one per 3x3 box, from four outer and four centre corners."""
    tl, tr, br, bl = (outer[i] for i in range(4))
    lattice = [
        [tl, lerp(tl, tr, 1 / 3), lerp(tl, tr, 2 / 3), tr],
        [lerp(tl, bl, 1 / 3), centre[0], centre[1], lerp(tr, br, 1 / 3)],
        [lerp(tl, bl, 2 / 3), centre[3], centre[2], lerp(tr, br, 2 / 3)],
        [bl, lerp(bl, br, 1 / 3), lerp(bl, br, 2 / 3), br],
    ]
    return _boxes(lattice)


def box_quads_from_lattice(points16: Column) -> Column:
    """Nine source quads when all sixteen lattice points are annotated."""
    return _boxes([[points16[4 * i + j] for j in range(4)] for i in range(4)])


def _boxes(lattice: list[list[Column]]) -> Column:
    return F.array(*[
        F.array(lattice[i][j], lattice[i][j + 1], lattice[i + 1][j + 1], lattice[i + 1][j])
        for i in range(3)
        for j in range(3)
    ])


def cell_windows(width: Column, height: Column, margin_percent: int = 0) -> Column:
    """81 integer crop rectangles; an optional margin of at least one pixel per side."""
    def window(s: Column, i: Column) -> Column:
        row, col = (i / 9).cast("int"), i % 9
        if margin_percent:
            my = F.greatest(F.lit(1), F.floor(s["h"] * margin_percent / 100).cast("int"))
            mx = F.greatest(F.lit(1), F.floor(s["w"] * margin_percent / 100).cast("int"))
        else:
            my = mx = F.lit(0)
        return F.struct(
            i.alias("idx"),
            (row * s["h"] + my).alias("y0"),
            ((row + 1) * s["h"] - my).alias("y1"),
            (col * s["w"] + mx).alias("x0"),
            ((col + 1) * s["w"] - mx).alias("x1"),
        )

    size = F.struct(
        F.floor(height / 9).cast("int").alias("h"), F.floor(width / 9).cast("int").alias("w")
    )
    return let(
        size, lambda s: F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: window(s, i))
    )


# --- projective maps --------------------------------------------------------

def _square_to_quad(corners: Column) -> Column:
    """Row-major 3x3 map of the unit square (TL, TR, BR, BL) onto a quad."""
    def solve(s: Column) -> Column:
        p0, p1, p2, p3 = (s["c"][i] for i in range(4))
        gaps = F.struct(
            (p1["x"] - p2["x"]).alias("dx1"), (p3["x"] - p2["x"]).alias("dx2"),
            (p0["x"] - p1["x"] + p2["x"] - p3["x"]).alias("sx"),
            (p1["y"] - p2["y"]).alias("dy1"), (p3["y"] - p2["y"]).alias("dy2"),
            (p0["y"] - p1["y"] + p2["y"] - p3["y"]).alias("sy"),
        )

        def perspective(d: Column) -> Column:
            det = d["dx1"] * d["dy2"] - d["dx2"] * d["dy1"]
            return F.struct(
                F.try_divide(d["sx"] * d["dy2"] - d["dx2"] * d["sy"], det).alias("g"),
                F.try_divide(d["dx1"] * d["sy"] - d["sx"] * d["dy1"], det).alias("h"),
            )

        return let(
            let(gaps, perspective),
            lambda t: F.array(
                p1["x"] - p0["x"] + t["g"] * p1["x"],
                p3["x"] - p0["x"] + t["h"] * p3["x"],
                p0["x"],
                p1["y"] - p0["y"] + t["g"] * p1["y"],
                p3["y"] - p0["y"] + t["h"] * p3["y"],
                p0["y"],
                t["g"],
                t["h"],
                F.lit(1.0),
            ),
        )

    return let(F.struct(corners.alias("c")), solve)


def _adjugate(m: Column) -> Column:
    return F.array(
        m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
        m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
        m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
    )


def _multiply(a: Column, b: Column) -> Column:
    return F.array(*[
        a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j]
        for i in range(3)
        for j in range(3)
    ])


def homography(src: Column, dst: Column) -> Column:
    """Projective map taking four source corners onto four destination corners."""
    maps = F.struct(
        _square_to_quad(dst).alias("to"), let(_square_to_quad(src), _adjugate).alias("back")
    )
    return let(maps, lambda s: _multiply(s["to"], s["back"]))


def project(matrix: Column, points: Column) -> Column:
    """Apply a projective map to an array of points."""
    return let(
        F.struct(matrix.alias("m"), points.alias("p")),
        lambda s: F.transform(
            s["p"],
            lambda q: let(
                s["m"][6] * q["x"] + s["m"][7] * q["y"] + s["m"][8],
                lambda w: point(
                    F.try_divide(s["m"][0] * q["x"] + s["m"][1] * q["y"] + s["m"][2], w),
                    F.try_divide(s["m"][3] * q["x"] + s["m"][4] * q["y"] + s["m"][5], w),
                ),
            ),
        ),
    )


def square_corners(side: float) -> Column:
    return quad((0, 0), (side, 0), (side, side), (0, side))


def warp_deviation(outer: Column, centre: Column, size: int = 450) -> Column:
    """Largest distance of the projected centre box from the 1/3 and 2/3 lattice."""
    third, two_thirds = size / 3, size * 2 / 3
    expected = quad(
        (third, third), (two_thirds, third), (two_thirds, two_thirds), (third, two_thirds)
    )
    projected = project(homography(outer, square_corners(size - 1)), centre)
    return F.array_max(F.zip_with(projected, expected, distance))


# --- overlap ----------------------------------------------------------------

def flat(corners: Column) -> Column:
    """x0, y0, x1, y1, ... for the Arrow kernels."""
    return F.flatten(F.transform(corners, lambda p: F.array(p["x"], p["y"])))


def _hulls(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hulls of (n,4,2) points; an inner vertex is folded onto a neighbour."""
    offset = points - points.mean(axis=1, keepdims=True)
    order = np.argsort(np.arctan2(offset[..., 1], offset[..., 0]), axis=1, kind="stable")
    ring = np.take_along_axis(points, order[..., None], axis=1)
    before, after = np.roll(ring, 1, axis=1), np.roll(ring, -1, axis=1)
    a, b = ring - before, after - ring
    reflex = a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0] < 0
    return np.where(reflex[..., None], before, ring)


def _ring_area(ring: np.ndarray) -> np.ndarray:
    nxt = np.roll(ring, -1, axis=1)
    return 0.5 * np.abs((ring[..., 0] * nxt[..., 1] - ring[..., 1] * nxt[..., 0]).sum(axis=1))


def _inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    edge = np.roll(ring, -1, axis=1) - ring
    rel = points[:, :, None, :] - ring[:, None, :, :]
    side = edge[:, None, :, 0] * rel[..., 1] - edge[:, None, :, 1] * rel[..., 0]
    return (side >= -1e-9).all(axis=2)


def _crossings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    da, db = np.roll(a, -1, axis=1) - a, np.roll(b, -1, axis=1) - b
    gap = b[:, None, :, :] - a[:, :, None, :]
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    ea, eb = da[:, :, None, :], db[:, None, :, :]
    det = cross(ea, eb)
    ok = np.abs(det) > 1e-12
    safe = np.where(ok, det, 1.0)
    t, u = cross(gap, eb) / safe, cross(gap, ea) / safe
    hit = ok & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    at = a[:, :, None, :] + t[..., None] * ea
    n = len(a)
    return at.reshape(n, -1, 2), hit.reshape(n, -1)


def _overlap_area(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area of the intersection of convex rings, from its candidate vertices."""
    at, hit = _crossings(a, b)
    points = np.concatenate([a, b, at], axis=1)
    keep = np.concatenate([_inside(a, b), _inside(b, a), hit], axis=1)
    count = keep.sum(axis=1)
    centre = (points * keep[..., None]).sum(axis=1) / np.maximum(count, 1)[:, None]
    offset = points - centre[:, None, :]
    angle = np.where(keep, np.arctan2(offset[..., 1], offset[..., 0]), np.inf)
    order = np.argsort(angle, axis=1, kind="stable")
    ring = np.take_along_axis(points, order[..., None], axis=1)
    first = ring[:, :1, :]
    ring = np.where((np.arange(points.shape[1])[None, :] < count[:, None])[..., None], ring, first)
    return np.where(count >= 3, _ring_area(ring), 0.0)


@F.pandas_udf(DoubleType())
def quad_iou_flat(a: pd.Series, b: pd.Series) -> pd.Series:
    """Intersection over union of two quads given as flat coordinate arrays."""
    if len(a) == 0:
        return pd.Series([], dtype="float64")
    ra = _hulls(np.stack(a.to_list()).astype(float).reshape(-1, 4, 2))
    rb = _hulls(np.stack(b.to_list()).astype(float).reshape(-1, 4, 2))
    inter = _overlap_area(ra, rb)
    union = _ring_area(ra) + _ring_area(rb) - inter
    return pd.Series(np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1), 0.0))


def quad_iou(a: Column, b: Column) -> Column:
    return quad_iou_flat(flat(a), flat(b))
