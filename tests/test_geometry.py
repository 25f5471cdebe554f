"""Geometry on hand-made quads: G1-G14, P6, J16."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.operators import quads as quad_operators
from gridspark.operators.quads import nearest_within

Q = "q array<struct<x:double,y:double>>"
SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
TILTED = [(12.0, 8.0), (95.0, 15.0), (88.0, 99.0), (5.0, 80.0)]


def value(spark, expr, *quads):
    names = ["q", "r"][: len(quads)]
    schema = ", ".join(Q.replace("q ", f"{n} ", 1) for n in names)
    return spark.createDataFrame([tuple(quads)], schema).select(expr.alias("v")).first()["v"]


def points(rows):
    return [(p["x"], p["y"]) for p in rows]


def test_order_points(spark):
    shuffled = [SQUARE[2], SQUARE[0], SQUARE[3], SQUARE[1]]
    assert points(value(spark, G.order_points(F.col("q")), shuffled)) == SQUARE


def test_area_and_shape(spark):
    assert value(spark, G.polygon_area(F.col("q")), SQUARE) == 100.0
    assert value(spark, G.squareness(F.col("q")), SQUARE) == 1.0
    assert value(spark, G.squareness(F.col("q")), [(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (0.0, 4.0)]) == 0.5
    assert math.isclose(value(spark, G.centredness(F.col("q"), F.lit(10), F.lit(10)), SQUARE), 1.0)


@pytest.mark.parametrize("quad,convex", [
    (SQUARE, True), (SQUARE[::-1], True), ([SQUARE[0], SQUARE[2], SQUARE[1], SQUARE[3]], False),
    ([(0.0, 0.0), (10.0, 0.0), (4.0, 4.0), (0.0, 10.0)], False),
    ([(0.0, 0.0), (5.0, 0.0), (10.0, 0.0), (0.0, 10.0)], False), (SQUARE[:3], False),
])
def test_convex(spark, quad, convex):
    assert value(spark, G.is_convex(F.col("q")), quad) is convex


def solve_homography(src, dst):
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows), np.array(rhs)), 1.0).reshape(3, 3)


def test_homography_against_linear_solve(spark):
    dst = [(0.0, 0.0), (449.0, 0.0), (449.0, 449.0), (0.0, 449.0)]
    got = np.array(value(spark, G.homography(F.col("q"), F.col("r")), TILTED, dst)).reshape(3, 3)
    want = solve_homography(TILTED, dst)
    assert np.allclose(got / got[2, 2], want)
    back = value(spark, G.project(G.homography(F.col("q"), F.col("r")), F.col("q")), TILTED, dst)
    assert np.allclose(points(back), dst, atol=1e-6)


def test_warp_deviation(spark):
    centre = [(40.0, 40.0), (66.0, 42.0), (64.0, 69.0), (38.0, 66.0)]
    m = solve_homography(TILTED, [(0, 0), (449, 0), (449, 449), (0, 449)])
    p = m @ np.vstack([np.array(centre).T, np.ones(4)])
    p = (p[:2] / p[2]).T
    want = np.linalg.norm(p - np.array([[150, 150], [300, 150], [300, 300], [150, 300]]), axis=1).max()
    assert math.isclose(value(spark, G.warp_deviation(F.col("q"), F.col("r")), TILTED, centre), want, rel_tol=1e-9)


def test_box_quads_agree_on_regular_lattice(spark):
    lattice = [(float(3 * j), float(3 * i)) for i in range(4) for j in range(4)]
    eight = value(spark, G.box_quads(
        G.lattice_corners(F.col("q"), G.OUTER_POINTS), G.lattice_corners(F.col("q"), G.CENTRE_POINTS)), lattice)
    sixteen = value(spark, G.box_quads_from_lattice(F.col("q")), lattice)
    assert [points(b) for b in eight] == [points(b) for b in sixteen]
    assert points(sixteen[5]) == [(6.0, 3.0), (9.0, 3.0), (9.0, 6.0), (6.0, 6.0)]


def test_cell_windows(spark):
    rows = spark.range(1).select(F.explode(G.cell_windows(F.lit(100), F.lit(91))).alias("w")).select("w.*").collect()
    assert len(rows) == 81
    assert rows[10].asDict() == {"idx": 10, "y0": 10, "y1": 20, "x0": 11, "x1": 22}


def clip_area(a, b):
    """Sutherland-Hodgman for counter-clockwise polygons."""
    out = a
    for (x1, y1), (x2, y2) in zip(b, b[1:] + b[:1]):
        inside = lambda p: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1) >= 0
        nxt = []
        for p, q in zip(out, out[1:] + out[:1]):
            if inside(p) != inside(q):
                d1, d2 = (q[0] - p[0], q[1] - p[1]), (x2 - x1, y2 - y1)
                t = ((x1 - p[0]) * d2[1] - (y1 - p[1]) * d2[0]) / (d1[0] * d2[1] - d1[1] * d2[0])
                cut = (p[0] + t * d1[0], p[1] + t * d1[1])
                nxt += [p, cut] if inside(p) else [cut]
            elif inside(p):
                nxt.append(p)
        out = nxt
        if not out:
            return 0.0
    return 0.5 * abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1])))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 6.28), min_size=8, max_size=8), st.floats(-3, 3), st.floats(-3, 3))
def test_overlap_kernel(angles, dx, dy):
    ring = lambda ts, ox, oy: [(ox + 2 * math.cos(t), oy + 2 * math.sin(t)) for t in sorted(ts)]
    a, b = ring(angles[:4], 0, 0), ring(angles[4:], dx, dy)
    if min(np.diff(sorted(angles[:4])).min(), np.diff(sorted(angles[4:])).min()) < 0.05:
        return
    got = G._overlap_area(np.array([a]), np.array([b]))[0]
    assert math.isclose(got, clip_area(a, b), rel_tol=1e-6, abs_tol=1e-6)


def test_iou(spark):
    shifted = [(x + 5.0, y) for x, y in SQUARE]
    far = [(x + 50.0, y) for x, y in SQUARE]
    iou = G.quad_iou(F.col("q"), F.col("r"))
    assert math.isclose(value(spark, iou, SQUARE, shifted), 50 / 150)
    assert value(spark, iou, SQUARE, far) == 0.0
    assert math.isclose(value(spark, iou, SQUARE, SQUARE[::-1]), 1.0)
    dart = [(0.0, 0.0), (10.0, 0.0), (3.0, 3.0), (0.0, 10.0)]  # its hull is a triangle
    assert math.isclose(value(spark, iou, dart, dart), 1.0)
    assert math.isclose(value(spark, iou, dart, SQUARE), 0.5)


def test_nearest_within(spark):
    df = spark.createDataFrame([(SQUARE, 9.0, 1.0), (SQUARE, 60.0, 0.0), (SQUARE, 5.0, 0.0)], Q + ", x double, y double")
    got = [r["nearest"] for r in nearest_within(df, "q", F.col("x"), F.col("y")).collect()]
    assert got == [1, -1, 0]


def test_components_held_by_a_row_score_as_a_table_of_them(spark):
    """Also with too few components, none, and areas outside the band."""
    quads = [(q, [(q * 31 + k * 17) % (20 + q * 7) * (1 + q % 6) for k in range(q % 97)]) for q in range(120)]
    df = spark.createDataFrame(quads, "q bigint, areas array<bigint>")
    table = df.select("q", F.explode("areas").alias("area"))
    want = {r["q"]: r["cell_score"] for r in quad_operators.component_consistency(table, "q", "area").collect()}
    got = {r["q"]: r["s"] for r in df.select("q", quad_operators.component_score(F.col("areas")).alias("s")).collect()}
    assert any(want.values()) and all(abs(got[q] - want.get(q, 0.0)) < 1e-12 for q in got) and len(got) == 120
