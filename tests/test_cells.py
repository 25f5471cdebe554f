"""Cell functions on hand-made rows: P1-P5, P7-P9, P12-P18, X1-X5, V1-V7."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import cells as C
from gridspark.functions import vectors as V
from gridspark.functions.register import register_functions
from gridspark.operators import scoring


def value(spark, expr, schema=None, row=None):
    df = spark.range(1) if row is None else spark.createDataFrame([row], schema)
    return df.select(expr.alias("v")).first()["v"]


def ints(*v):
    return F.array(*[F.lit(x) for x in v])


@pytest.mark.parametrize("cell,coerced,first,filled", [
    ((5,), 5, 5, True), ((0,), 0, 0, False), ((1, 7), 0, 1, True), ((0, 4), 0, 4, True), ((0, 0), 0, 0, False),
])
def test_multivalue(spark, cell, coerced, first, filled):
    assert value(spark, C.coerce_multivalue(ints(*cell))) == coerced
    assert value(spark, C.first_nonzero(ints(*cell))) == first
    assert value(spark, C.is_filled(ints(*cell))) is filled


@pytest.mark.parametrize("token,expected", [
    ("3", [3]), ("0", [0]), ("7/1", [1, 7]), ("3/8/9", [3, 8, 9]), ("1/1", None), ("10", None), ("x", None),
    ("1/", None), ("1/1/2", [1, 2]), ("-1", None),
])
def test_parse_cell(spark, token, expected):
    assert value(spark, C.parse_cell(F.lit(token))) == expected


@pytest.mark.parametrize("cell,text", [((0,), "."), ((6,), "6"), ((1, 7), "1/7")])
def test_format_cell(spark, cell, text):
    assert value(spark, C.format_cell(ints(*cell))) == text


def test_parse_grid_line(spark):
    assert value(spark, C.parse_grid_line(F.lit(" 530070000 "))) == [[int(d)] for d in "530070000"]
    assert value(spark, C.parse_grid_line(F.lit("5 0 9 0/1/7 0 0 0 2 0")))[3] == [0, 1, 7]
    assert value(spark, C.parse_grid_line(F.lit("1 2 3"))) is None
    assert value(spark, C.parse_grid_line(F.lit("1 2 3 4 5 6 7 8 12"))) is None
    # Nine characters with a slash are not the compact form.
    assert value(spark, C.parse_grid_line(F.lit("1/2345678"))) is None


@pytest.mark.parametrize("clues,label", [(36, "Easy"), (35, "Medium"), (28, "Medium"), (27, "Hard"), (22, "Hard"), (21, "Expert")])
def test_difficulty(spark, clues, label):
    assert value(spark, C.difficulty(F.lit(clues))) == label


def test_min_clues(spark):
    grid = lambda n: F.array(*[F.lit(1)] * n, *[F.lit(0)] * (81 - n))
    assert value(spark, C.has_min_clues(grid(17))) and not value(spark, C.has_min_clues(grid(16)))


@pytest.mark.parametrize("digit,conf,band", [
    (4, 0.8, "high"), (4, 0.79, "medium"), (4, 0.5, "medium"), (4, 0.49, "low"), (0, 1.0, "none"),
])
def test_band(spark, digit, conf, band):
    assert value(spark, C.confidence_band(F.lit(digit), F.lit(conf))) == band


def test_gate_threshold_is_inclusive(spark):
    at = F.array(*[F.lit(x) for x in [0.0, 0.5, 0.5] + [0.0] * 7])
    below = F.array(*[F.lit(x) for x in [0.6, 0.1, 0.3] + [0.0] * 7])
    assert value(spark, C.confidence_gate(at)).asDict() == {"digit": 1, "conf": 0.5, "best_digit": 1}
    assert value(spark, C.confidence_gate(below)).asDict() == {"digit": 0, "conf": 0.3, "best_digit": 2}


def test_detector_confidence(spark):
    conf = lambda a: value(spark, C.detector_confidence(F.lit(a), F.lit(100.0)))
    assert [conf(5.0), conf(25.0), conf(80.0)] == [0.0, 0.5, 1.0]


def test_override_and_family(spark):
    v, s = C.override(F.lit(None).cast("int"), F.lit(2))
    assert value(spark, v) == 2 and value(spark, s) == "auto"
    assert value(spark, C.model_family(ints(64, 128))) == "large"
    assert value(spark, C.model_family(ints(8))) == "?"


def test_grid_error(spark):
    def check(grid):
        return value(spark, C.grid_error(F.col("g")), "g array<array<int>>", (grid,))

    good = [[0] * 9 for _ in range(9)]
    assert check(good) is None
    assert check(good[:8]) == "Grid must have exactly 9 rows"
    assert check(good[:3] + [[0] * 8] + good[4:]) == "Row 3 must have exactly 9 columns"
    bad = [r[:] for r in good]
    bad[2][5] = 10
    bad[4] = [0]
    assert check(bad) == "Cell [2][5] must be an integer 0-9"


def test_paths(spark):
    assert value(spark, C.basename(F.lit("a/b/c.tar.gz"))) == "c.tar.gz"
    assert value(spark, C.stem(F.lit("a/b/c.tar.gz"))) == "c.tar"
    assert value(spark, C.stem(F.lit("a/noext"))) == "noext"


VEC = "v array<double>"


def test_softmax_is_stable(spark):
    got = value(spark, V.softmax(F.col("v")), VEC, ([1000.0, 1001.0, 999.0],))
    e = np.exp(np.array([-1.0, 0.0, -2.0]))
    assert np.allclose(got, e / e.sum())


def test_minmax_constant_vector(spark):
    assert value(spark, V.minmax(F.col("v")), VEC, ([0.0, 0.0, 0.0],)) == [0.0, 0.0, 0.0]
    assert value(spark, V.minmax(F.col("v")), VEC, ([1.0, 2.0, 3.0],)) == [0.0, 127.5, 255.0]


def test_stats_and_pearson(spark):
    a, b = [1.0, 2.0, 4.0, 3.0], [2.0, 1.0, 5.0, 9.0]
    s = value(spark, V.vector_stats(F.col("v")), VEC, (a,))
    assert math.isclose(s["mean"], np.mean(a)) and math.isclose(s["std"], np.std(a))
    corr = value(spark, V.pearson(F.col("a"), F.col("b")), "a array<double>, b array<double>", (a, b))
    assert math.isclose(corr, np.corrcoef(a, b)[0, 1])
    flat = value(spark, V.pearson(F.col("a"), F.col("b")), "a array<double>, b array<double>", (a, [1.0] * 4))
    assert flat is None


def test_laplacian(spark):
    img = np.arange(25.0).reshape(5, 5) ** 1.5
    inner = img[:-2, 1:-1] + img[2:, 1:-1] + img[1:-1, :-2] + img[1:-1, 2:] - 4 * img[1:-1, 1:-1]
    got = value(spark, V.laplacian_var(F.col("v"), 5), VEC, (img.flatten().tolist(),))
    assert math.isclose(got, inner.var(), rel_tol=1e-9)


def test_histogram_edges(spark):
    at = lambda x: value(spark, V.histogram_bin(F.lit(x), 0.0, 1.0, 10))
    assert [at(0.0), at(0.1), at(1.0), at(1.01)] == [0, 1, 9, None]


def test_sql_functions_agree(spark):
    names = register_functions(spark)
    assert "quad_iou" in names
    row = spark.sql(
        "SELECT grid_difficulty(28) d, cell_coerce(array(1,7)) c, detector_confidence(25D, 100D) x, "
        "vec_white_ratio(array(255D, 0D)) w, path_basename('a/b.jpg') p, "
        "quad_iou(array(0D,0D,2D,0D,2D,2D,0D,2D), array(1D,0D,3D,0D,3D,2D,1D,2D)) i"
    ).first()
    assert (row.d, row.c, row.x, row.w, row.p) == ("Medium", 0, 0.5, 0.5, "b.jpg")
    assert math.isclose(row.i, 1 / 3)


def test_examples_are_kept_by_a_limit_per_task(spark):
    """No task orders all its wrong cells."""
    df = spark.range(0, 5000, 1, 3).selectExpr(
        "id AS image_id", "1 AS r", "id % 9 AS c", "CAST(id % 3 AS INT) AS predicted", "5 AS gt_digit", "id % 7 / 7.0D AS conf",
        "id % 5 = 0 AS is_filtered", "id % 4 <> 0 AS filled", "false AS correct")
    top = scoring.samples_per_class(df, 12)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "WindowGroupLimit" not in plan
    rows = top.collect()
    assert len(rows) == 48
    low = [r for r in rows if r["error_class"] == "missed_by_low_confidence"]
    assert [r["rank"] for r in sorted(low, key=lambda r: (-r["conf"], r["image_id"]))] == list(range(1, 13))
