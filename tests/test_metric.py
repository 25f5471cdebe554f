"""Joins by nearness against plain loops."""

import math
import random

import numpy as np
import pytest

from gridspark.operators import metric as N
from gridspark.operators import samples as M


def twins_by_loops(rows, least):
    classes = {}
    for g, k, v in rows:
        classes.setdefault((g, None if v is None else tuple(v)), []).append(k)
    out = {}
    units = {}
    for (g, v), keys in classes.items():
        if v is None or any(x is None for x in v) or len(set(v)) < 2:
            out[g, min(keys)] = (len(keys), None)
        else:
            a = np.array(v, float) - np.mean(v)
            units[g, min(keys)] = (a / np.linalg.norm(a), len(keys))
    for (g, k), (u, n) in units.items():
        links = n - 1
        for (h, j), (w, m) in units.items():
            if h == g and j != k and len(u) == len(w) and float(u @ w) > least:
                links += m
        out[g, k] = (n, links)
    return out


def test_twins(spark):
    rng = np.random.default_rng(3)
    rows = []
    middles = rng.normal(size=(40, 6))
    for k in range(900):  # one group holds most rows; clusters, a dense ball and copies
        kind = k % 3
        v = middles[k % 40] + rng.normal(size=6) * (0.02 if kind else 0.1)
        if kind == 2:
            v = middles[0] + rng.normal(size=6) * 0.002
        rows.append(("hot" if k % 5 else f"g{k % 3}", k, [float(x) for x in v]))
    rows += [("hot", 1000 + i, rows[1][2]) for i in range(30)]
    rows += [("odd", 2000, [1.0, 1.0]), ("odd", 2001, None), ("odd", 2002, [1.0, None]), ("odd", 2003, [1.0, 2.0, 4.0]),
             ("odd", 2004, [1.0, 2.0]), ("odd", 2005, [2.0, 4.0]), (None, 2006, [1.0, 2.0]), (None, 2007, [1.0, 3.0]), ("odd", 2008, [])]
    df = spark.createDataFrame(rows, "g string, k bigint, v array<double>").repartition(4)
    want = twins_by_loops(rows, 0.995)
    for leaf, pivots in ((60, 8), (10_000, 8), (20, 3)):
        got = N.twin_links(df, "g", "k", "v", leaf=leaf, pivots=pivots).collect()
        assert len(got) == len(want)
        assert {(r["g"], r["k"]): (r["copies"], r["links"]) for r in got} == want
    assert N.twin_links(df.limit(0), "g", "k", "v").collect() == []


def test_glyph_report(spark):
    a, b = [0.0, 90.0, 10.0], [80.0, 0.0, 5.0]
    rows = [(1, 0, a), (1, 1, b), (1, 1, b), (1, 2, a), (2, 0, a), (2, 0, b), (2, 1, b), (2, None, a), (2, 2, b), (2, -1, b)]
    df = spark.createDataFrame(rows, "g int, k int, v array<double>")
    got = {r["g"]: tuple(r)[1:] for r in M.glyph_report(df, "g", "k", "v", 2).collect()}
    assert got == {1: (4, 2, 1, 1, 0), 2: (6, 2, 3, 0, 1)}  # rows, places, outside, copies, conflicting
    failed = {r["g"]: r["passed"] for r in M.glyph_quality(df, "g", "k", "v", 2).collect()}
    assert failed[2] is False


def test_nearest_points(spark):
    rng = random.Random(5)
    anchors = [(i, rng.uniform(0, 200), rng.uniform(0, 200)) for i in range(300)]
    anchors += [(300 + i, 50 + rng.random(), 50 + rng.random()) for i in range(300)]  # a hot cell
    anchors += [(700, 10.0, 10.0), (699, 10.0, 10.0), (701, None, 3.0)]
    probes = [(i, rng.uniform(-40, 240), rng.uniform(-40, 240)) for i in range(400)] + [(400, 10.0, 10.0), (401, None, 1.0), (402, 50.5, 50.5)]
    want = {}
    for p, x, y in probes:
        near = [(math.sqrt((x - a) ** 2 + (y - b) ** 2), i) for i, a, b in anchors if x is not None and a is not None]
        near = min((d for d in near if d[0] < 25), default=(None, None))
        want[p] = near[1]
    a = spark.createDataFrame(anchors, "anchor bigint, x double, y double")
    p = spark.createDataFrame(probes, "probe bigint, x double, y double")
    for levels in (1, 4):
        got = N.nearest_points(p, a, "probe", "anchor", 25.0, levels=levels).collect()
        assert len(got) == len(want) and {r["probe"]: r["anchor"] for r in got} == want
    assert all(r["anchor"] is None for r in N.nearest_points(p, a.limit(0), "probe", "anchor", 25.0).collect())


def test_interval_table(spark):
    rng = random.Random(9)
    inf = float("inf")
    bins = [(f"b{i}", lo, lo + 10 ** rng.uniform(-3, 4)) for i in range(80) for lo in [rng.uniform(-500, 500)]]
    bins += [("all", -inf, inf), ("high", 100.0, inf), ("none", 5.0, 5.0), ("turned", 6.0, 4.0), ("null", None, 3.0), ("one", 7.0, 8.0)]
    values = [(i, rng.uniform(-1000, 1000)) for i in range(300)] + [(300, 7.0), (301, 8.0), (302, None), (303, float("nan")), (304, -inf), (305, 1e308), (306, 0.0)]
    want = sorted((i, b) for i, v in values for b, lo, hi in bins if v is not None and lo is not None and lo <= v < hi)
    df = spark.createDataFrame(values, "id bigint, v double")
    table = spark.createDataFrame(bins, "bin string, lo double, hi double")
    assert sorted((r["id"], r["bin"]) for r in N.interval_table_join(df, "v", table).collect()) == want
    assert N.interval_table_join(df, "v", table.limit(0)).collect() == []


@pytest.mark.parametrize("prefixes", [["ab", "abc", "Ab", "x", None], ["", "q"], []])
def test_prefix_table(spark, prefixes):
    names = ["abc", "AB", "a", "", None, "xyz", "b", "abc", "Xx"]
    rows = list(enumerate(names))
    df = spark.createDataFrame(rows, "id bigint, name string")
    table = spark.createDataFrame([(p,) for p in prefixes], "prefix string")
    listed = tuple(p.lower() for p in prefixes if p is not None)
    want = [i for i, n in rows if n is not None and any(n.lower().startswith(p) for p in listed)]
    from pyspark.sql import functions as F
    got = N.prefix_table_allowlist(df, F.col("name"), table, "prefix")
    assert sorted(r["id"] for r in got.collect()) == want and got.columns == ["id", "name"]


def test_interval_totals(spark):
    """Ends that meet values, overlap, repeated values, empty and NULL intervals, NULL values: as the pairs would count."""
    rng = random.Random(11)
    values = [(i, rng.choice([None, rng.randint(-50, 50) / 2]) if i % 9 == 0 else rng.randint(-50, 50) / 2) for i in range(400)]
    bins = [(b, rng.randint(-30, 30), rng.randint(-30, 30)) for b in range(60)] + [(60, None, 5), (61, 3, None), (62, -100, 100)]
    got = N.interval_totals(
        spark.createDataFrame(values, "id bigint, v double"), "v", "id", spark.createDataFrame(bins, "bin bigint, lo bigint, hi bigint")
    ).collect()
    inside = lambda lo, hi: [i for i, v in values if None not in (lo, hi, v) and lo <= v < hi]
    assert {tuple(r) for r in got} == {(b, lo, hi, len(inside(lo, hi)), sum(inside(lo, hi))) for b, lo, hi in bins} and len(got) == len(bins)
