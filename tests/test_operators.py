"""Scoring, ranking, table and sample operators on small rows with ties, empties and nulls.

K1, K2, K7, K9, A8, A13, A15-A18, A24, A26, A28, J4-J8, J12-J16, T1-T5, T8.
"""

import numpy as np
from pyspark.sql import functions as F

from gridspark.operators import experiments as X
from gridspark.operators import quads as Q
from gridspark.operators import samples as M
from gridspark.operators import scoring as S
from gridspark.operators import tables as T

CELL = "image_id bigint, r int, c int, cell array<int>, predicted int, best_digit int, conf double, is_filtered boolean, detected boolean"


def scored(spark, rows):
    return S.score_cells(spark.createDataFrame(rows, CELL))


ROWS = [
    (1, 0, 0, [5], 5, 5, 0.9, False, True),      # right
    (1, 0, 1, [5], 0, 5, 0.4, False, True),      # low confidence
    (1, 4, 4, [5], 0, 5, 1.0, True, True),       # empty filter
    (1, 4, 5, [0], 3, 3, 0.5, False, True),      # hallucinated
    (2, 0, 0, [0, 4], 0, 4, 0.3, False, False),  # ambiguous: blank accepted, counts as filled
    (2, 5, 5, [1, 7], 2, 2, 0.8, False, False),  # wrong
    (2, 8, 8, [0], 0, 1, 0.1, False, False),     # right blank
]


def test_totals_and_classes(spark):
    df = scored(spark, ROWS)
    a = S.accuracy_summary(df).first()
    assert (a.cells, a.filled_cells) == (7, 5) and np.isclose(a.filled_acc, 2 / 5) and np.isclose(a.empty_acc, 0.5)
    e = S.error_breakdown(df).first()
    assert (e.missed, e.wrong_digit, e.hallucinated) == (3, 1, 1)
    classes = {r["error_class"]: r["n"] for r in S.error_taxonomy(df).collect()}
    assert classes == {"correct_filled": 2, "correct_empty": 1, "missed_by_empty_filter": 1,
                       "missed_by_low_confidence": 1, "wrong_digit": 1, "hallucinated": 1}


def test_calibration_edges_and_empty_bin(spark):
    bins = {r["bin"]: (r["cells"], r["accuracy"]) for r in S.calibration(scored(spark, ROWS)).collect()}
    assert bins == {"low": (3, 2 / 3), "medium": (1, 0.0), "high": (3, 1 / 3)}
    only = {r["bin"]: r["cells"] for r in S.calibration(scored(spark, ROWS[:1])).collect()}
    assert only == {"low": 0, "medium": 0, "high": 1}


def test_threshold_sweep_by_loop(spark):
    df = scored(spark, ROWS)
    for row in S.threshold_sweep(df, [0.3, 0.5, 0.9]).collect():
        t = row["threshold"]
        filled = [r for r in ROWS if any(r[3])]
        empty = [r for r in ROWS if not any(r[3])]
        hit = sum(not r[7] and r[6] >= t and r[5] in r[3] for r in filled)
        wrong = sum(not r[7] and r[6] >= t and r[5] not in r[3] for r in filled)
        blank = sum(r[7] or r[6] < t for r in empty)
        assert np.isclose(row["filled_acc"], hit / len(filled)) and row["wrong"] == wrong
        assert row["missed"] == len(filled) - hit - wrong and row["hallucinated"] == len(empty) - blank


def test_undetected_images_add_to_totals_only(spark):
    frames = {r["frame"]: r for r in S.frames_summary(S.image_stats(scored(spark, ROWS))).collect()}
    assert frames["all"]["images"] == 2 and frames["detected"]["images"] == 1
    assert frames["all"]["filled_total"] == 5 and frames["all"]["cell_errors"] == 3
    assert frames["all"]["cell_error_rate"] == round(3 / 81, 6)
    devices = S.by_device(S.image_stats(scored(spark, ROWS)), F.when(F.col("image_id") == 1, "").otherwise("a")).collect()
    assert {r["device"] for r in devices} == {"(unknown)", "a"}


def test_perfect_scopes(spark):
    rows = [ROWS[0], (1, 0, 1, [0], 4, 4, 0.9, False, True), (2, 0, 0, [3], 3, 3, 0.9, False, True)]
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id bigint")
    rate = lambda scope: S.perfect_rate(images, scored(spark, rows), scope).first()
    assert (rate("all").perfect, rate("clues").perfect, rate("clues").images) == (1, 2, 3)


def test_detection_summary_without_detections(spark):
    df = spark.createDataFrame([(False, None, 0.0)], "detected boolean, mean_error double, iou double")
    r = S.detection_summary(df).first()
    assert (r.images, r.detected, r.detection_rate, r.mean_error, r.median_iou) == (1, 0, 0.0, None, None)


def test_ties_and_top_n(spark):
    df = spark.createDataFrame([(1, "b", 5.0), (1, "a", 5.0), (1, "c", 4.0), (2, "z", 0.0)], "g int, id string, s double")
    best = {r["g"]: r["id"] for r in Q.best_per_group(df, "g", F.col("s"), "id", []).collect()}
    assert best == {1: "a", 2: "z"}
    top = Q.top_n_per_group(df, "g", [F.desc("s"), F.asc("id")], 2)
    assert {(r["g"], r["id"], r["rank"]) for r in top.collect()} == {(1, "a", 1), (1, "b", 2), (2, "z", 1)}
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # groups are cut before the shuffle
    normed = {r["id"]: r["n"] for r in Q.normalise_to_group_max(df, "g", "s", "n").collect()}
    assert normed == {"a": 1.0, "b": 1.0, "c": 0.8, "z": 0.0}


def test_first_success(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 7), (1, 3, 8), (2, 1, None)], "id int, step int, res int")
    got = {r["id"]: (r["step"], r["result"]) for r in Q.first_success(df, "id", "step", "res").collect()}
    assert got == {1: (2, 7), 2: (0, None)}
    seen = []

    def step(limit):
        def run(left):
            seen.append(sorted(r["id"] for r in left.select("id").collect()))
            return left.filter(f"id <= {limit}").select("id", F.lit(limit).alias("result"))
        return run

    items = spark.createDataFrame([(i,) for i in range(1, 5)], "id int")
    chain = Q.run_until_success(items, "id", [step(1), step(3), step(3)])
    assert {r["id"]: r["step"] for r in chain.collect()} == {1: 1, 2: 2, 3: 2, 4: 0}
    assert seen == [[1, 2, 3, 4], [2, 3, 4], [4]]


def test_components(spark):
    area = lambda image, values: [(image, float(v)) for v in values]
    rows = area(1, [490] * 81) + area(2, [490] * 5) + area(3, [480, 500] * 3) + area(4, [10, 5000])
    got = {r["k"]: r for r in Q.component_consistency(spark.createDataFrame(rows, "k int, a double"), "k", "a").collect()}
    assert got[1]["cell_score"] == 1.0 and got[2]["cell_score"] == 0.0
    assert np.isclose(got[3]["cell_score"], (1 - 75 / 81) * (1 - 10 / 490)) and got[3]["median_area"] == 490.0
    assert (got[4]["components"], got[4]["median_area"]) == (0, 0.0)


def test_key_operators(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = T.upsert(base, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, T.upsert(once, new, "k").collect())) == sorted(map(tuple, once.collect()))
    found, missing = T.redo(base, new, "k")
    assert [r["k"] for r in found.collect()] == [2] and [r["k"] for r in missing.collect()] == [3]
    assert [r["k"] for r in T.resume(base, new, "k").collect()] == [1]
    assert [r["k"] for r in T.delete_keys(base, new, "k").collect()] == [1]
    flags = spark.createDataFrame([(1, True), (2, True)], "k int, f boolean")
    assert {r["k"]: r["f"] for r in T.toggle_flag(flags, new, "k", "f").collect()} == {1: True, 2: False}


def test_prefixes_and_gates(spark):
    names = ["/f/Arial Bold.ttf", "/f/Symbol.ttf", "/f/Bodoni 72.ttc", "/f/Bodoni Ornaments.ttf", "/f/DejaVuSans.otf"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    kept = [r["p"] for r in T.prefix_allowlist(df, F.col("p")).collect()]
    assert kept == [names[0], names[2], names[4]]
    metrics = spark.createDataFrame([(38, 33, 0.54, 4)], "images int, detected int, filled_acc double, solved int")
    assert {r["gate"]: r["passed"] for r in S.quality_gates(metrics).collect()} == {
        "images": True, "detected": True, "filled_acc": False, "solved": True}


def test_outlines_and_axis(spark):
    images = spark.createDataFrame([("a",), ("b",)], "name string")
    outlines = spark.createDataFrame([("a", 1)], "name string, outline int")
    assert {r["name"]: r["has_outline"] for r in T.attach_outlines(images, outlines, "name").collect()} == {"a": True, "b": False}
    assert T.attach_outlines(images, outlines, "name", required=True).count() == 1
    runs = spark.createDataFrame([("x", 2, 0.5), ("y", 3, 0.7)], "name string, depth int, acc double")
    sweep = {r["depth"]: r["state"] for r in X.axis_sweep(runs, "depth", [2, 4], {}, "acc", "name").collect()}
    assert sweep == {2: "done", 4: "pending"}
    absent = X.baseline_anchor(runs, "name", "nope", ["acc"]).collect()
    assert len(absent) == 2 and all(r["base_acc"] is None for r in absent)


def test_compare_runs_keeps_missing(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.6)], "k int, m double")
    b = spark.createDataFrame([(1, 0.7)], "k int, m double")
    rows = {r["k"]: r for r in S.compare_runs(a, b, "k", "m").collect()}
    assert np.isclose(rows[1]["delta"], 0.2) and not rows[2]["in_b"] and rows[2]["delta"] == 0.0


def test_otsu_by_loop(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(60, 10, 300), rng.normal(180, 12, 150)]).clip(0, 255).astype(int)
    got = M.otsu_by_group(spark.createDataFrame([(1, int(v)) for v in values], "g int, v int"), "g", F.col("v")).first()
    scores = {}
    for t in sorted(set(values.tolist())):
        lo, hi = values[values <= t], values[values > t]
        scores[t] = 0.0 if len(hi) == 0 else len(lo) * len(hi) / len(values) ** 2 * (lo.mean() - hi.mean()) ** 2
    assert got["threshold"] == max(scores, key=lambda t: (round(scores[t], 9), -t))


def test_group_split_is_exact_and_disjoint(spark):
    df = spark.createDataFrame([(g, i) for g in range(37) for i in range(3)], "g bigint, i int")
    split = M.group_disjoint_split(df, "g", 0.8, 7)
    assert split.filter("split = 'train'").select("g").distinct().count() == 29
    assert M.split_overlap(split, "g").isEmpty() and split.count() == 111
    again = M.group_disjoint_split(df.repartition(5), "g", 0.8, 7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))


def test_glyphs(spark):
    rng = np.random.default_rng(1)
    rows = [(1, k, rng.uniform(0, 255, 30).tolist()) for k in range(10)]
    rows += [(2, k, [100.0] * 30 if k == 4 else rng.uniform(0, 255, 30).tolist()) for k in range(10)]
    twin = rng.uniform(0, 255, 30).tolist()
    rows += [(3, k, twin if k in (1, 2) else rng.uniform(0, 255, 30).tolist()) for k in range(10)]
    rows += [(4, k, rng.uniform(0, 40, 30).tolist()) for k in range(10)]
    rows += [(5, k, rng.uniform(0, 255, 30).tolist()) for k in range(9)]
    rows += [(1, 3, rows[3][2])] * 50  # copies of one glyph change nothing
    got = {r["g"]: r for r in M.glyph_quality(spark.createDataFrame(rows, "g int, k int, v array<double>"), "g", "k", "v").collect()}
    assert {g: r["passed"] for g, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    corr = np.corrcoef(np.array([r[2] for r in rows[:10]]))[np.triu_indices(10, 1)]
    assert np.isclose(got[1]["max_corr"], corr.max()) and np.isclose(got[1]["mean_corr"], corr.mean())


def test_augmentation_repeats_itself(spark):
    df = spark.createDataFrame([(i, [100.0 + j for j in range(16)]) for i in range(60)], "id bigint, v array<double>")
    both = M.dual_eval_tables(df, "id", "v", 9)
    rows = {(r["id"], r["variant"]): r["v"] for r in both.collect()}
    again = {(r["id"], r["variant"]): r["v"] for r in M.dual_eval_tables(df.repartition(7), "id", "v", 9).collect()}
    assert rows == again and len(rows) == 120
    assert all(rows[i, "clean"] == [100.0 + j for j in range(16)] for i in range(60))
    assert all(min(rows[i, "augmented"]) == 0.0 and max(rows[i, "augmented"]) == 255.0 for i in range(60))
    assert len({tuple(rows[i, "augmented"]) for i in range(60)}) > 10


def test_spread_of_values_far_from_zero(spark):
    """Deviation equals stddev_pop whatever the offset."""
    from gridspark.operators.quantiles import exact_percentiles

    values = spark.range(1_000).selectExpr("id % 3 AS g", "1e9D + id % 2 AS v").unionByName(
        spark.range(500).selectExpr("9L AS g", "-7e11D + id * 0.5D AS v")).unionByName(spark.sql("SELECT 8L AS g, 5D AS v"))
    got = exact_percentiles(values, ["g"], F.col("v"), {"p50": 0.5}, stats=True)
    want = values.groupBy("g").agg(F.stddev_pop("v").alias("want"), F.avg("v").alias("middle"))
    for row in got.join(want, "g").collect():
        assert abs(row["std"] - row["want"]) < 1e-6 and abs(row["mean"] - row["middle"]) <= 1e-12 * abs(row["middle"])


def test_clues_right(spark):
    """K9: blanks do not matter, several values may be right, a missing grid is not right."""
    from gridspark.operators.scoring import clues_right
    rows = [(1, [5, 9], [[5], [0]]), (2, [6, 0], [[5], [0]]), (3, [7, 0], [[5, 7], [0, 0]]), (4, [5], [[5], [3]]), (5, None, [[5]]), (6, [0], [[]])]
    df = spark.createDataFrame(rows, "i int, p array<int>, t array<array<int>>")
    fit = df.filter(clues_right(F.col("p"), F.col("t")))
    assert sorted(r["i"] for r in fit.collect()) == [1, 3, 6]
