"""Scoring of predictions against truth.

Everything starts from one fact table of scored cells:
``image_id, r, c, cell, predicted, conf, best_digit, is_filtered, gt_digit, filled, correct``.
All summaries are conditional aggregates over it: one scan, partial sums before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import cells
from gridspark.functions.binding import literal_rows, safe_divide

# Fixed values.
CALIBRATION_BINS = [(0.0, 0.5, "low"), (0.5, 0.8, "medium"), (0.8, 1.01, "high")]
SWEEP_THRESHOLDS = [0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
QUALITY_MINIMA = {"images": 37, "detected": 33, "filled_acc": 0.55, "solved": 4}
RESCUE_THRESHOLDS = [0.3 + 0.05 * i for i in range(14)]


count_if = F.count_if


def score_cells(df: DataFrame, cell: str = "cell", predicted: str = "predicted") -> DataFrame:
    """Add gt_digit, filled and correct. A projection: no shuffle."""
    truth = F.col(cell)
    return df.withColumns({
        "gt_digit": cells.first_nonzero(truth),
        "filled": cells.is_filled(truth),
        "correct": cells.match_any(F.col(predicted), truth),
    })


def clues_right(predicted: Column, truth: Column) -> Column:
    """Every filled cell of a grid is read as one of its values; digits read into blanks do not matter.

    ``predicted``: one digit a cell; ``truth``: the acceptable values a cell.
    """
    fine = F.zip_with(predicted, truth, lambda p, t: ~F.coalesce(cells.is_filled(t), F.lit(False)) | F.coalesce(cells.match_any(p, t), F.lit(False)))
    return (F.size(predicted) == F.size(truth)) & F.forall(fine, lambda ok: ok)


def join_pred_truth(predictions: DataFrame, truth: DataFrame, key: str = "image_id") -> DataFrame:
    """Match predicted and true grids, then unfold to cells.

    Both sides carry one row per image with 81-element arrays, so the shuffle moves images,
    not cells. ``predictions``: key, predicted, conf, ...arrays; ``truth``: key, cell.
    A merge join: it keeps sides that are dealt and ordered by key as they are, and estimates of
    tables of arrays, far too small, must not make a broadcast.
    """
    arrays = [c for c in predictions.columns if c != key]
    joined = predictions.join(truth.select(key, "cell").hint("merge"), key)
    zipped = F.arrays_zip(*[F.col(c) for c in arrays], F.col("cell"))
    return joined.select(key, F.posexplode(zipped).alias("idx", "v")).select(
        key, "idx", (F.col("idx") / 9).cast("int").alias("r"), (F.col("idx") % 9).alias("c"), "v.*"
    )


# --- totals -----------------------------------------------------------------

def accuracy_columns() -> list[Column]:
    right, filled = F.col("correct"), F.col("filled")
    n, n_filled = F.count("*"), count_if(filled)
    return [
        n.alias("cells"),
        n_filled.alias("filled_cells"),
        safe_divide(count_if(right), n).alias("overall_acc"),
        safe_divide(count_if(right & filled), n_filled).alias("filled_acc"),
        safe_divide(count_if(right & ~filled), count_if(~filled)).alias("empty_acc"),
    ]


def error_columns() -> list[Column]:
    right, filled, read = F.col("correct"), F.col("filled"), F.col("predicted") != 0
    return [
        count_if(filled & ~read).alias("missed"),
        count_if(filled & read & ~right).alias("wrong_digit"),
        count_if(~filled & read).alias("hallucinated"),
    ]


def accuracy_summary(scored: DataFrame, *groups: str) -> DataFrame:
    return scored.groupBy(*groups).agg(*accuracy_columns())


def error_breakdown(scored: DataFrame, *groups: str) -> DataFrame:
    return scored.groupBy(*groups).agg(*error_columns())


WRONG_CLASSES = ("missed_by_empty_filter", "missed_by_low_confidence", "wrong_digit", "hallucinated")


def error_class() -> Column:
    right, filled = F.col("correct"), F.col("filled")
    return (
        F.when(right & filled, "correct_filled")
        .when(right, "correct_empty")
        .when(filled & F.col("is_filtered"), "missed_by_empty_filter")
        .when(filled & (F.col("predicted") == 0), "missed_by_low_confidence")
        .when(filled, "wrong_digit")
        .otherwise("hallucinated")
    )


def error_taxonomy(scored: DataFrame) -> DataFrame:
    return scored.groupBy(error_class().alias("error_class")).agg(F.count("*").alias("n"))


def samples_per_class(scored: DataFrame, n: int = 12) -> DataFrame:
    """Up to n example cells per error class; the low-confidence class by probability.

    Each class is ordered up to a limit, for which a task keeps n rows whatever it reads; a rank
    filter would sort all wrong cells of a task. Only those rows are ranked.
    """
    label = error_class()
    prob = F.when(label == "missed_by_low_confidence", F.col("conf")).otherwise(F.lit(0.0))
    order = [F.desc("_prob"), F.asc("image_id"), F.asc("r"), F.asc("c")]
    wrong = scored.filter("NOT correct").select(
        "image_id", "r", "c", "predicted", "gt_digit", "conf", label.alias("error_class"), prob.alias("_prob")
    )
    firsts = [wrong.filter(F.col("error_class") == k).orderBy(*order).limit(n) for k in WRONG_CLASSES]
    ranked = reduce(DataFrame.unionByName, firsts).withColumn(
        "rank", F.row_number().over(Window.partitionBy("error_class").orderBy(*order))
    )
    return ranked.drop("_prob")


# --- confusion, calibration, thresholds -------------------------------------

def confusion_counts(scored: DataFrame) -> DataFrame:
    return (
        scored.filter("filled").groupBy(F.col("gt_digit").alias("gt"), "predicted")
        .agg(F.count("*").alias("n"))
    )


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """One row per true digit, counts p0..p9 and the share read correctly.

    The cells are counted once by (truth, prediction); the pivot sees at most 100 rows.
    """
    counts = confusion_counts(scored)
    cell = lambda d: F.coalesce(F.sum(F.when(F.col("predicted") == d, F.col("n"))), F.lit(0))
    hit = F.coalesce(F.sum(F.when(F.col("predicted") == F.col("gt"), F.col("n"))), F.lit(0))
    return counts.groupBy("gt").agg(
        *[cell(d).alias(f"p{d}") for d in range(10)],
        safe_divide(hit, F.sum("n")).alias("class_acc"),
    )


def normalised_confusion(scored: DataFrame) -> DataFrame:
    counts = confusion_counts(scored)
    totals = counts.groupBy("gt").agg(F.sum("n").alias("total"))
    return counts.join(totals, "gt").select(
        "gt", "predicted", "n", (F.col("n") / F.col("total")).alias("share")
    )


def interval_join(df: DataFrame, value: str, bins: list[tuple[float, float, str]]) -> DataFrame:
    """Tag each row with the half-open bin [lo, hi) that holds its value.

    The bins are constants of the query, so the range join is a CASE in the scan stage.
    """
    v = F.col(value)
    label = reduce(
        lambda acc, b: acc.when((v >= b[0]) & (v < b[1]), F.lit(b[2])),
        bins[1:],
        F.when((v >= bins[0][0]) & (v < bins[0][1]), F.lit(bins[0][2])),
    )
    return df.withColumn("bin", label.otherwise(F.lit("outside")))


def calibration(scored: DataFrame, bins=CALIBRATION_BINS) -> DataFrame:
    """Cells and accuracy per confidence bin; an empty bin is reported with zero cells."""
    counted = (
        interval_join(scored, "conf", bins).groupBy("bin")
        .agg(F.count("*").alias("cells"), count_if(F.col("correct")).alias("right"))
    )
    labels = literal_rows(scored.sparkSession, "bin", [b[2] for b in bins])
    return labels.join(counted, "bin", "left").select(
        "bin",
        F.coalesce("cells", F.lit(0)).alias("cells"),
        safe_divide(F.coalesce("right", F.lit(0)), F.coalesce("cells", F.lit(0))).alias("accuracy"),
    )


def threshold_join(df: DataFrame, value: str, thresholds: list[float], counts: dict[str, Column]) -> DataFrame:
    """For each threshold: every count over rows at or above it (``_ge``) and below (``_lt``).

    Joining each threshold to each row would multiply the cells. The rows are counted by
    the number of thresholds they reach, once; the thresholds then meet at most
    ``len(thresholds) + 1`` rows.
    """
    ordered = sorted(thresholds)
    level = reduce(lambda a, b: a + b, [(F.col(value) >= t).cast("int") for t in ordered])
    by_level = df.groupBy(level.alias("_level")).agg(*[count_if(c).alias(n) for n, c in counts.items()])
    at = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("need"))
        for i, t in enumerate(ordered)
    ]))
    joined = by_level.select("*", at.alias("_t"))
    reached = F.col("_level") >= F.col("_t.need")
    parts = []
    for name in counts:
        parts.append(F.sum(F.when(reached, F.col(name)).otherwise(0)).alias(f"{name}_ge"))
        parts.append(F.sum(F.when(~reached, F.col(name)).otherwise(0)).alias(f"{name}_lt"))
    return joined.groupBy(F.col("_t.threshold").alias("threshold")).agg(*parts)


def threshold_sweep(scored: DataFrame, thresholds=SWEEP_THRESHOLDS) -> DataFrame:
    """Accuracy and error counts had the gate used each threshold; filtered cells read 0."""
    filled, seen = F.col("filled"), ~F.col("is_filtered")
    hit = cells.match_any(F.col("best_digit"), F.col("cell"))
    t = threshold_join(scored, "conf", thresholds, {
        "hit": filled & seen & hit,
        "miss": filled & seen & ~hit,
        "blank": ~filled & seen,
        "blank_filtered": ~filled & ~seen,
        "filled": filled,
        "empty": ~filled,
    })
    both = lambda name: F.col(f"{name}_ge") + F.col(f"{name}_lt")
    right_filled = F.col("hit_ge")
    right_empty = F.col("blank_lt") + both("blank_filtered")
    n_filled, n_empty = both("filled"), both("empty")
    return t.select(
        "threshold",
        safe_divide(right_filled, n_filled).alias("filled_acc"),
        safe_divide(right_empty, n_empty).alias("empty_acc"),
        safe_divide(right_filled + right_empty, n_filled + n_empty).alias("overall_acc"),
        (n_empty - right_empty).alias("hallucinated"),
        (n_filled - right_filled - F.col("miss_ge")).alias("missed"),
        F.col("miss_ge").alias("wrong"),
    )


def rescue_curve(scored: DataFrame, thresholds=RESCUE_THRESHOLDS) -> DataFrame:
    """Digits a lower gate would rescue against the hallucinations it would add."""
    seen = ~F.col("is_filtered")
    hit = cells.match_any(F.col("best_digit"), F.col("cell"))
    return threshold_join(scored, "conf", thresholds, {
        "rescued": F.col("filled") & seen & (F.col("predicted") == 0) & hit,
        "added": ~F.col("filled") & seen,
    }).select("threshold", F.col("rescued_ge").alias("rescued"), F.col("added_ge").alias("hallucinated"))


def position_analysis(scored: DataFrame) -> DataFrame:
    edge = F.col("r").isin(0, 8) | F.col("c").isin(0, 8)
    return (
        scored.filter("filled")
        .groupBy(F.when(edge, "edge").otherwise("interior").alias("position"))
        .agg(F.count("*").alias("cells"), safe_divide(count_if(F.col("correct")), F.count("*")).alias("accuracy"))
    )


# --- per image --------------------------------------------------------------

def per_image_breakdown(scored: DataFrame, *keep: str) -> DataFrame:
    right, filled, read = F.col("correct"), F.col("filled"), F.col("predicted") != 0
    return scored.groupBy("image_id", *keep).agg(
        count_if(filled).alias("filled"),
        count_if(filled & right).alias("correct"),
        count_if(filled & ~right & ~read).alias("missed"),
        count_if(filled & ~right & read).alias("wrong"),
        count_if(~filled & ~right).alias("hallucinated"),
        count_if(~filled).alias("empty"),
        count_if(~filled & right).alias("empty_correct"),
    )


def per_image_accuracy(scored: DataFrame) -> DataFrame:
    """(image_id, accuracy, filled) of images that have filled cells."""
    return (
        scored.filter("filled").groupBy("image_id")
        .agg(F.count("*").alias("filled"), count_if(F.col("correct")).alias("right"))
        .select("image_id", (F.col("right") / F.col("filled")).alias("accuracy"), "filled")
    )


def accuracy_distribution(scored: DataFrame) -> DataFrame:
    """Images, mean and median of the per-image accuracy.

    A share of at most 81 cells takes a few thousand values, so the median state is bounded.
    """
    counted = per_image_accuracy(scored).groupBy("accuracy").agg(F.count("*").alias("_n"))
    n = F.col("_n")
    return counted.agg(
        F.sum(n).alias("images"), (F.sum(F.col("accuracy") * n) / F.sum(n)).alias("mean_acc"),
        F.percentile("accuracy", F.lit(0.5), n).alias("median_acc"),
    )


def worst_best(scored: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest and the n highest images by filled-cell accuracy."""
    images = per_image_accuracy(scored)
    worst = images.orderBy("accuracy", "image_id").limit(n).withColumn("side", F.lit("worst"))
    best = images.orderBy(F.desc("accuracy"), F.desc("image_id")).limit(n).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


def accuracy_bands(scored: DataFrame) -> DataFrame:
    images = per_image_accuracy(scored)
    acc = F.col("accuracy")
    return images.agg(
        F.count("*").alias("images"),
        count_if(acc >= 0.9).alias("at_least_90"),
        count_if(acc < 0.5).alias("below_50"),
        count_if((acc >= 0.5) & (acc < 0.9)).alias("between"),
    )


def perfect_images(scored: DataFrame, scope: str = "all") -> DataFrame:
    """(image_id, perfect). Scope 'clues' forgives digits read on blank cells."""
    good = F.col("correct") if scope == "all" else F.col("correct") | ~F.col("filled")
    return scored.groupBy("image_id").agg(F.bool_and(good).alias("perfect"))


def perfect_rate(images: DataFrame, scored: DataFrame, scope: str = "all") -> DataFrame:
    """Share of all images that are perfect; an image without a reading is not."""
    perfect = images.select("image_id").join(perfect_images(scored, scope), "image_id", "left")
    hits = count_if(F.coalesce("perfect", F.lit(False)))
    return perfect.agg(
        F.count("*").alias("images"), hits.alias("perfect"),
        safe_divide(hits, F.count("*")).alias("perfect_rate"),
    )


def image_stats(scored: DataFrame) -> DataFrame:
    """Per-image totals for frames and devices; ``detected`` is a column of ``scored``.

    An undetected image adds to the totals but never to the error counts.
    """
    b = per_image_breakdown(scored, "detected")
    seen = F.col("detected")
    only = lambda name: F.when(seen, F.col(name)).otherwise(F.lit(0)).alias(name)
    return b.select(
        "image_id", "detected", "filled", "empty",
        only("correct"), only("empty_correct"), only("missed"), only("wrong"), only("hallucinated"),
        (seen & (F.col("missed") + F.col("wrong") + F.col("hallucinated") == 0)).alias("perfect"),
    )


def frames_summary(stats: DataFrame, solved: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """Sums over all images and over the detected ones; one row per frame.

    ``solved`` (key, success) is the outcome of the solver; an image counts as solvable if it was detected and solved.
    Each image contributes to one or two frames of one aggregate; no second scan.
    """
    if solved is None:
        stats = stats.withColumn("_solved", F.lit(False))
    else:
        won = solved.filter("success").select(key, F.lit(True).alias("_solved"))
        stats = stats.join(won, key, "left").withColumn("_solved", F.coalesce("_solved", F.lit(False)) & F.col("detected"))
    frames = F.explode(F.when(F.col("detected"), F.array(F.lit("all"), F.lit("detected"))).otherwise(F.array(F.lit("all"))))
    s = lambda name: F.sum(name)
    errors = s("wrong") + s("missed") + s("hallucinated")
    return stats.withColumn("frame", frames).groupBy("frame").agg(
        F.count("*").alias("images"),
        count_if(F.col("detected")).alias("detected"),
        F.bround(safe_divide(count_if(F.col("detected")), F.count("*")), 4).alias("detection_rate"),
        count_if(F.col("_solved")).alias("solvable"),
        F.bround(safe_divide(count_if(F.col("_solved")), F.count("*")), 4).alias("solve_rate"),
        count_if(F.col("perfect")).alias("perfect"),
        F.bround(safe_divide(count_if(F.col("perfect")), F.count("*")), 4).alias("perfect_rate"),
        s("filled").alias("filled_total"),
        s("correct").alias("filled_correct"),
        F.bround(safe_divide(s("correct"), s("filled")), 4).alias("filled_rate"),
        s("empty").alias("empty_total"),
        s("empty_correct").alias("empty_correct"),
        F.bround(safe_divide(s("empty_correct"), s("empty")), 4).alias("empty_rate"),
        errors.alias("cell_errors"),
        F.bround(safe_divide(errors, 81 * count_if(F.col("detected"))), 6).alias("cell_error_rate"),
    )


def by_device(stats: DataFrame, device: Column) -> DataFrame:
    name = F.coalesce(F.nullif(device, F.lit("")), F.lit("(unknown)"))
    return stats.groupBy(name.alias("device")).agg(
        F.count("*").alias("images"),
        count_if(F.col("detected")).alias("detected"),
        count_if(F.col("perfect")).alias("perfect"),
        safe_divide(count_if(F.col("perfect")), F.count("*")).alias("perfect_rate"),
    )


def compare_runs(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """Two runs side by side; an image missing from one run keeps its row."""
    left = a.select(key, F.col(metric).alias("a"))
    right = b.select(key, F.col(metric).alias("b"))
    return left.join(right, key, "full_outer").select(
        key, F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"),
        F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"),
        F.coalesce(F.col("b") - F.col("a"), F.lit(0.0)).alias("delta"),
    )


def quality_gates(metrics: DataFrame, minima: dict[str, float] = QUALITY_MINIMA) -> DataFrame:
    """One row per gate: value, minimum, passed. ``metrics`` is one wide row."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(float(m)).alias("minimum"))
        for n, m in minima.items()
    ]))
    return metrics.select(rows.alias("g")).select(
        "g.gate", "g.value", "g.minimum", (F.col("g.value") >= F.col("g.minimum")).alias("passed")
    )


# --- solver and detector runs -----------------------------------------------

def detection_summary(images: DataFrame) -> DataFrame:
    """Detection rate, corner errors and overlap. Input: detected, mean_error, iou per image.

    Errors are rounded to 3 and overlaps to 4 decimals: both metrics are first counted by
    value in one pass, and what the medians see is bounded by those domains.
    """
    metrics = F.explode(F.array(
        F.struct(F.lit("error").alias("name"), F.col("mean_error").alias("v")),
        F.struct(F.lit("iou").alias("name"), F.col("iou").alias("v")),
    ))
    counted = (
        images.select("detected", metrics.alias("m")).groupBy("detected", "m.name", "m.v")
        .agg(F.count("*").alias("n"))
    )
    n, seen, v = F.col("n"), F.col("detected"), F.col("v")
    of = lambda name: F.when(seen & (F.col("name") == name), v)
    once = F.col("name") == "iou"  # every image has one row per metric
    total, found = F.sum(F.when(once, n)), F.coalesce(F.sum(F.when(once & seen, n)), F.lit(0))
    mean = lambda name: F.sum(of(name) * n) / F.nullif(F.sum(F.when(of(name).isNotNull(), n)), F.lit(0))
    return counted.agg(
        total.alias("images"), found.alias("detected"),
        F.bround(safe_divide(found, total), 4).alias("detection_rate"),
        mean("error").alias("mean_error"), F.max(of("error")).alias("max_error"),
        mean("iou").alias("mean_iou"),
        F.percentile(of("error"), F.lit(0.5), n).alias("median_error"),
        F.percentile(of("iou"), F.lit(0.5), n).alias("median_iou"),
    )


def failed_images(images: DataFrame, name: str) -> DataFrame:
    """The undetected images as rows: the list grows with the data."""
    return images.filter("NOT detected").select(name)
