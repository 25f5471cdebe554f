"""Candidate quads: filtering, scoring, choosing, and the fallback chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.functions.binding import let
from gridspark.session import materialise

# Fixed values.
EXPECTED_CELLS = 81
CELL_AREA = (200 / 9) ** 2
CELL_BAND = (0.2, 3.0)
MIN_COMPONENTS = 6


def keep_candidates(quads: DataFrame, image_area: Column) -> DataFrame:
    """Four vertices, convex, 1-99 % of the image: the cheap tests before any scoring."""
    return quads.filter(
        G.in_area_band(F.col("area"), image_area) & (F.size("corners") == 4) & G.is_convex(F.col("corners"))
    )


def normalise_to_group_max(df: DataFrame, key: str, value: str | Column, out: str) -> DataFrame:
    """value / max(value) of its group, 0 where the maximum is 0.

    Maximum by partial aggregation and a join back, not a window: a group may hold a large
    part of the rows, and a skewed join is split at run time where a window is not. A value
    given as an expression is computed on both sides of the join, not moved by it.
    """
    value = F.col(value) if isinstance(value, str) else value
    top = df.groupBy(key).agg(F.max(value).alias("_top"))
    share = F.when(F.col("_top") > 0, value / F.col("_top")).otherwise(F.lit(0.0))
    return df.join(top, key).withColumn(out, share).drop("_top")


def with_score3(quads: DataFrame, width: Column, height: Column, key: str = "image_id") -> DataFrame:
    """Quads that come with ``area_norm`` are scored where they are; else the largest area of their image is joined."""
    # Shape first: the join then moves two numbers in place of the corners, unless those are used later.
    scored = quads.withColumns({
        "square": G.squareness(F.col("corners")),
        "centre": G.centredness(F.col("corners"), width, height),
    })
    if "area_norm" not in quads.columns:
        scored = normalise_to_group_max(scored, key, "area", "area_norm")
    return scored.withColumn("score3", G.score3(F.col("area_norm"), F.col("square"), F.col("centre")))


def with_score5(scored: DataFrame) -> DataFrame:
    """Needs the columns of ``with_score3`` and ``structure``, ``cell_score``."""
    return scored.withColumn(
        "score5",
        G.score5(F.col("area_norm"), F.col("square"), F.col("centre"), F.col("structure"), F.col("cell_score")),
    )


def with_component_scores(scored: DataFrame, components: DataFrame, quad: str, area: str) -> DataFrame:
    """``score5`` with the component score of each quad, not of its image.

    ``scored`` has the columns of ``with_score3``, a unique ``quad`` and ``structure``;
    ``components`` has the pixel counts found inside each quad. A quad without components
    or structure scores 0 there.
    """
    found = component_consistency(components, quad, area).select(quad, "cell_score")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return with_score5(scored.join(found, quad, "left").withColumns(
        {"structure": zero("structure"), "cell_score": zero("cell_score")}
    ))


def best_per_group(df: DataFrame, key: str, score: Column, tie: str, keep: list[str]) -> DataFrame:
    """The row with the highest score, lowest ``tie`` first: an aggregate, not a window."""
    row = F.struct(F.col(tie), *[F.col(c) for c in keep], score.alias("score"))
    return df.groupBy(key).agg(F.min_by(row, F.struct(-score, F.col(tie))).alias("_best")).select(
        key, "_best.*"
    )


def top_n_per_group(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The n first rows of each group. The rank filter keeps n rows per group and task
    before the shuffle, so a hot group arrives already cut."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rank_disagreement(scored: DataFrame, key: str, tie: str, min_distance: float = 30.0) -> DataFrame:
    """Images whose two scores choose quads with centroids at least ``min_distance`` apart.

    Both choices come from one aggregation.
    """
    row = F.struct(F.col(tie).alias("id"), G.centroid(F.col("corners")).alias("p"))
    picks = scored.groupBy(key).agg(
        F.min_by(row, F.struct(-F.col("score3"), F.col(tie))).alias("a"),
        F.min_by(row, F.struct(-F.col("score5"), F.col(tie))).alias("b"),
    )
    gap = G.distance(F.col("a.p"), F.col("b.p"))
    return picks.select(
        key, F.col("a.id").alias("by_score3"), F.col("b.id").alias("by_score5"), gap.alias("distance")
    ).filter(F.col("distance") >= min_distance)


def component_consistency(components: DataFrame, key: str, area: str) -> DataFrame:
    """(key, components, median_area, cell_score) from pixel counts of connected components.

    Areas are whole pixels inside a fixed band, so counting by (key, area) first leaves at
    most a few thousand rows per image for mean, deviation and median alike.
    """
    low, high = (CELL_AREA * b for b in CELL_BAND)
    inside = F.when((F.col(area) > low) & (F.col(area) < high), F.col(area))
    counted = components.select(key, inside.alias("_a")).groupBy(key, "_a").agg(F.count("*").alias("_n"))
    a, n = F.col("_a"), F.when(F.col("_a").isNotNull(), F.col("_n"))
    stats = counted.groupBy(key).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("components"),
        (F.sum(a * n) / F.sum(n)).alias("_mean"), (F.sum(a * a * n) / F.sum(n)).alias("_square"),
        F.percentile("_a", F.lit(0.5), F.col("_n")).alias("_median"),
    )
    count, mean = F.col("components"), F.col("_mean")
    closeness = F.greatest(F.lit(0.0), 1 - F.abs(count - EXPECTED_CELLS) / F.lit(EXPECTED_CELLS))
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("_square") - mean * mean))
    even = F.greatest(F.lit(0.0), 1 - deviation / mean)
    return stats.select(
        key, "components", F.coalesce("_median", F.lit(0.0)).alias("median_area"),
        F.when(count >= MIN_COMPONENTS, closeness * even).otherwise(F.lit(0.0)).alias("cell_score"),
    )


def component_score(areas: Column) -> Column:
    """The ``cell_score`` of ``component_consistency`` for components that a row holds as an array."""
    low, high = (CELL_AREA * b for b in CELL_BAND)

    def score(inside: Column) -> Column:
        n = F.size(inside)
        sum_of = lambda f: F.aggregate(inside, F.lit(0).cast("bigint"), lambda s, a: s + f(a))
        closeness = F.greatest(F.lit(0.0), 1 - F.abs(n - EXPECTED_CELLS) / F.lit(EXPECTED_CELLS))
        even = let(
            F.struct((sum_of(lambda a: a) / n).alias("mean"), (sum_of(lambda a: a * a) / n).alias("square")),
            lambda m: F.greatest(F.lit(0.0), 1 - F.sqrt(F.greatest(F.lit(0.0), m["square"] - m["mean"] * m["mean"])) / m["mean"]),
        )
        return F.when(n >= MIN_COMPONENTS, closeness * even).otherwise(F.lit(0.0))

    return let(F.filter(areas, lambda a: (a > low) & (a < high)), score)


# --- first success ----------------------------------------------------------

def first_success(attempts: DataFrame, key: str, step: str, result: str) -> DataFrame:
    """The lowest step that produced a result; without one the result is NULL and step 0."""
    ok = F.col(result).isNotNull()
    best = F.min_by(
        F.struct(F.col(step).alias("step"), F.col(result).alias("result")), F.when(ok, F.col(step))
    )
    return attempts.groupBy(key).agg(F.count_if(ok).alias("_n"), best.alias("_b")).select(
        key,
        F.when(F.col("_n") > 0, F.col("_b.step")).otherwise(F.lit(0)).alias("step"),
        F.when(F.col("_n") > 0, F.col("_b.result")).alias("result"),
    )


def run_until_success(
    items: DataFrame, key: str, steps: list[Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Run each step only on items that no earlier step solved.

    A step maps items to ``key, result`` and leaves out what it cannot solve. Each result
    is checkpointed, so an expensive step runs once and only on the remainder.
    """
    remaining, solved = items, None
    for number, step in enumerate(steps, 1):
        hits = materialise(step(remaining).select(key, F.lit(number).alias("step"), "result"))
        solved = hits if solved is None else solved.unionByName(hits)
        remaining = remaining.join(hits.select(key), key, "left_anti")
    return items.select(key).join(solved, key, "left").withColumn("step", F.coalesce("step", F.lit(0)))


def step_contribution(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("step").agg(F.count("*").alias("images"))


def nearest_within(df: DataFrame, points: str, x: Column, y: Column, radius: float = 25.0) -> DataFrame:
    """Add ``nearest``: index of the closest of a row's points within the radius, else -1.

    A row carries its few corners, so there is nothing to join.
    """
    def ranked(p: Column, i: Column) -> Column:
        dx, dy = p["x"] - x, p["y"] - y
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), i.alias("i"))

    best = F.array_min(F.filter(F.transform(F.col(points), ranked), lambda s: s["d"] < radius))
    return df.withColumn("nearest", F.coalesce(best["i"], F.lit(-1)))
