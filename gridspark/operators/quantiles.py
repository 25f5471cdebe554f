"""Exact percentiles (linear interpolation) that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import materialise

FEW_BINS = 100_000  # wanted bins that are sent to every task at most


def order_bin(value: Column, per_octave: int = 256) -> Column:
    """A bin number that never decreases with the value and needs no knowledge of the data.

    Logarithmic: a bin spans 1/per_octave of a doubling, so a group has as many bins as its
    values have doublings, times ``per_octave``, whatever its number of rows.
    """
    level = lambda v: F.floor(F.log2(v) * per_octave) + 1100 * per_octave  # above 2^-1100
    return (
        F.when(value > 0, level(value)).when(value < 0, -level(-value)).otherwise(F.lit(0))
        .cast("bigint")
    )


def exact_percentiles(
    df: DataFrame, groups: list[str], value: Column, ps: dict[str, float],
    per_octave: int = 256, stats: bool = False,
) -> DataFrame:
    """For values of any domain and groups of any size; ``stats`` adds n, min, mean, std and max.

    A histogram of a few thousand rows per group, summed up before the shuffle, tells which bin
    holds each wanted rank. A second pass over the values keeps those bins only, collapses them to (group, value,
    count) and orders them. No step moves a group to one task, and values outside the bins never move.
    """
    keys = groups or ["_all"]
    source = df.select(*groups, value.cast("double").alias("_v")).filter("_v IS NOT NULL")
    if not groups:
        source = source.withColumn("_all", F.lit(1))
    source = source.withColumn("_bin", order_bin(F.col("_v"), per_octave))
    hist = source.groupBy(*keys, "_bin").agg(
        F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.avg("_v").alias("_avg"), F.var_pop("_v").alias("_var"),
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumns({
        "_end": F.sum("_m").over(upto), "_total": F.sum("_m").over(whole),
        "_lo": F.min("_lo").over(whole), "_hi": F.max("_hi").over(whole),
    })
    # Moments of the bins are combined around the group's own mean, so values far from 0 keep their spread.
    hist = hist.withColumn("_mean", F.col("_lo") + F.sum(F.col("_m") * (F.col("_avg") - F.col("_lo"))).over(whole) / F.col("_total"))
    gap = F.col("_avg") - F.col("_mean")
    hist = hist.withColumn("_spread", F.sum(F.col("_m") * (F.col("_var") + gap * gap)).over(whole))
    wanted = F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.lit(part).alias("part"),
            edge((F.col("_total") - 1) * F.lit(float(p))).cast("bigint").alias("rank"),
        )
        for name, p in ps.items()
        for part, edge in (("a", F.floor), ("b", F.ceil))
    ])
    hits = (
        hist.withColumn("_w", F.explode(wanted))
        .filter("_w.rank < _end AND _w.rank >= _end - _m")
        .withColumn("_before", F.col("_end") - F.col("_m"))
    )
    # One row per needed bin: the ranks wanted there, two per percentile at most.
    whole_group = ["_total", "_lo", "_hi", "_mean", "_spread"]
    bins_needed = materialise(hits.groupBy(*keys, "_bin").agg(
        F.first("_before").alias("_before"), F.collect_list("_w").alias("_ws"),
        *[F.first(c).alias(c) for c in whole_group],
    ))
    # With few groups the wanted bins fit every task; with many they meet the values in a shuffle.
    few = bins_needed.limit(FEW_BINS + 1).count() <= FEW_BINS
    wanted_bins = bins_needed.select(*keys, "_bin")
    binned = (
        source.join(F.broadcast(wanted_bins) if few else wanted_bins, keys + ["_bin"], "left_semi")
        .groupBy(*keys, "_bin", "_v").agg(F.count("*").alias("_n"))
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        binned.join(bins_needed, keys + ["_bin"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_w", F.explode("_ws"))
        .filter("_w.rank < _end AND _w.rank >= _end - _n")
    )
    picks = []
    for name in ps:
        for part in ("a", "b"):
            chosen = (F.col("_w.name") == name) & (F.col("_w.part") == part)
            picks.append(F.max(F.when(chosen, F.col("_v"))).alias(f"_{name}_{part}"))
    wide = located.groupBy(*keys).agg(*picks, *[F.first(c).alias(c) for c in whole_group])
    out = []
    for name, p in ps.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        frac = at - F.floor(at)
        low, high = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        out.append((low + (high - low) * frac).alias(name))
    if stats:
        out += [
            F.col("_total").alias("n"), F.col("_lo").alias("min"),
            F.col("_mean").alias("mean"), F.col("_hi").alias("max"), F.sqrt(F.col("_spread") / F.col("_total")).alias("std"),
        ]
    return wide.select(*groups, *out)
