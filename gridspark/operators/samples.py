"""Labelled vectors: profiles, splits, leakage, glyph quality, weighting, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import vectors as V
from gridspark.functions.binding import let, total
from gridspark.operators.ordered import global_rank
from gridspark.operators.quantiles import exact_percentiles

# Fixed values.
BLANK_MAX = 50.0
CONSTANT_STD = 1e-6
TWIN_CORRELATION = 0.995
ALIKE_CORRELATION = 0.85
MIN_GROUPS = 10
EMPTY_CLASS_WEIGHT = 2.0
PROFILE_POINTS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


# --- distributions ----------------------------------------------------------

def class_share(samples: DataFrame, label: str, empty_weight: float = EMPTY_CLASS_WEIGHT) -> DataFrame:
    """Share per label, the class weight, and the share of the weighted loss."""
    counts = samples.groupBy(label).agg(F.count("*").alias("n"))
    weight = F.when(F.col(label) == 0, F.lit(empty_weight)).otherwise(F.lit(1.0))
    weighted = counts.withColumn("weight", weight)
    totals = weighted.agg(
        F.struct(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("weight")).alias("w"))
    ).scalar()
    return weighted.withColumn("_t", totals).select(
        label, "n", (F.col("n") / F.col("_t.n")).alias("share"), "weight",
        (F.col("n") * F.col("weight") / F.col("_t.w")).alias("weighted_share"),
    )


def distribution_profile(samples: DataFrame, source: str, vec: str) -> DataFrame:
    """Mean, deviation and percentiles of all vector values per source."""
    values = samples.select(source, F.explode(V.as_doubles(F.col(vec))).alias("v"))
    profile = exact_percentiles(values, [source], F.col("v"), PROFILE_POINTS, stats=True)
    return profile.select(source, F.col("n").alias("values"), "mean", "std", *PROFILE_POINTS)


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Density histogram of fixed-width bins; empty bins included."""
    counts = (
        df.select(V.histogram_bin(value, low, high, bins).alias("bin")).filter("bin IS NOT NULL")
        .groupBy("bin").agg(F.count("*").alias("n"))
    )
    width = (high - low) / bins
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    full = every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    everything = Window.partitionBy()  # ``bins`` rows
    return full.select(
        "bin", "n", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(everything) * width), F.lit(0.0)).alias("density")
    )


def otsu_by_group(df: DataFrame, group: str, value: Column, bins: int = 256) -> DataFrame:
    """(group, threshold, between): level that maximises the between-class variance.

    Values are levels 0..bins-1: the group shrinks to its histogram before any window.
    """
    hist = df.select(group, value.cast("int").alias("level")).groupBy(group, "level").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(group).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    weight = F.col("n") * F.col("level")
    sums = hist.select(
        group, "level",
        F.sum("n").over(upto).alias("n0"), F.sum(weight).over(upto).alias("s0"),
        F.sum("n").over(whole).alias("nt"), F.sum(weight).over(whole).alias("st"),
    )
    n1, s1 = F.col("nt") - F.col("n0"), F.col("st") - F.col("s0")
    gap = F.col("s0") / F.col("n0") - F.try_divide(s1, n1)
    between = F.coalesce(
        (F.col("n0") / F.col("nt")) * (n1 / F.col("nt")) * gap * gap, F.lit(0.0)
    )
    return sums.withColumn("between", F.round(between, 9)).groupBy(group).agg(
        F.min_by("level", F.struct(-F.col("between"), F.col("level"))).alias("threshold"),
        F.max("between").alias("between"),
    )


def log_loss(df: DataFrame, probs: str, label: str, empty_weight: float = EMPTY_CLASS_WEIGHT) -> DataFrame:
    """Class-weighted cross-entropy and top-1 accuracy over all classes."""
    weight = F.when(F.col(label) == 0, F.lit(empty_weight)).otherwise(F.lit(1.0))
    p = F.col(probs)
    loss = -F.log(F.element_at(p, (F.col(label) + 1).cast("int")))
    top = F.array_position(p, F.array_max(p)) - 1
    return df.agg(
        F.count("*").alias("n"),
        (F.sum(weight * loss) / F.sum(weight)).alias("loss"),
        F.avg((top == F.col(label)).cast("double")).alias("top1"),
    )


# --- splits and leakage -----------------------------------------------------

def _bucket(key: Column, seed: int, modulus: int) -> Column:
    """Deterministic pseudo-random bucket of an integer key (fixed linear map)."""
    return (F.pmod(key, F.lit(1000003)) * 7919 + seed * 104729) % modulus


def random_split(samples: DataFrame, key: str, seed: int, tenths: int = 1) -> DataFrame:
    """Seeded hold-out by key: the same rows on every run and any partitioning."""
    mixed = _bucket(F.col(key), seed, 1000003) * 31 % 10
    return samples.withColumn("split", F.when(mixed < tenths, "val").otherwise("train"))


def group_disjoint_split(samples: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Whole groups to one side: exactly floor(share x groups) of them train."""
    groups = samples.select(group).distinct().withColumn("_h", _bucket(F.col(group), seed, 1000003))
    ranked = global_rank(groups, ["_h", group], "_rank")
    limit = ranked.agg(F.floor(F.count("*") * F.lit(share))).scalar()
    side = F.when(F.col("_rank") <= limit, "train").otherwise("test")
    sides = ranked.select(group, side.alias("split"))
    return samples.join(sides, group)


def split_overlap(samples: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups found on both sides; empty for a sound split."""
    return (
        samples.groupBy(group).agg(F.min(split).alias("_a"), F.max(split).alias("_b"))
        .filter("_a <> _b").select(group)
    )


def leaked_keys(train: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """Training rows whose key also occurs in the hold-out."""
    return train.join(holdout.select(key).distinct(), key, "left_semi")


def remove_leaks(train: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    return train.join(holdout.select(key).distinct(), key, "left_anti")


# --- glyph groups -----------------------------------------------------------

def pairwise_upper(samples: DataFrame, group: str, slot: str, vec: str, slots: int = 10) -> DataFrame:
    """(group, i, j, corr) for i < j among the ``slots`` places of a group.

    A group is a fixed set of places; copies of a place collapse to one first, so a group
    never holds more than ``slots`` vectors, whatever its number of rows.
    """
    return _glyph_rows(samples, group, slot, vec, slots).select(
        group, F.explode(_pairs(F.col("_unit"))).alias("p")
    ).select(group, "p.i", "p.j", "p.corr")


def glyph_report(samples: DataFrame, group: str, slot: str, vec: str, slots: int = 10) -> DataFrame:
    """(group, rows, places, outside, copies, conflicting): what the measures of a group rest on.

    ``outside``: rows whose place is NULL or not below ``slots``; ``copies``: further rows of
    a place with equal vectors; ``conflicting``: places that hold different vectors.
    """
    inside = F.coalesce(F.col(slot).between(0, slots - 1), F.lit(False))
    # Rows outside share a NULL place and carry no vector, so they add up before the shuffle.
    slim = samples.select(
        group, F.when(inside, F.col(slot)).alias("_k"), F.when(inside, V.as_doubles(F.col(vec))).alias("_v")
    )
    places = slim.groupBy(group, "_k").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    ).withColumn("_in", F.col("_k").isNotNull()).withColumn("_differ", F.col("_in") & (F.col("_low") != F.col("_high")))
    return places.groupBy(group).agg(
        F.sum("_n").alias("rows"), F.count_if("_in").alias("places"),
        F.coalesce(F.sum(F.when(~F.col("_in"), F.col("_n"))), F.lit(0)).alias("outside"),
        F.coalesce(F.sum(F.when(F.col("_in") & ~F.col("_differ"), F.col("_n") - 1)), F.lit(0)).alias("copies"),
        F.count_if("_differ").alias("conflicting"),
    )


def _glyph_rows(samples: DataFrame, group: str, slot: str, vec: str, slots: int) -> DataFrame:
    one = (
        samples.filter(F.col(slot).between(0, slots - 1))
        .groupBy(group, slot).agg(
            F.min(V.as_doubles(F.col(vec))).alias("_v"), F.max(V.as_doubles(F.col(vec))).alias("_w"),
        )
    )
    stats = let(F.col("_v"), lambda v: F.struct(
        F.array_max(v).alias("top"), V.vector_stats(v)["std"].alias("std"), V.unit_centred(v).alias("u"),
    ))
    prepared = one.select(group, slot, stats.alias("_s"), (F.col("_v") != F.col("_w")).alias("_differ"))
    return prepared.groupBy(group).agg(
        F.count("*").alias("_slots"), F.count_if("_differ").alias("_conflicts"),
        F.min("_s.top").alias("_top"),
        F.min("_s.std").alias("_std"),
        F.array_sort(F.collect_list(F.struct(F.col(slot).alias("k"), F.col("_s.u").alias("u")))).alias("_unit"),
    )


def _pairs(unit: Column) -> Column:
    return F.flatten(F.transform(
        unit,
        lambda a: F.transform(
            F.filter(unit, lambda b: b["k"] > a["k"]),
            lambda b: F.struct(
                a["k"].alias("i"), b["k"].alias("j"),
                total(F.zip_with(a["u"], b["u"], lambda x, y: x * y)).alias("corr"),
            ),
        ),
    ))


def glyph_quality(samples: DataFrame, group: str, slot: str, vec: str, slots: int = 10,
                  blank_max: float = BLANK_MAX) -> DataFrame:
    """(group, max_corr, mean_corr, passed): blank, constant, twin and alike glyphs fail.

    So do groups with a place that holds different vectors; of those the smallest is
    measured. ``glyph_report`` counts them and the rows outside the places.
    """
    rows = _glyph_rows(samples, group, slot, vec, slots).withColumn("_corr", F.transform(_pairs(F.col("_unit")), lambda p: p["corr"]))
    corr = F.col("_corr")
    undefined = F.exists(corr, lambda c: c.isNull())
    highest = F.coalesce(F.array_max(corr), F.lit(1.0))
    middle = F.coalesce(total(corr) / F.nullif(F.size(corr), F.lit(0)), F.lit(1.0))
    return rows.select(
        group, highest.alias("max_corr"), middle.alias("mean_corr"),
        (
            (F.col("_slots") == slots) & (F.col("_conflicts") == 0) & (F.col("_top") >= blank_max) & (F.col("_std") >= CONSTANT_STD)
            & ~undefined & (highest <= TWIN_CORRELATION) & (middle <= ALIKE_CORRELATION)
        ).alias("passed"),
    )


def group_coverage(groups: DataFrame, group: str, allowed: Column, passed: Column, least: int = MIN_GROUPS) -> DataFrame:
    """Groups found, allowed and passed, and whether enough survive. Input: one row per group."""
    n = F.count_if(allowed & passed)
    return groups.agg(
        F.count(group).alias("found"), F.count_if(allowed).alias("allow_listed"), n.alias("passed"),
        (n >= least).alias("sufficient"),
    )


# --- augmentation -----------------------------------------------------------

def _uniform(key: Column, salt: int, seed: int) -> Column:
    """Reproducible number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def augment_vectors(samples: DataFrame, key: str, vec: str, seed: int) -> DataFrame:
    """Noise (p 0.4), brightness shift within 20 (p 0.3), clip, min-max.

    All randomness hashes the key, so a re-run or a retried task gives the same vectors.
    """
    k = F.col(key)

    def gauss(i: Column) -> Column:
        u = lambda salt: F.pmod(F.xxhash64(k, i, F.lit(salt), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return F.sqrt(-2 * F.log(1 - u(1))) * F.cos(2 * 3.141592653589793 * u(2))

    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))
    scale = 5 + 10 * _uniform(k, 3, seed)
    shift = F.floor(_uniform(k, 4, seed) * 41) - 20
    base = V.as_doubles(F.col(vec))
    noisy = F.when(
        _uniform(k, 5, seed) < 0.4,
        let(scale, lambda s: F.transform(base, lambda x, i: clip(x + gauss(i) * s))),
    ).otherwise(base)
    shifted = let(
        F.struct(noisy.alias("v"), shift.alias("d")),
        lambda s: F.when(
            _uniform(k, 6, seed) < 0.3, F.transform(s["v"], lambda x: clip(x + s["d"]))
        ).otherwise(s["v"]),
    )
    return samples.withColumn(vec, V.minmax(shifted))


def dual_eval_tables(samples: DataFrame, key: str, vec: str, seed: int) -> DataFrame:
    """The same rows clean and augmented, told apart by ``variant``."""
    clean = samples.withColumn(vec, V.as_doubles(F.col(vec)))
    return clean.withColumn("variant", F.lit("clean")).unionByName(
        augment_vectors(samples, key, vec, seed).withColumn("variant", F.lit("augmented"))
    )
