"""Reports over experiment and latency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.binding import literal_rows
from gridspark.operators.ordered import global_rank
from gridspark.operators.quantiles import exact_percentiles


def baseline_anchor(runs: DataFrame, name: str, baseline, metrics: list[str]) -> DataFrame:
    """Attach the metrics of the named run to every run; NULL when it is absent.

    The baseline is one aggregated row, used as a scalar subquery: nothing is joined.
    """
    cols = F.struct(*[F.col(m).alias(f"base_{m}") for m in metrics])
    anchor = runs.filter(F.col(name) == baseline).agg(F.min_by(cols, F.col(name))).scalar()
    return runs.withColumn("_b", anchor).select(*runs.columns, "_b.*")


def ranked_table(runs: DataFrame, metric: str, name: str) -> DataFrame:
    """Rank 1..n by metric, highest first, ties by name."""
    return global_rank(runs, [F.desc(metric), F.asc(name)])


def best_per_bucket(runs: DataFrame, bucket: str, metric: str, name: str, keep: list[str]) -> DataFrame:
    row = F.struct(F.col(name), F.col(metric), *[F.col(k) for k in keep])
    return runs.groupBy(bucket).agg(
        F.min_by(row, F.struct(-F.col(metric), F.col(name))).alias("_r")
    ).select(bucket, "_r.*")


def largest_gap(runs: DataFrame, a: str, b: str, name: str, n: int = 5) -> DataFrame:
    return runs.withColumn("gap", F.col(a) - F.col(b)).orderBy(F.desc("gap"), name).limit(n)


def gap_findings(runs: DataFrame, depth: str, synth: str, real: str, name: str) -> DataFrame:
    """Mean gap and the best shallow (depth 2) and deep (3 and more) runs, in one pass."""
    def best(group: Column) -> Column:
        return F.min_by(
            F.struct(F.col(name).alias("n"), F.col(real).alias("v")),
            F.when(group, F.struct(-F.col(real), F.col(name))),
        )

    shallow, deep = F.col(depth) == 2, F.col(depth) >= 3
    return runs.agg(
        F.count("*").alias("runs"),
        F.avg(synth).alias("synth_avg"), F.avg(real).alias("real_avg"),
        best(shallow).alias("s"), best(deep).alias("d"),
    ).select(
        "runs", "synth_avg", "real_avg", (F.col("synth_avg") - F.col("real_avg")).alias("gap"),
        F.col("s.n").alias("best_shallow"), F.col("s.v").alias("best_shallow_real"),
        F.col("d.n").alias("best_deep"), F.col("d.v").alias("best_deep_real"),
    )


def axis_sweep(runs: DataFrame, axis: str, values: list, fixed: dict, metric: str, name: str) -> DataFrame:
    """Hold the other axes, list one; a value without a run is reported as pending."""
    held = runs
    for column, value in fixed.items():
        held = held.filter(F.col(column) == value)
    first = held.groupBy(axis).agg(F.min_by(F.struct(F.col(name), F.col(metric)), F.col(name)).alias("_r"))
    wanted = literal_rows(runs.sparkSession, axis, values)
    return wanted.join(first, axis, "left").select(
        axis, F.when(F.col("_r").isNull(), "pending").otherwise("done").alias("state"),
        F.coalesce(F.col(f"_r.{name}").cast("string"), F.lit("")).alias(name),
        F.coalesce(F.col(f"_r.{metric}").cast("double"), F.lit(0.0)).alias(metric),
    )


def gap_decomposition(stages: DataFrame, order: str, metric: str) -> DataFrame:
    """Gain of each configuration over the previous one, and what is left to 100 %.

    One row per configuration of a study: the window is over the study's few rows.
    """
    w = Window.orderBy(order)
    last = F.lead(metric).over(w).isNull()
    return stages.select(
        order, metric,
        F.coalesce(F.col(metric) - F.lag(metric).over(w), F.lit(0.0)).alias("gain"),
        F.when(last, 1 - F.col(metric)).otherwise(F.lit(0.0)).alias("remainder"),
    )


def config_grid(runs: DataFrame, axes: list[str], pattern: str) -> DataFrame:
    """Every combination of the axis values seen in a table, with a generated name.

    Axes are the settings of a study: few values each, gathered as sets in one aggregate.
    """
    sets = runs.agg(*[F.array_sort(F.collect_set(a)).alias(a) for a in axes])
    for axis in axes:
        sets = sets.withColumn(axis, F.explode(axis))
    return sets.select(F.format_string(pattern, *axes).alias("name"), *axes)


# --- latency ----------------------------------------------------------------

LATENCY_POINTS = {"median_ms": 0.5, "p95_ms": 0.95}


def latency_summary(runs: DataFrame, groups: list[str], ms: str) -> DataFrame:
    """min, median, mean, p95, max to four decimals, per group of any size, in one pass."""
    points = exact_percentiles(runs, groups, F.col(ms), LATENCY_POINTS, stats=True)
    r4 = lambda c: F.bround(c, 4).alias(c if c.endswith("_ms") else f"{c}_ms")
    return points.select(
        *groups, F.col("n").alias("runs"), *[r4(c) for c in ("min", "mean", "max", *LATENCY_POINTS)]
    )


def latency_by_puzzle(runs: DataFrame, key: str, ms: str, ok: str) -> DataFrame:
    """(key, runs, median_ms, success): success when every run of the key succeeded."""
    flags = runs.groupBy(key).agg(F.count("*").alias("runs"), F.bool_and(ok).alias("success"))
    points = exact_percentiles(runs, [key], F.col(ms), {"median_ms": 0.5})
    return flags.join(points, key).withColumn("median_ms", F.bround("median_ms", 4))


def latency_frames(runs: DataFrame, key: str, ms: str, ok: str) -> DataFrame:
    """The latency summary over all runs and over the keys that never failed."""
    flags = runs.groupBy(key).agg(F.bool_and(ok).alias("_success"))
    frames = F.explode(
        F.when(F.col("_success"), F.array(F.lit("all"), F.lit("solvable"))).otherwise(F.array(F.lit("all")))
    )
    return latency_summary(runs.join(flags, key).withColumn("frame", frames), ["frame"], ms)
