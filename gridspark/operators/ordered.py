"""Order-sensitive operators over long tables.

A window over one key puts that key's rows in one task. Here every key is cut into buckets
that follow its order (a time slot, a block of epochs). Windows run inside a bucket and
one summary row per bucket carries the state across, so a key with a third of all rows is
spread over its buckets and the result is the same as the plain window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.binding import let
from gridspark.functions.vectors import vector_stats
from gridspark.session import materialise


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000))


def number_rows(df: DataFrame, keys: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """1..n per key in order, as row_number() over the whole key would give."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
        .select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        df.withColumn("_rank", F.row_number().over(inner))
        .join(offsets, keys + [bucket])
        .withColumn(out, F.col("_rank") + F.col("_offset"))
        .drop("_rank", "_offset")
    )


def next_value(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """lead(value) per key; ``value`` must not decrease along the order."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(bucket)
    heads = (
        df.groupBy(*keys, bucket).agg(F.min(value).alias("_head"))
        .select(*keys, bucket, F.lead("_head").over(across).alias("_next_head"))
    )
    return (
        df.withColumn("_lead", F.lead(value).over(inner))
        .join(heads, keys + [bucket])
        .withColumn(out, F.coalesce("_lead", "_next_head"))
        .drop("_lead", "_next_head")
    )


def earlier_max(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """max(value) over all earlier rows of the key; NULL on the first."""
    inner = (
        Window.partitionBy(*keys, bucket).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        df.groupBy(*keys, bucket).agg(F.max(value).alias("_top"))
        .select(*keys, bucket, F.max("_top").over(before).alias("_before"))
    )
    return (
        df.withColumn("_inner", F.max(value).over(inner))
        .join(tops, keys + [bucket])
        .withColumn(out, F.greatest("_inner", "_before"))  # greatest() skips NULLs
        .drop("_inner", "_before")
    )


def global_rank(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """1..n over the whole table without a single-partition window.

    A range sort balances the partitions on all order columns, ties included; positions
    come from the partition sizes. The sorted table is checkpointed so that sizes and
    rows are of one and the same partitioning.
    """
    ordered = materialise(df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright("_pos", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    # One row per partition of the sort, so the broadcast does not grow with the rows.
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_part", "_pos", "_offset")
    )


# --- debounce ---------------------------------------------------------------

def trailing_debounce(df: DataFrame, key: str, ts: str, tie: str, delay_seconds: int, bucket_seconds: int = 600) -> DataFrame:
    """Keep an event only if the key has none within ``delay_seconds`` after it."""
    stamped = df.withColumn("_bucket", time_bucket(F.col(ts), bucket_seconds))
    led = next_value(stamped, [key], "_bucket", [ts, tie], ts, "_next")
    quiet = F.col("_next").isNull() | (
        F.unix_micros("_next") - F.unix_micros(ts) > delay_seconds * 1_000_000
    )
    return led.filter(quiet).drop("_next", "_bucket")


def _segments(keys: list[str], per_group):
    """mapInPandas body over rows sorted by ``keys``: calls ``per_group`` with whole groups.

    One Arrow batch holds many groups, so the cost per group is a slice, not a Python call
    across the JVM border. A group cut by a batch edge is held until its end arrives.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if len(batch) == 0:
                continue
            ends = (batch[keys] != batch[keys].shift(-1)).any(axis=1).to_numpy()
            ends[-1] = False  # whether the last group ends here shows in the next batch
            if held and (held[-1][keys].iloc[-1] != batch[keys].iloc[0]).any():
                yield per_group(pd.concat(held, ignore_index=True))
                held = []
            cut = np.flatnonzero(ends)
            if len(cut):
                yield per_group(pd.concat(held + [batch.iloc[: cut[-1] + 1]], ignore_index=True))
                held = [batch.iloc[cut[-1] + 1 :]]
            else:
                held.append(batch)
        if held:
            yield per_group(pd.concat(held, ignore_index=True))

    return run


def _bounds(pdf: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
    return list(zip(starts, np.append(starts[1:], len(pdf))))


def _chain(times: np.ndarray, gap: int) -> np.ndarray:
    """Index of the row accepted next after each row of a sorted array (its length if none)."""
    return np.searchsorted(times, times + gap, side="left")


def _exits(gap: int, key: str):
    """Per bucket: the row accepted last, for every row that may be accepted first.

    Whatever was accepted before the bucket lies before its first row, so the first
    accepted row is among those up to one gap after it. Entries that lead to the same exit
    are kept once, by the latest of them.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, entries, leaves = [], [], []
        all_times = pdf["_t"].to_numpy()
        for start, end in _bounds(pdf, [key, "_bucket"]):
            times = all_times[start:end]
            after = _chain(times, gap)
            last = np.where(after < len(times), after, np.arange(len(times)))
            while not np.array_equal(last, last[last]):  # pointer doubling
                last = last[last]
            reach = min(int(np.searchsorted(times, times[0] + gap, side="left")) + 1, len(times))
            entry, leave = times[:reach], times[last[:reach]]
            final = np.append(leave[1:] != leave[:-1], True)
            heads.append(start)
            entries.append(entry[final])
            leaves.append(leave[final])
        out = pdf.iloc[heads][[key, "_bucket"]]
        return out.assign(_entries=entries, _leaves=leaves)

    return run


def _carry(gap: int, key: str):
    """Walk the bucket summaries of each key in order; the state is one timestamp."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before = []
        entries, leaves = pdf["_entries"].to_numpy(), pdf["_leaves"].to_numpy()
        for start, end in _bounds(pdf, [key]):
            last = None
            for i in range(start, end):
                before.append(last)
                at = 0 if last is None else int(np.searchsorted(entries[i], last + gap, side="left"))
                if at < len(entries[i]):
                    last = int(leaves[i][at])
        return pdf[[key, "_bucket"]].assign(_last=pd.array(before, dtype="Int64"))

    return run


def _accepted(gap: int, key: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep = []
        all_times, before = pdf["_t"].to_numpy(), pdf["_last"].to_numpy()
        for start, end in _bounds(pdf, [key, "_bucket"]):
            times = all_times[start:end]
            after = _chain(times, gap)
            last = before[start]
            at = 0 if pd.isna(last) else int(np.searchsorted(times, int(last) + gap, side="left"))
            while at < len(times):
                keep.append(start + at)
                at = after[at]
        return pdf.iloc[keep][[key, "_t", "_tie"]]

    return run


def greedy_min_gap(
    df: DataFrame, key: str, ts: str, tie: str, gap_seconds: float, bucket_seconds: float | None = None
) -> DataFrame:
    """(key, ts, tie): accept in order every row at least the gap after the last accepted one.

    The accepted row depends on all rows before it, so each bucket is first reduced to its
    entry -> exit map; a walk over the maps fixes where every bucket starts, and the buckets
    are then filtered independently. Of rows with equal time only the first can be accepted,
    so a bucket of 512 gaps (the default) holds at most that many microseconds of rows.
    """
    gap = int(gap_seconds * 1_000_000)
    width = int((bucket_seconds or 512 * gap_seconds) * 1_000_000)
    kind = df.schema[key].dataType.simpleString()
    tie_kind = df.schema[tie].dataType.simpleString()
    rows = (
        df.select(key, F.unix_micros(ts).alias("_t"), F.col(tie).alias("_tie"))
        .groupBy(key, "_t").agg(F.min("_tie").alias("_tie"))
        .withColumn("_bucket", F.floor(F.col("_t") / width))
    )
    both = [key, "_bucket"]
    # A given number is kept as it is; by columns alone AQE would merge these CPU-bound tasks by size.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summaries = (
        rows.select(*both, "_t").repartition(tasks, *both).sortWithinPartitions(*both, "_t")
        .mapInPandas(
            _segments(both, _exits(gap, key)),
            f"{key} {kind}, _bucket bigint, _entries array<bigint>, _leaves array<bigint>",
        )
    )
    starts = (
        summaries.repartition(tasks, key).sortWithinPartitions(*both)
        .mapInPandas(_segments([key], _carry(gap, key)), f"{key} {kind}, _bucket bigint, _last bigint")
    )
    # Dealt by a hash of the keys: Spark drops a repartition that repeats the join's own keys, and
    # the join, broadcast at run time, then leaves the rows of a bucket in several tasks.
    kept = (
        rows.join(starts, both).repartition(tasks, F.xxhash64(*both)).sortWithinPartitions(*both, "_t")
        .mapInPandas(
            _segments(both, _accepted(gap, key)), f"{key} {kind}, _t bigint, _tie {tie_kind}"
        )
    )
    return kept.select(key, F.timestamp_micros("_t").alias(ts), F.col("_tie").alias(tie))


# --- training curves --------------------------------------------------------

def early_stopping(
    df: DataFrame, run: str, epoch: str, metric: str, patience: int, block: int = 4096
) -> DataFrame:
    """(run, epochs, stop_epoch, stopped_early, best_epoch, best_value).

    A strict new best resets the miss counter; the run stops at the first epoch with
    ``patience`` misses in a row. Only epochs that set a record matter, so the second pass
    looks at those alone.
    """
    e, m = F.col("_e"), F.col("_m")
    curve = df.select(run, F.col(epoch).cast("bigint").alias("_e"), F.col(metric).alias("_m"))
    blocks = curve.withColumn("_block", F.floor((e - 1) / block))
    marked = earlier_max(blocks, [run], "_block", ["_e"], "_m", "_best")
    # Records are few in practice; they are read several times below.
    records = materialise(marked.filter(m > F.coalesce("_best", F.lit(0.0))).drop("_best"))
    spaced = next_value(records, [run], "_block", ["_e"], "_e", "_next")
    stalls = spaced.groupBy(run).agg(
        F.min("_e").alias("_first"), F.max("_e").alias("_last"),
        F.min(F.when(F.col("_next") - 1 - e >= patience, e + patience)).alias("_between"),
    )
    lengths = curve.groupBy(run).agg(F.max("_e").alias("epochs"))
    # A stall may precede the first record (best 0 at epoch 0), lie between two, or follow the last.
    before = F.when(F.coalesce(F.col("_first") - 1, F.col("epochs")) >= patience, F.lit(patience))
    after = F.when(F.col("epochs") - F.col("_last") >= patience, F.col("_last") + patience)
    stop = F.least(before, "_between", after)  # least() skips NULLs
    bounded = lengths.join(stalls, run, "left").select(
        run, "epochs", F.coalesce(stop, "epochs").cast("bigint").alias("stop_epoch"),
        stop.isNotNull().alias("stopped_early"),
    )
    kept = F.when(e <= F.col("stop_epoch"), F.struct(e.alias("e"), m.alias("v")))
    fixed = ["epochs", "stop_epoch", "stopped_early"]
    return (
        bounded.join(records.drop("_block"), run, "left")
        .groupBy(run).agg(*[F.first(c).alias(c) for c in fixed], F.max(kept).alias("_b"))
        .select(
            run, *fixed, F.coalesce("_b.e", F.lit(0).cast("bigint")).alias("best_epoch"),
            F.coalesce("_b.v", F.lit(0.0)).alias("best_value"),
        )
    )


# --- bounded 1-D profiles ---------------------------------------------------

def local_peaks(profile: Column, share: float = 0.3) -> Column:
    """Positions of interior values above a share of the maximum and not below a neighbour."""
    def find(s: Column) -> Column:
        at = F.transform(
            s["v"],
            lambda x, i: F.when(
                (i > 0) & (i < F.size(s["v"]) - 1)
                & (x > s["top"] * share)
                & (x >= F.get(s["v"], i - 1))
                & (x >= F.get(s["v"], i + 1)),
                i,
            ),
        )
        return F.filter(at, lambda i: i.isNotNull())

    found = let(F.struct(profile.alias("v"), F.array_max(profile).alias("top")), find)
    return F.when(F.array_max(profile) == 0, F.expr("CAST(array() AS array<int>)")).otherwise(found)


def spaced_peaks(peaks: Column, gap: int) -> Column:
    """Accept positions in order when at least ``gap`` after the last accepted one."""
    return F.aggregate(
        peaks,
        F.expr("CAST(array() AS array<int>)"),
        lambda kept, p: F.when(
            (F.size(kept) == 0) | (p - F.try_element_at(kept, F.lit(-1)) >= gap),
            F.array_append(kept, p),
        ).otherwise(kept),
    )


def spacing_regularity(peaks: Column, size: int, expected_count: int = 10, parts: int = 9) -> Column:
    """Line count accuracy x spacing regularity x coverage; 0 with fewer than two peaks."""
    def score(p: Column) -> Column:
        gaps = F.zip_with(
            F.slice(p, F.lit(2), F.size(p) - 1), F.slice(p, F.lit(1), F.size(p) - 1),
            lambda b, a: (b - a).cast("double"),
        )
        count = F.greatest(F.lit(0.0), 1 - F.abs(F.size(p) - expected_count) / expected_count)
        regular = F.greatest(F.lit(0.0), 1 - vector_stats(gaps)["std"] / F.lit(size / parts))
        coverage = (F.element_at(p, -1) - F.element_at(p, 1)) / F.lit(size)
        return F.when(F.size(p) < 2, F.lit(0.0)).otherwise(count * regular * coverage)

    return let(peaks, score)


def nearest_peak(peaks: Column, target: Column, least: int = 4) -> Column:
    """Peak closest to the target, the earlier one on a tie; NULL with too few peaks."""
    ranked = F.transform(peaks, lambda p: F.struct(F.abs(p - target).alias("d"), p.alias("p")))
    return F.when(F.size(peaks) >= least, F.array_min(ranked)["p"])
