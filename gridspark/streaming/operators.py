"""Structured Streaming operators.

Stateless parts reuse the batch operators. Keyed state lives in Spark's state store; custom
state (debounce, early stop) is a StatefulProcessor with one small value per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from gridspark.functions import cells, puzzles

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The custom processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # Sessions of one key are merged inside each task before the shuffle.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


# --- sinks ------------------------------------------------------------------

def append_log(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: one folder per batch. Replaying a batch rewrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_by_key(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: Column | None = None) -> DataFrame:
    """The table an update log stands for: per key the last row by ``order``, then by batch.

    Without an order the last batch wins. With one, a late event of a later batch replaces nothing newer.
    """
    log = spark.read.schema(schema).parquet(path)
    rest = F.struct(*[c for c in schema.fieldNames() if c not in keys])
    log = log if "batch" in log.columns else log.withColumn("batch", F.lit(0))
    rank = F.col("batch") if order is None else F.struct(order, "batch")
    return log.groupBy(*keys).agg(F.max_by(rest, rank).alias("_r")).select(*keys, "_r.*")


def upsert_log(path: str, key: str, order: Column) -> Callable[[DataFrame, int], None]:
    """Like ``append_log`` with one row per key and batch: the last by ``order``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        row = F.struct(*[c for c in batch.columns if c != key])
        last = batch.groupBy(key).agg(F.max_by(row, order).alias("_r")).select(key, "_r.*")
        append_log(path)(last, batch_id)

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, then stop."""
    query = (
        stream.writeStream.foreachBatch(sink).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


# --- aggregates -------------------------------------------------------------

def stream_score(scored: DataFrame, source: str) -> DataFrame:
    """Running cell counts per source; rates follow from them at read time."""
    right, filled, read = F.col("correct"), F.col("filled"), F.col("predicted") != 0
    return scored.groupBy(source).agg(
        F.count("*").alias("cells"), F.count_if(filled).alias("filled"),
        F.count_if(right & filled).alias("filled_correct"), F.count_if(right & ~filled).alias("empty_correct"),
        F.count_if(filled & ~read).alias("missed"), F.count_if(filled & read & ~right).alias("wrong_digit"),
        F.count_if(~filled & read).alias("hallucinated"),
    )


def windowed_metrics(events: DataFrame, ts: str, ms: str, ok: Column, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, success and latency per tumbling or sliding window; later rows are dropped."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(frame.alias("w")).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("succeeded"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"),
    ).select(F.col("w.start").alias("start"), "n", "succeeded", "total_ms", "max_ms")


# Sketches choose at random: this size is expected to be off by well below SKETCH_ERROR in rank, at any number of
# values, but has no hard bound. Up to about this many values they are exact.
SKETCH_SIZE = 800
SKETCH_ERROR = 0.01


def windowed_sketches(events: DataFrame, ts: str, ms: str, window: str, late: str = "1 hour", size: int = SKETCH_SIZE) -> DataFrame:
    """(start, n, low, high, sketch) per tumbling window: a mergeable quantile sketch (KLL) of the values.

    State and rows hold some kilobytes a window, however many values it saw. NULL and NaN
    are counted in none of the columns; a window without other values does not appear.
    """
    known = events.withWatermark(ts, late).filter(F.col(ms).isNotNull() & ~F.isnan(ms))
    value = F.col(ms).cast("double")
    return known.groupBy(F.window(ts, window).alias("w")).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.kll_sketch_agg_double(value, size).alias("sketch"),
    ).select(F.col("w.start").alias("start"), "n", "low", "high", "sketch")


def merged_sketches(panes: DataFrame, window: str, slide: str | None = None, *groups: str) -> DataFrame:
    """Wider or sliding windows from the sketches of their panes, without the values.

    The panes' length has to divide the slide, so that no pane crosses the border of a window.
    """
    frame = F.window("start", window, slide) if slide else F.window("start", window)
    return panes.groupBy(*groups, frame.alias("w")).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    ).select(*groups, F.col("w.start").alias("start"), "n", "low", "high", "sketch")


def sketch_percentiles(sketches: DataFrame, points: dict[str, float], sketch: str = "sketch") -> DataFrame:
    """Named quantiles of each sketch; the sketch itself goes."""
    return sketches.withColumns(
        {name: F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for name, q in points.items()}
    ).drop(sketch)


def session_activity(events: DataFrame, user: str, ts: str, gap: str, late: str) -> DataFrame:
    """One row per user session, emitted once the watermark has passed its end."""
    return events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("s")).agg(
        F.count("*").alias("events")
    ).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


# --- stateless and keyed ----------------------------------------------------

def stream_validate(puzzles_df: DataFrame, grid: str) -> DataFrame:
    """Tag arriving 9x9 grids: ``status`` is ok, malformed or conflict. No shuffle, no state."""
    error = cells.grid_error(F.col(grid))
    valid = puzzles.is_valid_grid(F.flatten(F.col(grid)))
    status = F.when(F.col("error").isNotNull(), "malformed").when(~valid, "conflict").otherwise("ok")
    return puzzles_df.withColumn("error", error).withColumn("status", status)


def stream_dedup(df: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """First occurrence of each key within the watermark delay.

    Copies collapse inside each Arrow batch first, so a key that makes up a third of the
    rows sends few of them through the shuffle. The earliest copy is the one kept.
    """
    def first_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(ts, kind="stable").drop_duplicates(key)

    thinned = df.mapInPandas(first_copies, df.schema)
    return thinned.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


# --- custom state -----------------------------------------------------------

class _Debounce(StatefulProcessor):
    """State per key: time of the last accepted row."""

    def __init__(self, key: str, ts: str, tie: str, gap_seconds: float):
        self.key, self.ts, self.tie = key, ts, tie
        self.gap = pd.Timedelta(seconds=gap_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([self.ts, self.tie])
        last = pd.Timestamp(self.last.get()[0], unit="us") if self.last.exists() else None
        keep = []
        for i, t in enumerate(pdf[self.ts]):
            if last is None or t - last >= self.gap:
                keep.append(i)
                last = t
        if keep:
            self.last.update((last.value // 1000,))
        yield pdf.iloc[keep][[self.key, self.ts, self.tie]]

    def close(self) -> None:
        pass


def stream_debounce(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: float) -> DataFrame:
    """Leading debounce across micro-batches: same rows as the batch operator."""
    fields = {f.name: f for f in events.schema}
    out = StructType([fields[c] for c in (key, ts, tie)])
    return events.select(key, ts, tie).groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Debounce(key, ts, tie, gap_seconds), outputStructType=out,
        outputMode="Append", timeMode="None",
    )


class _EarlyStop(StatefulProcessor):
    """State per run: epochs seen, best value, its epoch, misses, stopped."""

    def __init__(self, run: str, order: list[str], metric: str, patience: int):
        self.run, self.order, self.metric, self.patience = run, order, metric, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", StructType([
            StructField("epoch", LongType()), StructField("best", DoubleType()),
            StructField("best_epoch", LongType()), StructField("misses", LongType()),
            StructField("stopped", BooleanType()),
        ]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        epoch, best, best_epoch, misses, stopped = self.state.get() if self.state.exists() else (0, 0.0, 0, 0, False)
        out = []
        if not stopped:
            pdf = pd.concat(list(rows)).sort_values(self.order)
            for value in pdf[self.metric]:
                epoch += 1
                if value > best:
                    best, best_epoch, misses = float(value), epoch, 0
                else:
                    misses += 1
                if misses >= self.patience:
                    stopped = True
                    out.append((key[0], epoch, best_epoch, best))
                    break
            self.state.update((epoch, best, best_epoch, misses, stopped))
        yield pd.DataFrame(out, columns=[self.run, "stop_epoch", "best_epoch", "best_value"])

    def close(self) -> None:
        pass


def stream_early_stop(epochs: DataFrame, run: str, order: list[str], metric: str, patience: int) -> DataFrame:
    """One row per run at the moment its patience is used up."""
    kind = epochs.schema[run]
    out = StructType([
        kind, StructField("stop_epoch", LongType()), StructField("best_epoch", LongType()), StructField("best_value", DoubleType()),
    ])
    return epochs.select(run, *order, metric).groupBy(run).transformWithStateInPandas(
        statefulProcessor=_EarlyStop(run, order, metric, patience), outputStructType=out,
        outputMode="Append", timeMode="None",
    )
