"""Keyed streams in order of time: rows wait until the watermark has passed them.

A micro-batch brings rows in any order, and a row may come a batch after one that is
younger. Whatever depends on order is therefore decided only for times no further row
can have. Results equal those of the batch operator up to the watermark, however the
rows were cut into files; state of a key that can no longer matter goes away by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

MICROS = 1_000_000


class InOrder(StatefulProcessor):
    """Base of processors that see the rows of a key in order of ``_us``, then of the further columns.

    State per key: the rows that wait, as one array per column; what ``fold`` keeps; the
    time of the timer. A subclass gives

    * ``fold(key, state, rows)``: new state and output rows, for rows the watermark has passed;
    * ``until(state)``: the time from which the state has no influence on later rows;
    * ``end(key, state)``: output rows when that time has come.
    """

    def __init__(self, rows: StructType, kept: StructType, out: list[str]):
        self.rows, self.kept, self.out = rows, kept, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", StructType([StructField(f.name, ArrayType(f.dataType)) for f in self.rows]))
        self.state = handle.getValueState("kept", self.kept)
        self.timer = handle.getValueState("timer", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.rows.fieldNames()
        waiting = self._waiting()
        for frame in rows:
            own = frame.iloc[:, -len(names):].set_axis(names, axis=1)  # by place: Spark renames some columns on the way
            waiting = pd.concat([waiting, own], ignore_index=True) if len(waiting) else own
        yield from self._settle(key, waiting.sort_values(names), timerValues, self.timer.get()[0] if self.timer.exists() else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, self._waiting(), timerValues, None)

    def close(self) -> None:
        pass

    def _waiting(self) -> pd.DataFrame:
        names = self.rows.fieldNames()
        held = self.waiting.get() if self.waiting.exists() else [[] for _ in names]
        return pd.DataFrame({name: list(column) for name, column in zip(names, held)})

    def _settle(self, key, waiting: pd.DataFrame, timers, timer: int | None) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        passed = (waiting["_us"] <= now).to_numpy(bool)
        state, out = self.fold(key, self.state.get() if self.state.exists() else None, waiting[passed])
        left = waiting[~passed]
        if state is not None and self.until(state) <= now:
            out, state = out + self.end(key, state), None
        due = [int(left["_us"].iloc[0])] if len(left) else []
        due += [] if state is None else [self.until(state)]
        self._store(self.state, state)
        self._store(self.waiting, tuple(left[c].tolist() for c in left) if len(left) else None)
        wake = -(-min(due) // 1000) if due else None
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        self._store(self.timer, None if wake is None else (wake,))
        if out:
            yield pd.DataFrame(out, columns=self.out)

    @staticmethod
    def _store(cell, value) -> None:
        if value is not None:
            cell.update(value)
        elif cell.exists():
            cell.clear()


class Debounce(InOrder):
    """Accepts a row at least the gap after the last accepted one, whose time is the state."""

    def __init__(self, rows: StructType, out: list[str], gap: int):
        super().__init__(rows, StructType([StructField("last", LongType())]), out)
        self.gap = gap

    def fold(self, key, state, rows):
        times, ties = rows.iloc[:, 0].to_numpy(np.int64), rows.iloc[:, 1].tolist()
        after = np.searchsorted(times, times + self.gap, side="left")
        at = 0 if state is None else int(np.searchsorted(times, state[0] + self.gap, side="left"))
        out = []
        while at < len(times):
            out.append((key[0], int(times[at]), ties[at]))
            at = int(after[at])
        return ((out[-1][1],) if out else state), out

    def until(self, state) -> int:
        return state[0] + self.gap

    def end(self, key, state):
        return []


class Curves(InOrder):
    """Early stopping; a run that is quiet for too long is over, a later row begins another curve."""

    KEPT = StructType([
        StructField("start", LongType()), StructField("last", LongType()), StructField("epoch", LongType()),
        StructField("best", DoubleType()), StructField("best_epoch", LongType()), StructField("stopped", BooleanType()),
    ])

    def __init__(self, rows: StructType, out: list[str], patience: int, quiet: int):
        super().__init__(rows, self.KEPT, out)
        self.patience, self.quiet = patience, quiet

    def fold(self, key, state, rows):
        out = []
        for us, value in zip(rows.iloc[:, 0].tolist(), rows.iloc[:, -1].tolist()):
            if state is not None and us - state[1] > self.quiet:
                out += self.end(key, state)
                state = None
            start, _, epoch, best, best_epoch, stopped = state or (us, us, 0, 0.0, 0, False)
            if not stopped:
                epoch += 1
                if value is not None and value > best:  # a missing value, None or NaN, is a miss
                    best, best_epoch = float(value), epoch
                if epoch - best_epoch >= self.patience:
                    stopped = True
                    out.append((key[0], start, epoch, True, best_epoch, best))
            state = (start, us, epoch, best, best_epoch, stopped)
        return state, out

    def until(self, state) -> int:
        return state[1] + self.quiet

    def end(self, key, state):
        start, _, epoch, best, best_epoch, stopped = state
        return [] if stopped else [(key[0], start, epoch, False, best_epoch, best)]


def _timed(df: DataFrame, key: str, ts: str, late: str, *rest: str) -> DataFrame:
    """Rows with a time, under a watermark: key, time, then what a processor sees of a row."""
    return df.withWatermark(ts, late).filter(F.col(ts).isNotNull()).select(key, ts, F.unix_micros(ts).alias("_us"), *rest)


def _run(df: DataFrame, key: str, processor: InOrder, out: StructType) -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime",
    )


def debounce_in_order(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: float, late: str) -> DataFrame:
    """(key, ts, tie): leading debounce of all rows up to the watermark, as ``greedy_min_gap`` accepts them.

    Rows within ``late`` of the newest may come in any order; older ones are dropped. A key
    holds its rows within that delay, and one time until the gap is over. Rows without a
    time are left out; of equal times the smallest tie can be accepted.
    """
    kinds = {f.name: f.dataType for f in events.schema}
    rows = StructType([StructField("_us", LongType()), StructField(tie, kinds[tie])])
    out = StructType([StructField(key, kinds[key]), StructField("_us", LongType()), StructField(tie, kinds[tie])])
    processor = Debounce(rows, out.fieldNames(), int(gap_seconds * MICROS))
    kept = _run(_timed(events, key, ts, late, tie), key, processor, out)
    return kept.select(key, F.timestamp_micros("_us").alias(ts), tie)


def curves_in_order(epochs: DataFrame, run: str, ts: str, tie: str, metric: str, patience: int, quiet_seconds: float, late: str) -> DataFrame:
    """(run, start, stop_epoch, stopped_early, best_epoch, best_value): one row per finished curve.

    A curve ends early once its patience is used up, or when its run has been quiet for
    longer than ``quiet_seconds``; then its state goes. A missing value is a miss.
    """
    kinds = {f.name: f.dataType for f in epochs.schema}
    rows = StructType([StructField("_us", LongType()), StructField(tie, kinds[tie]), StructField("_value", DoubleType())])
    out = StructType([
        StructField(run, kinds[run]), StructField("_start", LongType()), StructField("stop_epoch", LongType()),
        StructField("stopped_early", BooleanType()), StructField("best_epoch", LongType()), StructField("best_value", DoubleType()),
    ])
    processor = Curves(rows, out.fieldNames(), patience, int(quiet_seconds * MICROS))
    timed = _timed(epochs.withColumn("_value", F.col(metric).cast("double")), run, ts, late, tie, "_value")
    done = _run(timed, run, processor, out)
    return done.select(run, F.timestamp_micros("_start").alias("start"), *out.fieldNames()[2:])
