"""Ordered operators against plain loops, with one key that owns most rows: W2-W7, K4, K10, A19."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import ordered as O
from gridspark.operators.quantiles import exact_percentiles


@pytest.fixture(scope="module")
def events(spark):
    """(user, sec, id, value): user 0 has two thirds of the rows, times repeat."""
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        user = 0 if i % 3 else rng.randint(1, 40)
        rows.append((user, rng.randint(0, 40000), i, round(rng.random(), 2)))
    df = spark.createDataFrame(rows, "user bigint, sec bigint, id bigint, value double")
    return rows, df.withColumn("ts", F.timestamp_seconds("sec")).cache()


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("gap,bucket", [(60, 600), (1, 100), (5000, 3000), (7, 50000), (900, 60)])
def test_greedy_min_gap(events, gap, bucket):
    rows, df = events
    want = set()
    for user, seq in by_user(rows).items():
        last = None
        for _, sec, i, _ in seq:
            if last is None or sec - last >= gap:
                want.add((user, i))
                last = sec
    got = O.greedy_min_gap(df, "user", "ts", "id", gap, bucket).select("user", "id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_greedy_min_gap_with_starts_broadcast_at_run_time(spark):
    """Many keys: the join with the starts becomes a broadcast, its rows must still meet by bucket."""
    df = spark.range(0, 400000, 1, 12).selectExpr(
        "id % 20000 AS user", "timestamp_seconds(id * 7919 % 400000) AS ts", "id"
    )
    want = {}
    for i in range(400000):
        want.setdefault(i % 20000, []).append(i * 7919 % 400000)
    kept = 0
    for times in want.values():
        last = None
        for t in sorted(times):
            if last is None or t - last >= 50000:
                kept, last = kept + 1, t
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert len(O.greedy_min_gap(df, "user", "ts", "id", 50000).collect()) == kept
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("delay,bucket", [(60, 600), (1000, 60), (3, 7)])
def test_trailing_debounce(events, delay, bucket):
    rows, df = events
    want = {
        r[2] for seq in by_user(rows).values() for k, r in enumerate(seq)
        if k + 1 == len(seq) or seq[k + 1][1] - r[1] > delay
    }
    got = O.trailing_debounce(df, "user", "ts", "id", delay, bucket).select("id").collect()
    assert {r["id"] for r in got} == want and len(got) == len(want)


def test_numbers_and_ranks(events):
    rows, df = events
    slots = df.withColumn("slot", O.time_bucket(F.col("ts"), 500))
    numbered = O.number_rows(slots, ["user"], "slot", ["ts", "id"], "n").collect()
    want = {r[2]: k + 1 for seq in by_user(rows).values() for k, r in enumerate(seq)}
    assert {r["id"]: r["n"] for r in numbered} == want
    ranked = O.global_rank(df.select("value", "id"), [F.desc("value"), F.asc("id")]).collect()
    order = sorted(rows, key=lambda r: (-r[3], r[2]))
    assert {r["id"]: r["rank"] for r in ranked} == {r[2]: k + 1 for k, r in enumerate(order)}


@pytest.mark.parametrize("patience,block", [(3, 4), (10, 7), (200, 64)])
def test_early_stopping(spark, events, patience, block):
    rows, _ = events
    curves, want = [], {}
    for user, seq in by_user(rows).items():
        best, best_epoch, misses, stop, kept = 0.0, 0, 0, None, None
        for e, r in enumerate(seq, 1):
            curves.append((user, e, r[3]))
            if stop is None:
                if r[3] > best:
                    best, best_epoch, misses = r[3], e, 0
                else:
                    misses += 1
                    if misses >= patience:
                        stop = e
        want[user] = (len(seq), stop or len(seq), stop is not None, best_epoch, best)
    df = spark.createDataFrame(curves, "run bigint, epoch bigint, acc double")
    got = O.early_stopping(df, "run", "epoch", "acc", patience, block).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_peaks(spark):
    def run(profile, gap):
        df = spark.createDataFrame([(profile,)], "v array<double>")
        peaks = O.local_peaks(F.col("v"))
        kept = O.spaced_peaks(peaks, gap)
        return df.select(peaks.alias("p"), kept.alias("k"), O.spacing_regularity(kept, 200).alias("s"),
                         O.nearest_peak(kept, F.lit(66.7)).alias("n")).first()

    flat = run([0.0] * 200, 13)
    assert flat.p == [] and flat.s == 0.0 and flat.n is None
    lines = [0.0] * 200
    for i in range(10):
        lines[min(2 + 21 * i, 198)] = 1.0
    r = run(lines, 13)
    assert r.p == [2 + 21 * i for i in range(10)] == r.k and r.n == 65
    assert np.isclose(r.s, 1.0 * 1.0 * (189 / 200))
    plateau = [0.0, 1.0, 1.0, 0.0, 0.2, 0.0, 1.0, 0.0]
    assert run(plateau, 3).p == [1, 2, 6] and run(plateau, 3).k == [1, 6]
    assert run(plateau, 3).n is None and run([1.0, 0.0], 3).s == 0.0


@pytest.mark.parametrize("per_octave", [1, 7, 256])
def test_percentiles(spark, per_octave):
    rng = np.random.default_rng(4)
    rows = [(0, float(v)) for v in rng.lognormal(size=700)] + [(0, 1.5)] * 500 + [(1, 3.0)] + [(2, float(v)) for v in rng.normal(size=11)]
    df = spark.createDataFrame(rows, "g int, v double")
    ps = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], F.col("v"), ps, per_octave).collect()}
    stats = exact_percentiles(df, ["g"], F.col("v"), ps, per_octave, stats=True).filter("g = 2").first()
    third = [v for k, v in rows if k == 2]
    assert (stats["n"], stats["min"], stats["max"]) == (11, min(third), max(third))
    assert np.isclose(stats["mean"], np.mean(third))
    for g in range(3):
        values = [v for k, v in rows if k == g]
        for name, p in ps.items():
            assert np.isclose(got[g][name], np.percentile(values, 100 * p))
    whole = exact_percentiles(df, [], F.col("v"), ps, per_octave).first()
    assert np.isclose(whole["p50"], np.median([v for _, v in rows]))
