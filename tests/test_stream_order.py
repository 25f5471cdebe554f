"""Streams in order of time with timers (R4, R5) and the upsert table of base and deltas."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import ordered as O
from gridspark.streaming import operators as R
from gridspark.streaming import ordered as S
from gridspark.streaming import tables as T

SCHEMA = "sec double, id bigint, user bigint, value double"
LATE = 500


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Nine of ten rows on one key, in files that overlap in time; equal times and nulls occur."""
    rng = random.Random(5)
    rows = [(rng.randint(0, 40000) / 2, i, 0 if i % 10 else rng.randint(1, 3), rng.choice([None, *map(float, range(90))]) if i % 7 == 0 else round(rng.random(), 3)) for i in range(600)]
    rows = [r for r in rows if not 9000 < r[0] < 11000]  # every run is quiet once
    arrival = sorted(rows, key=lambda r: r[0] + rng.randint(0, LATE // 2))
    place = tmp_path_factory.mktemp("shuffled")
    step = len(rows) // 5 + 1
    for k in range(5):
        part = arrival[k * step:(k + 1) * step]
        spark.createDataFrame(rng.sample(part, len(part)), SCHEMA).coalesce(1).write.parquet(str(place / f"w{k}"))
    R.use_rocksdb(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    stamp = lambda df: df.withColumn("ts", F.timestamp_micros((F.col("sec") * 1_000_000).cast("bigint")))
    stream = lambda: stamp(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(place / "w*")))
    yield stream, stamp(spark.createDataFrame(rows, SCHEMA)), rows
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def run(spark, place, stream):
    R.run_available(stream, R.append_log(str(place / "out")), str(place / "offsets"))
    return spark.read.parquet(str(place / "out"))


def state_rows(spark, place, name):
    reader = spark.read.format("statestore").option("path", str(place / "offsets")).option("stateVarName", name)
    return reader.load().count()


def test_debounce_equals_the_batch_up_to_the_watermark(spark, tmp_path, shuffled):
    stream, batch, rows = shuffled
    got = run(spark, tmp_path, S.debounce_in_order(stream(), "user", "ts", "id", 90, f"{LATE} seconds"))
    mark = max(r[0] for r in rows) - LATE
    want = O.greedy_min_gap(batch, "user", "ts", "id", 90).filter(F.col("ts") <= F.timestamp_micros(F.lit(int(mark * 1e6))))
    pairs = lambda df: sorted(tuple(r) for r in df.select("user", "id").collect())
    assert got.select("batch").distinct().count() > 3
    assert pairs(got) == pairs(want) and len(pairs(want)) > 150


def plain_curves(rows, patience, quiet, mark):
    out, by_user = [], {}
    for sec, i, user, value in sorted(rows, key=lambda r: r[:2]):
        by_user.setdefault(user, []).append((sec, value))
    for user, points in by_user.items():
        curves = []
        for sec, value in points:
            if not curves or sec - curves[-1][-1][0] > quiet:
                curves.append([])
            curves[-1].append((sec, value))
        for curve in curves:
            best, best_epoch = 0.0, 0
            for epoch, (sec, value) in enumerate(curve, 1):
                if value is not None and value > best:
                    best, best_epoch = value, epoch
                if epoch - best_epoch >= patience:
                    if sec <= mark:
                        out.append((user, curve[0][0], epoch, True, best_epoch, best))
                    break
            else:
                if curve[-1][0] + quiet <= mark:
                    out.append((user, curve[0][0], len(curve), False, best_epoch, best))
    return sorted(out)


@pytest.mark.parametrize("patience", [6, 60])
def test_curves_end_by_patience_or_quiet(spark, tmp_path, shuffled, patience):
    stream, _, rows = shuffled
    got = run(spark, tmp_path, S.curves_in_order(stream(), "user", "ts", "id", "value", patience, 600, f"{LATE} seconds"))
    told = got.select("user", (F.unix_micros("start") / 1e6).alias("start"), "stop_epoch", "stopped_early", "best_epoch", "best_value")
    want = plain_curves(rows, patience, 600, max(r[0] for r in rows) - LATE)
    assert sorted(tuple(r) for r in told.collect()) == want and {w[3] for w in want} >= {False}


def test_state_of_quiet_keys_goes(spark, tmp_path):
    """Ten keys of an early file leave no state once the watermark is past their gap."""
    for k, rows in enumerate([[(10.0 + u, u, u, 0.5) for u in range(10)], [(5000.0, 50, 77, 0.5)], [(5001.0, 51, 77, 0.5)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/w{k}"))
    R.use_rocksdb(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/w*"))
    stream = stream.withColumn("ts", F.timestamp_micros((F.col("sec") * 1_000_000).cast("bigint")))
    got = run(spark, tmp_path, S.debounce_in_order(stream, "user", "ts", "id", 60, "100 seconds"))
    assert sorted(r["user"] for r in got.collect()) == list(range(10))
    assert state_rows(spark, tmp_path, "kept") == 0
    assert state_rows(spark, tmp_path, "waiting") == 1


ORDER = "ts"
ROWS = "user bigint, ts bigint, v string"


def test_base_and_deltas(spark, tmp_path):
    """Compaction changes no row; replays and crashes at any point lose and double nothing."""
    path, sink = str(tmp_path / "t"), T.upsert_table(str(tmp_path / "t"), "user", ORDER, every=2)
    schema = spark.createDataFrame([], ROWS).schema
    batch = lambda rows: spark.createDataFrame(rows, ROWS)
    table = lambda: {r["user"]: r["v"] for r in T.current(spark, path, schema, "user", ORDER).collect()}
    sink(batch([]), 0)
    assert table() == {}
    sink(batch([(1, 10, "new"), (1, 9, "old"), (2, 5, "only")]), 1)
    assert table() == {1: "new", 2: "only"} and T._committed(spark, path) == (1, [])
    sink(batch([(1, 7, "late"), (2, 5, "tie"), (3, 1, None)]), 2)
    want = {1: "new", 2: "tie", 3: None}
    assert table() == want and T._committed(spark, path) == (1, [2])
    # A batch written but not committed does not exist; its repetition is the one that counts.
    batch([(9, 9, "half")]).selectExpr("*", "3L AS _batch").write.parquet(f"{path}/delta-3")
    batch([(9, 9, "half")]).selectExpr("*", "2L AS _batch").write.parquet(f"{path}/base-2")
    assert table() == want
    for replay in (1, 2):
        sink(batch([(1, 99, "never")]), replay)
    assert table() == want
    sink(batch([(4, 4, "four")]), 3)
    assert table() == want | {4: "four"} and T._committed(spark, path) == (3, [])
    assert T.compact(spark, path, schema, "user", ORDER) == 3
    # Reads cost the live rows.
    assert spark.read.parquet(f"{path}/base-3").count() == 4
