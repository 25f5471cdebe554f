"""Streams in several micro-batches equal the batch result: R1-R8."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import ordered as O
from gridspark.streaming import operators as R


@pytest.fixture(scope="module")
def waves(spark, tmp_path_factory):
    """Events in time order over four files, read one file per micro-batch."""
    rng = random.Random(8)
    rows = sorted((rng.randint(0, 20000), i, rng.randint(0, 3), round(rng.random(), 2)) for i in range(240))
    path = tmp_path_factory.mktemp("waves")
    schema = "sec bigint, id bigint, user bigint, value double"
    for k in range(4):
        part = spark.createDataFrame(rows[60 * k : 60 * k + 60], schema).coalesce(1)
        part.write.mode("append").parquet(str(path / f"w{k}"))
    # One folder per wave, moved together in order of modification.
    files = str(path / "w*")
    R.use_rocksdb(spark)
    stamp = lambda df: df.withColumn("ts", F.timestamp_seconds("sec"))
    stream = stamp(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files))
    return stream, stamp(spark.createDataFrame(rows, schema))


def run(spark, tmp_path, stream, mode="append", keys=None, sink=None):
    out = str(tmp_path / "out")
    R.run_available(stream, sink(out) if sink else R.append_log(out), str(tmp_path / "offsets"), mode)
    if keys:
        return R.latest_by_key(spark, out, stream.schema, keys)
    return spark.read.parquet(out)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_debounce(spark, tmp_path, waves):
    stream, batch = waves
    got = run(spark, tmp_path, R.stream_debounce(stream, "user", "ts", "id", 500))
    want = O.greedy_min_gap(batch, "user", "ts", "id", 500, 3000)
    assert got.select("batch").distinct().count() > 1
    assert rows(got, "user", "id") == rows(want, "user", "id")


def test_early_stop(spark, tmp_path, waves):
    stream, batch = waves
    got = run(spark, tmp_path, R.stream_early_stop(stream, "user", ["ts", "id"], "value", 20))
    numbered = O.number_rows(batch.withColumn("slot", O.time_bucket(F.col("ts"), 900)), ["user"], "slot", ["ts", "id"], "epoch")
    want = O.early_stopping(numbered, "user", "epoch", "value", 20).filter("stopped_early")
    assert rows(got, "user", "stop_epoch", "best_epoch") == rows(want, "user", "stop_epoch", "best_epoch")


def test_windows_and_running_score(spark, tmp_path, waves):
    stream, batch = waves
    metrics = R.windowed_metrics(stream, "ts", "value", F.col("value") > 0.5, "1 hour", late="2 hours")
    got = run(spark, tmp_path, metrics, "update", ["start"])
    want = batch.groupBy(F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0.5).alias("succeeded"))
    assert rows(got, "start", "n", "succeeded") == rows(want, "start", "n", "succeeded")


def test_score(spark, tmp_path, waves):
    stream, batch = waves
    tag = lambda df: df.withColumns({"correct": F.col("value") > 0.3, "filled": F.col("id") % 3 != 0, "predicted": F.col("id") % 10})
    got = run(spark, tmp_path, R.stream_score(tag(stream), "user"), "update", ["user"])
    columns = ["user", "cells", "filled", "filled_correct", "empty_correct", "missed", "wrong_digit", "hallucinated"]
    assert rows(got, *columns) == rows(R.stream_score(tag(batch), "user"), *columns)


def test_sessions(spark, tmp_path, waves):
    stream, batch = waves
    got = run(spark, tmp_path, R.session_activity(stream, "user", "ts", "5 minutes", "10 minutes"))
    want = batch.groupBy("user", F.session_window("ts", "5 minutes").alias("s")).agg(F.count("*").alias("events")).select("user", F.col("s.start").alias("start"), "events")
    closed, every = rows(got, "user", "start", "events"), rows(want, "user", "start", "events")
    assert closed and set(closed) <= set(every) and len(every) - len(closed) <= 8


def test_upsert_is_idempotent(spark, tmp_path, waves):
    stream, batch = waves
    rows_in = stream.select("user", "ts", "id")
    got = run(spark, tmp_path, rows_in, keys=["user"], sink=lambda p: R.upsert_log(p, "user", F.struct("ts", "id")))
    want = batch.groupBy("user").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))
    assert rows(got, "user", "id") == rows(want, "user", "id")
    # A replayed batch rewrites its own folder and changes nothing.
    out = str(tmp_path / "out")
    last = batch.orderBy(F.desc("ts")).limit(60).select("user", "ts", "id")
    replay = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    R.upsert_log(out, "user", F.struct("ts", "id"))(last, replay)
    again = R.latest_by_key(spark, out, rows_in.schema, ["user"])
    assert rows(again, "user", "id") == rows(want, "user", "id")


def test_dedup(spark, tmp_path, waves):
    stream, batch = waves
    keyed = lambda df: df.withColumn("k", F.col("id") % 17)
    got = run(spark, tmp_path, R.stream_dedup(keyed(stream), "k", "ts", "1 day"))
    assert got.count() == 17 == got.select("k").distinct().count()


def test_validate(spark):
    good = [[0] * 9 for _ in range(9)]
    clash = [r[:] for r in good]
    clash[0][0] = clash[8][0] = 3
    df = spark.createDataFrame([(1, good), (2, clash), (3, good[:5])], "id int, grid array<array<int>>")
    got = {r["id"]: r["status"] for r in R.stream_validate(df, "grid").collect()}
    assert got == {1: "ok", 2: "conflict", 3: "malformed"}


def test_late_event_of_a_later_batch_replaces_nothing_newer(spark, tmp_path):
    out, schema = str(tmp_path / "log"), "user bigint, ts bigint, v string"
    order = F.struct("ts")
    sink = R.upsert_log(out, "user", order)
    sink(spark.createDataFrame([(1, 10, "new"), (2, 5, "only")], schema), 0)
    sink(spark.createDataFrame([(1, 7, "late"), (2, 5, "tie")], schema), 1)
    table = spark.createDataFrame([], schema).schema
    got = {r["user"]: r["v"] for r in R.latest_by_key(spark, out, table, ["user"], order).collect()}
    assert got == {1: "new", 2: "tie"}


def test_sketches_merge(spark):
    """R2: sketches of panes, merged, rank within the stated error; small windows are exact."""
    from pyspark.sql import functions as F
    from gridspark.streaming import operators as R
    rows = spark.range(200_000).selectExpr(
        "timestamp_seconds(id % 7 * 3600 + id % 3600) AS ts", "CAST(pmod(id * 7919, 200003) AS DOUBLE) AS ms"
    ).unionByName(spark.sql("SELECT timestamp_seconds(9 * 86400) AS ts, explode(array(3.0D, NULL, 1.0D, 2.0D, double('NaN'))) AS ms"))
    panes = R.windowed_sketches(rows, "ts", "ms", "1 hour")
    got = R.sketch_percentiles(R.merged_sketches(panes, "1 day"), {"q50": 0.5, "q95": 0.95}).orderBy("start").collect()
    values = sorted(r[0] for r in rows.filter("ms >= 0 AND NOT isnan(ms) AND ts < timestamp_seconds(86400)").select("ms").collect())
    assert [(r["n"], r["low"], r["high"]) for r in got] == [(200_000, min(values), max(values)), (3, 1.0, 3.0)]
    for c, q in (("q50", 0.5), ("q95", 0.95)):
        rank = sum(v <= got[0][c] for v in values) / len(values)
        assert abs(rank - q) <= R.SKETCH_ERROR
    assert (got[1]["q50"], got[1]["q95"]) == (2.0, 3.0)


def test_sketches_of_nothing(spark):
    from gridspark.streaming import operators as R
    none = spark.createDataFrame([], "ts timestamp, ms double")
    panes = R.windowed_sketches(none, "ts", "ms", "1 hour")
    assert R.sketch_percentiles(R.merged_sketches(panes, "1 day", "1 hour"), {"q50": 0.5}).collect() == []
